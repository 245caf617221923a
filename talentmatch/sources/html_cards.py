"""Job cards from landed HTML pages.

Per page: the first container kind that occurs is chosen, the markup split at
its opening tags (what precedes the first is no card), every segment cut where
its container closes - found by counting the container's opening and closing
tags - and each field read with the first selector alternative present in the
card.  All cards are read; ``max_cards`` keeps the first ones of each page,
before any card is dropped.  Narrow plan: no shuffle, each page is handled
where it was read, one search per container kind and per selector.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions.text import decode_entities, element_text, py_strip
from talentmatch.session import spread


def open_tag(tag: str, token: str | None) -> str:
    """An opening tag whose class attribute (in either quotes, in any case)
    holds the token as one of its words; without a token, any such tag."""
    if token is None:
        return rf"<(?i:{tag})(?:\s[^>]*)?>"
    words = "|".join(f"{q}(?:[^{q}]*\\s)?{token}(?:\\s[^{q}]*)?{q}" for q in "\"'")
    return rf"<(?i:{tag})\s(?:[^>]*\s)?(?i:class)\s*=\s*(?:{words})[^>]*>"


def element(tag: str, token: str | None) -> str:
    """Group 1 = inner markup of the first such element."""
    return rf"(?s){open_tag(tag, token)}(.*?)</(?i:{tag})\s*>"


def any_tag(tag: str) -> str:
    """Opening or closing tags; group 1 = the slash of a closing one."""
    return rf"<(/?)(?i:{tag})(?:\s[^>]*)?>"


def _closed(segment: Column, tag: str) -> Column:
    """What follows a container's opening tag up to its closing tag (to the
    end if it never closes), without the tags of that kind inside."""
    steps = F.transform(F.regexp_extract_all(segment, F.lit(any_tag(tag)), 1), lambda x: F.when(x == "/", -1).otherwise(1))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("pieces"))
    end = F.aggregate(steps, start, lambda s, x: F.when(s["depth"] == 0, s).otherwise(
        F.struct((s["depth"] + x).alias("depth"), (s["pieces"] + 1).alias("pieces"))))
    parts = F.split(segment, any_tag(tag), -1)
    folded = F.array_join(F.slice(parts, 1, F.when(end["depth"] == 0, end["pieces"]).otherwise(F.size(parts))), "")
    # without another opening tag the first closing one ends it: no need to count
    first = F.regexp_replace(segment, rf"(?s)</(?i:{tag})(?:\s[^>]*)?>.*", "")
    return F.when(segment.rlike(rf"<(?i:{tag})(?:\s[^>]*)?>"), folded).otherwise(first)


def _closer(tag: str):
    return lambda segment: _closed(segment, tag)


def _first_match(card: Column, selectors, pattern, group: int) -> Column:
    """What the first selector present in the card matches, else null; a
    card without the selector's class word is not searched."""
    found = []
    for tag, token in selectors:
        match = F.get(F.regexp_extract_all(card, F.lit(pattern(tag, token)), F.lit(group)), F.lit(0))
        plain = token is not None and re.fullmatch(r"[\w-]+", token, re.ASCII)
        found.append(F.when(F.contains(card, F.lit(token)), match) if plain else match)
    return F.coalesce(*found)


def _text(inner: Column, default: str) -> Column:
    """:func:`element_text`, in full only where there is markup or an entity."""
    marked = F.contains(inner, F.lit("<")) | F.contains(inner, F.lit("&"))
    return F.coalesce(F.when(marked, element_text(inner)).otherwise(py_strip(inner)), F.lit(default))


_HREF = r"""\s(?i:href)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _link(opening: Column):
    """(link, dropped) of a link element's opening tag: its href cut at '?',
    '#' when no link element exists; one without href drops the card."""
    href = F.concat(F.regexp_extract(opening, _HREF, 1), F.regexp_extract(opening, _HREF, 2))
    link = F.coalesce(F.split_part(decode_entities(href), F.lit("?"), F.lit(1)), F.lit(K.MISSING_LINK))
    return link, F.coalesce(~opening.rlike(_HREF), F.lit(False))


def extract_cards(pages: DataFrame, *, page_id: str = "page_id", html: str = "html",
                  scrape_date: str = "2025-08-17", containers=K.CARD_CONTAINERS, title=K.CARD_TITLE,
                  company=K.CARD_COMPANY, location=K.CARD_LOCATION, link=K.CARD_LINK,
                  max_cards: int | None = None) -> DataFrame:
    """``(page_id, card_no, title, company, location, link, source,
    date_scraped)`` for every kept card."""
    h = F.col(html)
    kind = None
    for k, (tag, token) in enumerate(containers):
        present = h.rlike(open_tag(tag, token))
        kind = F.when(present, k) if kind is None else kind.when(present, k)
    found = spread(pages).select(F.col(page_id).alias("page_id"), h, kind.alias("kind"))
    # cards are cut before they are exploded, so that no later step computes them again
    cut = None
    for k, (tag, token) in enumerate(containers):
        segments = F.slice(F.split(h, open_tag(tag, token), -1), 2, F.lit(max_cards or (1 << 30)))
        own = F.transform(segments, _closer(tag))
        cut = F.when(F.col("kind") == k, own) if cut is None else cut.when(F.col("kind") == k, own)
    cards = found.select("page_id", F.posexplode(cut).alias("card_no", "card")).withColumn("card_no", F.col("card_no").cast("int"))
    # the opening tag is a generated column, so that the filter on it does not search the card again
    c = F.col("card")
    cards = cards.select("page_id", "card_no", "card", F.explode(F.array(_first_match(c, link, open_tag, 0))).alias("opening"))
    href, dropped = _link(F.col("opening"))
    fields = cards.where(~dropped).select(
        "page_id", "card_no", href.alias("link"), *[_first_match(c, selectors, element, 1).alias(n) for n, selectors in
                                                    (("title", title), ("company", company), ("location", location))])
    return fields.select(
        "page_id", "card_no", _text(F.col("title"), K.MISSING_TITLE).alias("title"),
        _text(F.col("company"), K.MISSING_COMPANY).alias("company"),
        _text(F.col("location"), K.MISSING_LOCATION).alias("location"), "link",
        F.lit(K.SOURCE_HTML).alias("source"), F.to_date(F.lit(scrape_date)).alias("date_scraped"))
