"""Op 13 — personal data by anchor expansion.

One Aho-Corasick automaton runs over the text once and finds anchors: at-signs
(also spelled, as ``[at]``), schemes (``://``, ``mailto:``, ``tel:``), a plus
or a point before a digit, two digits side by side, and words that announce an
account.  At each anchor a parser of its kind expands to the boundaries on
both sides and validates what it holds.  Every parser starts from one place
and goes one way, and stretches behind its reach are not read again, so the
work is linear in the text.

Base kinds: ``email``, ``ip`` (parts of at most 255), ``card`` (12 to 19 digits
that pass Luhn), ``phone`` (a plus and 9 to 15 digits); their spans are those
of a scan from left to right, non-overlapping per kind, failing ones dropped.
Added kinds: ``spelled`` (``jo [at] mail [dot] org``), ``url`` (an address with
a user, or a parameter that names a person), ``uri`` (``mailto:``, ``tel:``)
and ``account`` (a cue and an identifier; an IBAN by its check digits).  Added
spans may overlap others.

Texts are handled as UTF-8 bytes, since all anchors and classes are ASCII;
positions come out as code points, ends exclusive.  The automaton reads a text
in pieces of ``PIECE`` bytes and keeps its state between them.

Edge cases: null text counts as empty (no spans); ids may be null or repeat,
each row is scanned on its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "spelled", "url", "uri", "account")
BASE = 4
PIECE = 1 << 20

DIGITS = b"0123456789"
WORD = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + DIGITS
LOCAL = WORD + b"._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")

SPELLED_AT = ("[at]", "(at)", "{at}", "<at>")
SPELLED_DOT = rb"(?:\.| {0,2}[\[({<]dot[\])}>] {0,2})"
SPELLED_DOMAIN = re.compile(rb" {0,2}[A-Za-z0-9-]{1,63}(?:" + SPELLED_DOT + rb"[A-Za-z0-9-]{1,63}){0,8}?" + SPELLED_DOT
                            + rb"[A-Za-z]{2,24}(?![A-Za-z0-9]|" + SPELLED_DOT + rb"[A-Za-z0-9])", re.IGNORECASE)
URL_REST = re.compile(rb"[^\s\"'<>]*")
URL_USER = re.compile(rb"[^\s/?#@:]+(?::[^\s/?#@]*)?@[A-Za-z0-9\[]")
URL_FIELD = re.compile(rb"[?&;](?:user|username|login|email|e-mail|mail|phone|tel|name|account|customer|patient|ssn|uid)"
                       rb"(?:_?id)?=[^&;#\s]", re.IGNORECASE)
MAIL_URIS, CALL_URIS = ("mailto:", "sip:", "xmpp:"), ("tel:", "sms:", "callto:")
MAIL_ADDRESS = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CALL_NUMBER = re.compile(rb"\+?[0-9][0-9().-]*[0-9]")
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn", "social security",
        "tax id", "routing", "customer id", "member id", "card number")
AFTER_CUE = re.compile(rb"(?: {1,2}(?:number|no|nr|num|id|code)\b\.?)?[ \t]{0,3}[:#=]?[ \t]{0,3}", re.IGNORECASE)
ACCOUNT = re.compile(rb"(?:[A-Za-z]{0,4}[0-9][A-Za-z0-9]{0,33})(?:[ -][A-Za-z]{0,4}[0-9][A-Za-z0-9]{0,33}){0,9}(?![A-Za-z0-9])")
IBAN = re.compile(rb"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def run_start(text: bytes, at: int, stop: int, chars: bytes) -> int:
    """Where the run of ``chars`` that ends at ``at`` begins, not before ``stop``."""
    while at > stop:
        low = max(stop, at - 64)
        left = len(text[low:at].rstrip(chars))
        if left:
            return low + left
        at = low
    return at


def passes_luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = (d - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes_mod_97(iban: bytes) -> bool:
    """Check digits of an IBAN without spaces: four characters go to the end, letters count from 10."""
    return int("".join(str(int(chr(c), 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: bytes) -> bytes:
    return bytes(c for c in text if 48 <= c <= 57)


class Parsers:
    """The parsers of one text: each takes the first and last place of its
    anchor and gives the spans it found there.  ``reach`` is how far each kind
    has read."""

    def __init__(self, text: bytes):
        self.text = text
        self.reach = [0] * len(KINDS)

    def email(self, first: int, _: int) -> Iterator[tuple[int, int]]:
        start = run_start(self.text, first, self.reach[0], LOCAL)
        if start < first and (m := DOMAIN.match(self.text, first + 1)):
            self.reach[0] = m.end()
            yield start, m.end()

    def ip(self, first: int, _: int) -> Iterator[tuple[int, int]]:
        """Numbers joined by points go four by four."""
        if first < self.reach[1]:
            return
        start = run_start(self.text, first, self.reach[1], DIGITS)
        if start == first:
            return
        m = CHAIN.match(self.text, start)
        self.reach[1] = m.end()
        parts = m[0].split(b".")
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i:i + 4])) + 3
            if all(len(p := x.lstrip(b"0")) <= 3 and int(p or 0) <= 255 for x in parts[i:i + 4]):
                yield start, end
            start = end + 1

    def card(self, first: int, _: int) -> Iterator[tuple[int, int]]:
        if first < self.reach[2]:
            return
        m = CARD.match(self.text, first)
        self.reach[2] = m.end()
        digits = digits_of(m[0]) if m.end() - first <= 37 else b""
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            yield first, m.end()

    def phone(self, first: int, _: int) -> Iterator[tuple[int, int]]:
        if (m := PHONE.match(self.text, first)) and 9 <= len(digits_of(m[0])) <= 15:
            yield first, m.end()

    def spelled(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        end = run_start(self.text, first, max(0, first - 2), b" ")
        start = run_start(self.text, end, self.reach[4], LOCAL)
        if start < end and (m := SPELLED_DOMAIN.match(self.text, last + 1)):
            self.reach[4] = m.end()
            yield start, m.end()

    def url(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        if first < self.reach[5]:
            return
        start = run_start(self.text, first, self.reach[5], WORD + b"+.-")
        rest = URL_REST.match(self.text, last + 1)
        end = last + 1 + len(rest[0].rstrip(b".,;:!?)]}"))
        self.reach[5] = rest.end()
        if start < first and self.text[start:start + 1].isalpha() and (
                URL_USER.match(self.text, last + 1, end) or URL_FIELD.search(self.text, last + 1, end)):
            yield start, end

    def uri(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        if first < self.reach[6] or self.text[max(0, first - 1):first].isalnum():
            return
        number = self.text[first:last + 1].lower().decode() in CALL_URIS
        m = (CALL_NUMBER if number else MAIL_ADDRESS).match(self.text, last + 1)
        if m:
            self.reach[6] = m.end()
            if not number or 7 <= len(digits_of(m[0])) <= 15:
                yield first, m.end()

    def account(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        if first < self.reach[7] or self.text[max(0, first - 1):first].isalnum():
            return
        at = AFTER_CUE.match(self.text, last + 1).end()
        if m := IBAN.match(self.text, at):
            compact, ends = bytearray(), []
            for i in range(at, m.end()):
                if self.text[i] != 32:
                    compact.append(self.text[i])
                    ends.append(i + 1)
            for n in range(len(compact), 14, -1):
                if not self.text[ends[n - 1]:ends[n - 1] + 1].isalnum() and passes_mod_97(bytes(compact[:n])):
                    self.reach[7] = ends[n - 1]
                    yield at, ends[n - 1]
                    return
        if (m := ACCOUNT.match(self.text, at)) and len(digits_of(m[0])) >= 6:
            self.reach[7] = m.end()
            yield at, m.end()


@lru_cache(maxsize=1)
def anchors():
    """The automaton; a value is ``(kind, length)``."""
    import ahocorasick
    found = ahocorasick.Automaton()
    kinds = {"@": 0, "://": 5}
    kinds |= {f".{d}": 1 for d in range(10)}
    kinds |= {f"{c}{gap}{d}": 2 for c in range(10) for gap in ("", " ", "-") for d in range(10)}
    kinds |= {f"+{d}": 3 for d in range(10)}
    kinds |= dict.fromkeys(SPELLED_AT, 4) | dict.fromkeys(MAIL_URIS + CALL_URIS, 6) | dict.fromkeys(CUES, 7)
    for anchor, kind in kinds.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def byte_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` in bytes, by start, then kind."""
    parsers = Parsers(text)
    parse: list[Callable] = [getattr(parsers, k) for k in KINDS]
    reach, out, found = parsers.reach, [], anchors().iter("")
    for at in range(0, len(text), PIECE):
        found.set(text[at:at + PIECE].lower().decode("latin-1"))
        for last, (kind, length) in found:
            first = last + 1 - length
            if first >= reach[kind]:
                out += [(s, kind, e) for s, e in parse[kind](first, last)]
    return sorted(out)


def all_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` in code points."""
    spans = byte_spans(text)
    if not spans or text.isascii():
        return spans
    places = sorted({p for s, _, e in spans for p in (s, e)})
    heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # a code point's first byte
    known, before, at = {}, 0, 0
    for p in places:
        before += int(np.count_nonzero(heads[at:p]))
        known[p], at = before, p
    return [(known[s], k, known[e]) for s, k, e in spans]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` of every row: array of (kind, start, end)."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(bytes(t))])

    return rows.select(F.col("id").alias(id_col), spans("text").alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: Callable[[str], str] = lambda kind: f"[{kind.upper()}]") -> DataFrame:
    """``df`` with every span of its texts replaced by the mark of its kind;
    of overlapping spans the first is marked and all are blanked.  Other rows,
    null texts included, stay as they are."""
    marks = [mark(k).encode() for k in KINDS]

    @F.pandas_udf(T.StringType())
    def cleaned(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            raw, out, at = bytes(text), [], 0
            for start, kind, end in byte_spans(raw):
                if start >= at:
                    out += [raw[at:start], marks[kind]]
                at = max(at, end)
            return (b"".join(out) + raw[at:]).decode("utf-8", "replace")

        return texts.map(one)

    return df.withColumn(text_col, cleaned(F.col(f"`{text_col}`").cast("binary")))


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, and the spans as text: all, and the base ones hashed."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return scanned.select(
        id_col, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(listed(of(*KINDS[:BASE])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
