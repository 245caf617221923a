"""Regex building blocks with Python ``str``-regex semantics on Java regex.

Python's ``\\s``, ``\\w``, ``\\d`` and ``\\b`` are Unicode-aware; Java's are
ASCII by default and its ``\\b`` changed meaning across JDK versions.  The
classes below spell the Python meaning out explicitly so the same pattern
gives the same answer on every executor JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python ``str.isspace()`` set: ASCII whitespace, Unicode separators, the
# information separators 0x1c-0x1f and NEL.
WS_CLASS = r"\s\p{Z}\x0b\x1c-\x1f\x85"
WS = f"[{WS_CLASS}]"
# Python ``\w`` for ``str``: letters, numbers (Nd, Nl, No) and underscore.
WORD_CLASS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CLASS}]"
NOT_WORD = f"[^{WORD_CLASS}]"
DIGIT = r"\p{Nd}"

# Python ``\b`` at an unknown position.
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

_REGEX_META = set(".^$*+?()[]{}|\\-")


def escape(literal: str) -> str:
    """Escape regex metacharacters (valid for Java regex and RE2)."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in literal)


def _is_word_char(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def bounded(literal: str) -> str:
    """``\\b<literal>\\b`` with Python semantics, resolved per end.

    Next to a word character ``\\b`` means "no word character on the other
    side"; next to a non-word character it means "a word character there".
    """
    before = f"(?<!{WORD})" if _is_word_char(literal[0]) else f"(?<={WORD})"
    after = f"(?!{WORD})" if _is_word_char(literal[-1]) else f"(?={WORD})"
    return before + escape(literal) + after


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def is_blank(col: Column) -> Column:
    """``not text or not text.strip()`` (null counts as blank)."""
    return F.coalesce(F.length(F.regexp_replace(col, f"{WS}+", "")) == 0, F.lit(True))


def truncate(col: Column, n: int, ellipsis: str = "...") -> Column:
    """``x[:n] + ellipsis if len(x) > n else x`` in code points."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(ellipsis))) \
        .otherwise(col)


# Named and numeric entities most markup uses; ``&amp;`` is decoded last so
# ``&amp;lt;`` becomes the text ``&lt;``.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
             ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(col: Column) -> Column:
    for ent, ch in _ENTITIES:
        col = F.replace(col, F.lit(ent), F.lit(ch))
    return col


def element_text(inner: Column) -> Column:
    """Text of an element's inner markup: tags dropped, entities decoded,
    whitespace stripped at the ends."""
    return py_strip(decode_entities(F.regexp_replace(inner, r"<[^>]*>", "")))
