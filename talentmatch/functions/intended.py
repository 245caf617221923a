"""Résumé fields as they are evidently meant, beside the faithful ones.

The matched application removes every line break before it looks for
sections, ignores case where capitals should tell a name, and takes skills by
substring (see ``functions.resume``).  These columns keep the lines: a section
ends at the next heading or blank line, a name needs capitals, a phone keeps
its country code, and a skill counts as a whole term only - ``c++`` and ``c#``
included, ``java`` inside ``javascript`` not.

All patterns are free of lookaround and read the same in Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions.text import DIGIT, WORD_CLASS, WS_CLASS, escape

_BLANKS = r"[ \t\x0b\x0c\x1c-\x1f\x85\p{Z}]"
_NAME = r"(\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)? \p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?)"
_BEFORE, _AFTER = f"(?:^|[^{WORD_CLASS}])", f"(?:$|[^{WORD_CLASS}])"
NAME_PATTERNS = (f"^{_NAME}{_AFTER}", f"(?:^|\n)(?i:name) ?:? ?{_NAME}{_AFTER}", f"{_BEFORE}{_NAME}{_AFTER}")
EMAIL = rf"(?:^|[^{WORD_CLASS}.%+\-])([A-Za-z0-9_][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}}){_AFTER}"
PHONE = (rf"(?:^|[^{WORD_CLASS}+])((?:\+{DIGIT}{{1,2}}[ .\-]?)?(?:\({DIGIT}{{3}}\)|{DIGIT}{{3}})[ .\-]?"
         rf"{DIGIT}{{3}}[ .\-]?{DIGIT}{{4}}){_AFTER}")
#: What ends a section: a blank line, or a line that starts a heading.
SECTION_END = r"(?s)^(.*?)(?:\n\n|\n[^\n:]{1,40}:|\z)"


def lines(text: Column) -> Column:
    """The text with LF line ends, single spaces and no space around them."""
    unix = F.regexp_replace(text, "\r\n?|[\u2028\u2029]", "\n")
    single = F.regexp_replace(unix, f"{_BLANKS}+", " ")
    return F.regexp_replace(F.regexp_replace(single, " ?\n ?", "\n"), f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def name(text: Column) -> Column:
    """At the start, else after a label, else anywhere."""
    return F.coalesce(*[_first(text, p) for p in NAME_PATTERNS], F.lit(K.UNKNOWN_NAME))


def email(text: Column) -> Column:
    return F.regexp_extract(text, EMAIL, 1)


def phone(text: Column) -> Column:
    return F.regexp_extract(text, PHONE, 1)


def heading(keyword: str) -> str:
    """From a line that starts with the keyword, followed by a colon or
    nothing else; group 1 = all that follows."""
    return rf"(?is)(?:^|\n){escape(keyword)} ?(?::|\n)[:\s]*(.*)"


def section(text: Column, keyword: str) -> Column:
    return F.regexp_extract(F.regexp_extract(text, heading(keyword), 1), SECTION_END, 1)


def skill_pattern(skill: str) -> str:
    """The skill as a whole term, its words apart by white space."""
    edge = f"{WORD_CLASS}+#"
    words = r"\s+".join(escape(w) for w in skill.split(" "))
    return f"(?:^|[^{edge}]){words}(?:$|[^{edge}])"


def skills(lower_text: str, lexicon: tuple[str, ...] = K.SKILL_LEXICON) -> Column:
    """Sorted distinct title-cased skills of a lower-cased text column; the
    cheap ``contains`` test of the first word guards each pattern."""
    hits = ", ".join(f"CASE WHEN contains(`{lower_text}`, '{s.split(' ')[0]}') AND `{lower_text}` RLIKE r'{skill_pattern(s)}' "
                     f"THEN '{s.title()}' END" for s in lexicon)
    return F.expr(f"array_sort(filter(array({hits}), x -> x IS NOT NULL))")
