"""Résumé field extraction as column expressions (no Python per row).

Each function takes the text column and returns a column; ``parse_record``
in ``operators.parse`` assembles them.  Semantics follow the matched
application's regular expressions as they actually behave on cleaned text
(cleaning removes every newline, so a section runs to the end of the text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions.text import (BOUNDARY, DIGIT, WORD, WS, WS_CLASS, bounded,
                                        escape, truncate)

# -- C1 ---------------------------------------------------------------------

# After whitespace runs become one space, the only whitespace left is " ".
_NOT_KEPT = r"[^\p{L}\p{N}_ @.+()\-]"


def clean_text(text: Column) -> Column:
    """Whitespace runs -> one space; other chars outside word, space and
    ``@ . - + ( )`` -> a space (not re-collapsed); strip the ends."""
    collapsed = F.regexp_replace(text, f"{WS}+", " ")
    return F.trim(F.regexp_replace(collapsed, _NOT_KEPT, " "))


# -- C2 ---------------------------------------------------------------------

# The name patterns.  Case-insensitive matching turns both letter classes into [A-Za-z], so a
# "name" is any two ASCII words of two or more letters.
_TWO_WORDS = "([A-Za-z]{2,} [A-Za-z]{2,})"
NAME_AT_START = "^" + _TWO_WORDS
NAME_ANYWHERE = f"(?<!{WORD}){_TWO_WORDS}(?!{WORD})"
NAME_AFTER_LABEL = "(?iu)name[: ]*" + _TWO_WORDS


def extract_name(clean: Column) -> Column:
    hits = [F.nullif(F.regexp_extract(clean, p, 1), F.lit(""))
            for p in (NAME_AT_START, NAME_ANYWHERE, NAME_AFTER_LABEL)]
    return F.coalesce(*hits, F.lit(K.UNKNOWN_NAME))


# -- C3 / C4 ----------------------------------------------------------------

# The e-mail and phone patterns.
EMAIL = BOUNDARY + r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}" + BOUNDARY
PHONE = (BOUNDARY + rf"(?:\+{DIGIT}{{1,2}}{WS}?)?\(?{DIGIT}{{3}}\)?[{WS_CLASS}.\-]?"
         rf"{DIGIT}{{3}}[{WS_CLASS}.\-]?{DIGIT}{{4}}" + BOUNDARY)


def extract_email(clean: Column) -> Column:
    """First email-like token, ``''`` when none."""
    return F.regexp_extract(clean, EMAIL, 0)


def extract_phone(clean: Column) -> Column:
    """First phone-like token, ``''`` when none (whole match kept)."""
    return F.regexp_extract(clean, PHONE, 0)


# -- C6 / C7 ----------------------------------------------------------------

def section_pattern(keyword: str) -> str:
    return f"(?isu){escape(keyword)}[:{WS_CLASS}]*(.*)"


def section_text(clean: Column, keyword: str) -> Column:
    """Text after the first case-insensitive occurrence of ``keyword``
    (leading ``:``/whitespace skipped) to the end, stripped."""
    return F.trim(F.regexp_extract(clean, section_pattern(keyword), 1))


def extract_section(clean: Column, keyword: str) -> Column:
    """Section text cut to 200 characters plus an ellipsis."""
    return truncate(section_text(clean, keyword), K.SECTION_MAX_CHARS, K.ELLIPSIS)


def raw_text(clean: Column) -> Column:
    return truncate(clean, K.RAW_TEXT_MAX_CHARS, K.ELLIPSIS)


# -- C5 ---------------------------------------------------------------------

def skill_title(skill: str) -> str:
    return skill.title()


def extract_skills(lower_clean: str, lower_skills_tail: str,
                   lexicon: tuple[str, ...] = K.SKILL_LEXICON) -> Column:
    """Sorted distinct title-cased lexicon skills found in the text, from the
    names of two columns computed once by the caller.

    A skill counts when it occurs as a whole word in the lower-cased text,
    or as a plain substring of the text after the word "skills".  The cheap
    ``contains`` test guards each regex so most rows never run one.  Built as
    one SQL text: one call to the JVM instead of several hundred.
    """
    return F.expr(_skills_sql(f"`{lower_clean}`", f"`{lower_skills_tail}`", lexicon))


def _skills_sql(lc: str, tail: str, lexicon: tuple[str, ...]) -> str:
    for skill in lexicon:
        if "'" in skill:
            raise ValueError(f"quote in skill {skill!r}")
    hits = ", ".join(
        f"CASE WHEN contains({lc}, '{s}') AND ({lc} RLIKE r'{bounded(s)}' "
        f"OR contains({tail}, '{s}')) THEN '{skill_title(s)}' END" for s in lexicon)
    return f"array_sort(filter(array({hits}), x -> x IS NOT NULL))"


def skills_tail_lower(clean: Column) -> Column:
    return F.lower(F.regexp_extract(clean, section_pattern(K.SECTION_SKILLS), 1))
