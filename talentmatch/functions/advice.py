"""Rule-based advice, the advice prompt and the advice gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmatch.functions import constants as K


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def career_advice(skills: Column, match_case: bool = True) -> Column:
    """Advice text from skill rules.

    ``match_case=True`` reproduces the application: membership is exact, so
    title-cased parsed skills never hit the lower-case rule lists.
    ``match_case=False`` compares lower-cased skills (the evident intent).
    """
    s = F.coalesce(skills, F.array().cast("array<string>"))
    if not match_case:
        s = F.transform(s, lambda x: F.lower(x))
    lines = F.array().cast("array<string>")
    for triggers, rule_lines in K.ADVICE_RULES:
        lines = F.concat(lines, F.when(F.arrays_overlap(s, _lit_array(triggers)),
                                       _lit_array(rule_lines))
                         .otherwise(F.array().cast("array<string>")))
    lines = F.when(F.size(lines) == 0, _lit_array(K.ADVICE_DEFAULT)).otherwise(lines)
    return F.array_join(lines, K.ADVICE_SEPARATOR)


def advice_prompt(skills: Column, experience: Column, education: Column) -> Column:
    """The advisor prompt; a missing experience/education reads
    'Not specified' (an empty one stays empty)."""
    parts = K.ADVICE_PROMPT_TEMPLATE.split("{skills}")
    head, rest = parts[0], parts[1]
    mid1, rest = rest.split("{experience}")
    mid2, tail = rest.split("{education}")
    return F.concat(
        F.lit(head), F.array_join(F.coalesce(skills, F.array().cast("array<string>")), ", "),
        F.lit(mid1), F.coalesce(experience, F.lit(K.ADVICE_NOT_SPECIFIED)),
        F.lit(mid2), F.coalesce(education, F.lit(K.ADVICE_NOT_SPECIFIED)),
        F.lit(tail))


def gated(advice: Column, from_file: Column, skills: Column) -> Column:
    """Advice only for profiles parsed from a file with at least one skill."""
    return F.when(from_file & (F.coalesce(F.size(skills), F.lit(0)) > 0), advice)
