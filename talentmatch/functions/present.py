"""Presentation columns of a match result and a profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmatch.functions import constants as K


def score_band(score: Column) -> Column:
    """high / medium / low.  NaN compares as the largest double in Spark,
    while the application's comparison is false for it, so NaN is mapped
    to 0 first."""
    s = F.nanvl(score.cast("double"), F.lit(0.0))
    high, medium, low = K.BAND_LABELS
    return F.when(s >= K.BAND_HIGH, high).when(s >= K.BAND_MEDIUM, medium).otherwise(low)


def score_pct(score: Column) -> Column:
    """``"%.0f" % (score * 100)`` followed by ``%``: round half to even;
    a NaN score prints as ``nan%``."""
    s = score.cast("double")
    digits = F.when(F.isnan(s), F.lit("nan")) \
        .otherwise(F.bround(s * 100, 0).cast("bigint").cast("string"))
    return F.concat(digits, F.lit("%"))


def skills_summary(skills: Column) -> Column:
    return F.array_join(skills, ", ")


def advice_html(advice: Column) -> Column:
    return F.replace(advice, F.lit("\n"), F.lit("<br>"))
