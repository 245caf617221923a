"""Job-table normalisation and projections (narrow, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions.text import py_strip

JOB_TEXT_COLUMNS = ("title", "company", "location")


def normalise(col: Column) -> Column:
    """B1: lower case, Unicode whitespace stripped at both ends."""
    return py_strip(F.lower(col))


def remote_flag(location: Column) -> Column:
    """B2: 1 when the location mentions "remote" in any case, else 0
    (a missing location counts as 0)."""
    return F.coalesce(F.lower(location).contains("remote").cast("int"), F.lit(0))


def canonical_link(link: Column) -> Column:
    """The link up to its first ``?``."""
    return F.split_part(link, F.lit("?"), F.lit(1))


def clean_jobs(jobs: DataFrame) -> DataFrame:
    """B1 + B2 over a job table: normalise title/company/location and add
    ``is_remote`` from the normalised location; other columns untouched."""
    out = jobs
    for c in JOB_TEXT_COLUMNS:
        out = out.withColumn(c, normalise(F.col(c)))
    return out.withColumn("is_remote", remote_flag(F.col("location")))


DISPLAY_DEFAULTS = (("title", "N/A"), ("company", "N/A"), ("location", "N/A"),
                    ("link", "#"))


def default_fields(df: DataFrame) -> DataFrame:
    """Result rows as displayed - an absent field shows its default
    and an absent score shows 0.  Present fields keep their values."""
    out = df
    for name, value in DISPLAY_DEFAULTS:
        if name not in df.columns:
            out = out.withColumn(name, F.lit(value))
    if "match_score" not in df.columns:
        out = out.withColumn("match_score", F.lit(0.0))
    return out.withColumn("match_score", F.col("match_score").cast("double"))


def job_text(title: Column, company: Column, location: Column) -> Column:
    """Title, company and location joined by single spaces; missing
    parts are skipped (the application fails on them instead)."""
    return F.concat_ws(" ", title, company, location)


def resume_text(skills: Column, experience: Column, education: Column) -> Column:
    """Skills joined by spaces, then experience and education; only
    the outer ends are stripped."""
    return py_strip(F.concat(F.array_join(F.coalesce(skills, F.array().cast("array<string>")), " "),
                             F.lit(" "), F.coalesce(experience, F.lit("")), F.lit(" "),
                             F.coalesce(education, F.lit(""))))
