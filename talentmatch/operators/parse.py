"""Parse a table of résumé texts into typed records.

Sections and raw text are kept whole; :func:`displayed` shortens them for
display alone.  One narrow plan: three projections, no shuffle.  The cleaned text, its
lower-cased form and the lower-cased skills tail are produced in earlier
projections so the 48 skill predicates and the field patterns read them
instead of recomputing them (Catalyst keeps projections apart when merging
would duplicate expensive expressions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions import intended as I
from talentmatch.functions import resume as R
from talentmatch.functions.text import is_blank, truncate
from talentmatch.session import spread
from talentmatch.sources.resume_files import basename

RECORD_COLUMNS = ("name", "email", "phone", "skills", "experience", "education",
                  "raw_text", "file", "text_length", "error")


def parse_resumes(df: DataFrame, text_col: str = "text", path_col: str | None = None,
                  keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add the parse record to each row of ``df``.

    ``keep`` columns (default: all except the text) are carried through.
    Rows whose text is blank get ``error`` set and every other field null.
    """
    keep = tuple(c for c in (keep if keep is not None else df.columns) if c != text_col)
    text = F.col(text_col)
    path = F.col(path_col) if path_col else F.lit(None).cast("string")

    stage1 = spread(df).select(
        *keep,
        F.length(text).cast("bigint").alias("_len"),
        is_blank(text).alias("_blank"),
        basename(path).alias("_file"),
        R.clean_text(text).alias("_clean"),
    )
    stage2 = stage1.select(
        *keep, "_len", "_blank", "_file", "_clean",
        F.lower("_clean").alias("_lc"),
        R.skills_tail_lower(F.col("_clean")).alias("_tail"),
    )
    ok = ~F.col("_blank")
    clean = F.col("_clean")

    def when_ok(c: Column) -> Column:
        return F.when(ok, c)

    return stage2.select(
        *keep,
        when_ok(R.extract_name(clean)).alias("name"),
        when_ok(R.extract_email(clean)).alias("email"),
        when_ok(R.extract_phone(clean)).alias("phone"),
        when_ok(R.extract_skills("_lc", "_tail")).alias("skills"),
        when_ok(R.section_text(clean, K.SECTION_EXPERIENCE)).alias("experience"),
        when_ok(R.section_text(clean, K.SECTION_EDUCATION)).alias("education"),
        when_ok(clean).alias("raw_text"),
        when_ok(F.col("_file")).alias("file"),
        when_ok(F.col("_len")).alias("text_length"),
        F.when(~ok, F.lit(K.EMPTY_TEXT_ERROR)).alias("error"),
    )


def parse_resumes_intended(df: DataFrame, text_col: str = "text", path_col: str | None = None,
                           keep: tuple[str, ...] | None = None) -> DataFrame:
    """:func:`parse_resumes` with every field as it is evidently meant
    (``functions.intended``): the same columns."""
    keep = tuple(c for c in (keep if keep is not None else df.columns) if c != text_col)
    text = F.col(text_col)
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    stage1 = spread(df).select(*keep, F.length(text).cast("bigint").alias("_len"), is_blank(text).alias("_blank"),
                               basename(path).alias("_file"), I.lines(text).alias("_lines"))
    stage2 = stage1.withColumn("_lower", F.lower("_lines"))
    ok, t = ~F.col("_blank"), F.col("_lines")
    fields = {"name": I.name(t), "email": I.email(t), "phone": I.phone(t), "skills": I.skills("_lower"),
              "experience": I.section(t, K.SECTION_EXPERIENCE), "education": I.section(t, K.SECTION_EDUCATION),
              "raw_text": t, "file": F.col("_file"), "text_length": F.col("_len")}
    return stage2.select(*keep, *[F.when(ok, c).alias(n) for n, c in fields.items()],
                         F.when(~ok, F.lit(K.EMPTY_TEXT_ERROR)).alias("error"))


def displayed(parsed: DataFrame) -> DataFrame:
    """The record as shown, sections and raw text cut with an ellipsis."""
    return parsed.withColumns({
        "experience": truncate(F.col("experience"), K.SECTION_MAX_CHARS, K.ELLIPSIS),
        "education": truncate(F.col("education"), K.SECTION_MAX_CHARS, K.ELLIPSIS),
        "raw_text": truncate(F.col("raw_text"), K.RAW_TEXT_MAX_CHARS, K.ELLIPSIS)})


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull())


def parsed_ok(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull())
