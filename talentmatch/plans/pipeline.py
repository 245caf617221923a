"""End-to-end plans.

The flagship answers the application's question for a whole table of
résumés at once: parse every résumé, build TF-IDF features fitted on the
cleaned job table, keep the top five jobs per résumé and present each
with its job fields, score band and percent label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions import present as P
from talentmatch.operators import clean as C
from talentmatch.operators.match import match_tfidf
from talentmatch.operators.parse import parse_resumes


def matched_jobs(texts: DataFrame, jobs: DataFrame, top_n: int = K.DEFAULT_TOP_N) -> DataFrame:
    """``texts(resume_id, text)`` x ``jobs(job_id, title, company, location,
    link)`` -> ranked matches with display columns."""
    clean = C.clean_jobs(jobs.select("job_id", "title", "company", "location", "link"))
    job_text = clean.select("job_id", C.job_text(F.col("title"), F.col("company"),
                                                 F.col("location")).alias("text"))
    m = match_tfidf(texts, job_text, top_n)
    # display fields are joined after the top-n cut, so only ids and
    # scores travel through the matching shuffles
    return (m.join(clean.select("job_id", "title", "company", "location", "link"), "job_id")
             .select("resume_id", "rank", "job_id", "title", "company", "location", "link",
                     "match_score",
                     P.score_band(F.col("match_score")).alias("band"),
                     P.score_pct(F.col("match_score")).alias("pct")))


def match_resumes_to_jobs(resumes: DataFrame, jobs: DataFrame, top_n: int = K.DEFAULT_TOP_N,
                          parse: Callable[[DataFrame], DataFrame] = parse_resumes) -> DataFrame:
    """``resumes(resume_id, text)`` x ``jobs(job_id, title, company,
    location, link)`` -> ranked matches with display columns."""
    parsed = parse(resumes.select("resume_id", "text"))
    res_text = parsed.where(F.col("error").isNull()).select(
        "resume_id", C.resume_text(F.col("skills"), F.col("experience"), F.col("education"))
        .alias("text"))
    return matched_jobs(res_text, jobs, top_n)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentmatch.sources import fixtures as FX
    return match_resumes_to_jobs(FX.resumes_raw(spark, sf_dir), FX.jobs_raw(spark, sf_dir))
