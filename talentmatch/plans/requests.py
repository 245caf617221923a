"""The application's whole answer to a request, for a table of requests.

A request is an uploaded file, a form, or both.  Its answer is what the result
page shows: the profile (of the file if one was admitted and parsed, else of
the form), the ranked jobs with score bands, the advice, or the message that
takes their place.

Plan: one projection parses the files, one full outer join on the request id
resolves profiles, accepted profiles go through the matcher as ids and texts
alone, and one left join by request id brings at most ``top_n`` jobs back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.functions import advice as A
from talentmatch.functions import constants as K
from talentmatch.functions import present as P
from talentmatch.functions.text import truncate
from talentmatch.operators import clean as C
from talentmatch.operators.parse import parse_resumes
from talentmatch.operators.profiles import resolve_profiles
from talentmatch.plans.pipeline import matched_jobs
from talentmatch.sources.resume_files import admitted, file_text, too_large

NO_JOBS = "No AI-matched jobs found."

#: A landed request: the upload's name, size and text, and the form's fields.
REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("skills", T.StringType()),
    T.StructField("experience", T.StringType()),
    T.StructField("education", T.StringType()),
])
#: The same where an upload may land as bytes instead of text.
UPLOAD_SCHEMA = T.StructType([*REQUEST_SCHEMA.fields, T.StructField("content", T.BinaryType())])


def with_texts(requests: DataFrame) -> DataFrame:
    """``UPLOAD_SCHEMA`` rows as ``REQUEST_SCHEMA`` rows: the text of an
    admitted upload is read from its bytes where it has no text yet, a missing
    size is that of the bytes.  Bytes of other files are not read."""
    sized = requests.withColumn("size", F.coalesce("size", F.octet_length("content").cast("bigint")))
    wanted = admitted(F.col("filename"), F.col("size")) & F.col("text").isNull()
    text = F.coalesce("text", file_text(F.col("filename"), F.when(wanted, F.col("content"))))
    return sized.withColumn("text", text).select(*REQUEST_SCHEMA.fieldNames())


def resolved_requests(requests: DataFrame) -> DataFrame:
    """A profile or a rejection per request, whose upload may be text or
    ``content``.  Ids are keys."""
    requests = with_texts(requests) if "content" in requests.columns else requests
    uploads = requests.where(F.col("filename").isNotNull())
    files = parse_resumes(uploads.select("request_id", "filename", "size", "text"), keep=("request_id", "filename", "size"))
    files = files.withColumns({"admitted": admitted(F.col("filename"), F.col("size")), "too_large": too_large(F.col("size"))})
    return resolve_profiles(files, requests.select("request_id", "skills", "experience", "education"))


def answer_profiles(resolved: DataFrame, jobs: DataFrame, top_n: int = K.DEFAULT_TOP_N, match_case: bool = True) -> DataFrame:
    """``request_id, profile_source, name, email, skills, experience,
    education, advice_html, n_jobs, top_score, jobs, message`` for every
    resolved profile; ``jobs`` are structs in rank order.  A rejected request
    shows its rejection, one without matches says so."""
    texts = resolved.where(F.col("rejection").isNull()).select(
        F.col("request_id").alias("resume_id"), C.resume_text(F.col("skills"), F.col("experience"), F.col("education")).alias("text"))
    shown = F.struct("rank", "job_id", "title", "company", "location", "link", "match_score", "band", "pct")
    lists = matched_jobs(texts, jobs, top_n).groupBy(F.col("resume_id").alias("request_id")).agg(
        F.sort_array(F.collect_list(shown)).alias("jobs"))  # top_n entries
    from_file = F.col("profile_source") == "file"
    advice = A.gated(A.career_advice(F.col("skills"), match_case), from_file, F.col("skills"))

    def section(c: str):
        return F.when(from_file, truncate(F.col(c), K.SECTION_MAX_CHARS, K.ELLIPSIS)).otherwise(F.col(c)).alias(c)

    return resolved.join(lists, "request_id", "left").select(
        "request_id", "profile_source", "name", "email", P.skills_summary(F.col("skills")).alias("skills"),
        section("experience"), section("education"), P.advice_html(advice).alias("advice_html"),
        F.coalesce(F.size("jobs"), F.lit(0)).alias("n_jobs"), F.get("jobs", F.lit(0))["match_score"].alias("top_score"), "jobs",
        F.coalesce("rejection", F.when(F.col("jobs").isNull(), F.lit(NO_JOBS))).alias("message"))


def answer_requests(requests: DataFrame, jobs: DataFrame, top_n: int = K.DEFAULT_TOP_N, match_case: bool = True) -> DataFrame:
    """Answers to ``REQUEST_SCHEMA`` or ``UPLOAD_SCHEMA`` rows from ``jobs(job_id, title, company,
    location, link)``."""
    return answer_profiles(resolved_requests(requests), jobs, top_n, match_case)


def with_job_lines(answers: DataFrame) -> DataFrame:
    """``jobs`` as text, a line each, as a page lists them."""
    line = F.transform("jobs", lambda j: F.concat_ws(" | ", j["rank"], j["title"], j["company"], j["location"], j["pct"], j["band"], j["link"]))
    return answers.withColumn("jobs", F.array_join(line, "\n"))
