"""Whole answers to requests, in batch and by the stream."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.plans.requests import NO_JOBS, REQUEST_SCHEMA, UPLOAD_SCHEMA, answer_requests, resolved_requests, with_job_lines
from talentmatch.sources import fixtures as FX
from talentmatch.streaming.requests import start_request_stream

JOBS = "job_id long, title string, company string, location string, link string"
CV = "Ada Lovelace\nada@example.com\nSKILLS: python, sql\nEXPERIENCE: data analyst at Acme\nEDUCATION: " + "BSc " * 80


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame([(1, "Data Analyst", "Acme", "Remote", "l1"), (2, "Python Developer", None, "City", "l2"),
                                  (3, "Gardener", "Green", "City", "l3"), (4, None, None, "  ", "l4")], JOBS)


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


ROWS = [(1, "cv.txt", 200, CV, "java", "", ""),               # the file wins
        (2, "cv.exe", 200, CV, " python , ", " analyst ", None),  # not admitted: the form
        (3, None, None, None, "gardener", None, None),        # form alone
        (4, None, None, None, "  ", "x", "y"),                # nothing to go by
        (5, "cv.pdf", 20_000_000, CV, "python", "", ""),      # too large: the form is not read
        (6, "cv.docx", 10, " \n ", "python", "", ""),         # parse error
        (7, "cv.TXT", 30, "Bob Stone writes words", None, None, None)]  # no skills: no advice


def test_answers(spark, jobs):
    got = {r.request_id: r for r in answer_requests(requests(spark, ROWS), jobs, top_n=2).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    one = got[1]
    assert (one.profile_source, one.name, one.email, one.skills, one.message) == ("file", "Ada Lovelace", "ada@example.com", "Python, Sql", None)
    assert len(one.education) == K.SECTION_MAX_CHARS + 3 and one.education.endswith("...")
    assert [(j["rank"], j.job_id) for j in one.jobs] == [(1, 1), (2, 2)] and one.top_score == one.jobs[0].match_score
    assert one.advice_html and "<br>" in one.advice_html
    assert (got[2].profile_source, got[2].name, got[2].skills, got[2].experience, got[2].advice_html) == ("form", "Candidate", "python", "analyst", None)
    assert got[3].jobs[0].job_id == 3 and got[3].n_jobs == 2
    assert got[4].message == "Please either upload a resume or enter your skills" and got[4].jobs is None and got[4].n_jobs == 0
    assert got[5].message == K.TOO_LARGE_ERROR and got[6].message == "Resume parsing error: " + K.EMPTY_TEXT_ERROR
    assert got[7].profile_source == "file" and got[7].advice_html is None and got[7].n_jobs == 2


def test_no_jobs_and_no_requests(spark, jobs):
    none = answer_requests(requests(spark, ROWS[:1]), jobs.where("job_id = 4")).collect()
    assert [(r.message, r.n_jobs, r.top_score) for r in none] == [(NO_JOBS, 0, None)]
    assert with_job_lines(answer_requests(requests(spark, []), jobs)).count() == 0


def test_same_profile_as_in_parts(spark):
    got = {r.request_id: (r.profile_source, r.rejection) for r in resolved_requests(requests(spark, ROWS)).collect()}
    assert {i for i, (_, why) in got.items() if why} == {4, 5, 6}


def answered(spark, path):
    return sorted((r.batch, r.request_id, r.n_jobs) for r in spark.read.parquet(path).collect())


def test_stream_answers_each_request_once(spark, jobs, tmp_path):
    landing, answers, ckpt = (str(tmp_path / p) for p in ("landing", "answers", "ckpt"))
    os.makedirs(landing)
    table = [jobs.where("job_id <= 1")]

    def run():
        start_request_stream(spark, landing, answers, ckpt, lambda: table[0], files_per_batch=1).awaitTermination()

    requests(spark, ROWS[:2]).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert answered(spark, answers) == [(0, 1, 1), (0, 2, 1)]
    run()  # nothing new
    assert answered(spark, answers) == [(0, 1, 1), (0, 2, 1)]
    table[0] = jobs  # the job table has grown: later requests see it, answers given stay
    requests(spark, ROWS[2:4]).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert answered(spark, answers) == [(0, 1, 1), (0, 2, 1), (1, 3, 3), (1, 4, 0)]


def test_a_batch_that_runs_again_replaces_its_answers(spark, jobs, tmp_path):
    landing, answers, ckpt = (str(tmp_path / p) for p in ("landing", "answers", "ckpt"))
    requests(spark, ROWS[:3]).coalesce(1).write.parquet(landing)
    state = {"fail": True}

    def table():
        return jobs if not state["fail"] else jobs.withColumn("title", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception):
        start_request_stream(spark, landing, answers, ckpt, table).awaitTermination()
    state["fail"] = False
    start_request_stream(spark, landing, answers, ckpt, table).awaitTermination()
    assert answered(spark, answers) == [(0, 1, 3), (0, 2, 3), (0, 3, 3)]
    commit = next(f for f in sorted(os.listdir(ckpt + "/commits")) if f.isdigit())
    os.remove(f"{ckpt}/commits/{commit}")  # the batch was written, its commit was lost
    if os.path.exists(f"{ckpt}/commits/.{commit}.crc"):
        os.remove(f"{ckpt}/commits/.{commit}.crc")
    start_request_stream(spark, landing, answers, ckpt, table).awaitTermination()
    assert answered(spark, answers) == [(0, 1, 3), (0, 2, 3), (0, 3, 3)]


def test_uploads_as_bytes(spark, jobs, tmp_path):
    """Files of every format, in batch and by the stream; text goes before
    bytes, and files that are not admitted are not read."""
    form = ("gardener", "", "")
    rows = [(1, "cv.txt", None, None, *form, CV.encode()), (2, "cv.PDF", None, None, *form, FX.pdf_of(CV)),
            (3, "cv.docx", None, None, *form, FX.docx_of(CV)), (4, "cv.pdf", 9, None, *form, b"%PDF cut"),
            (5, "cv.pdf", 9, CV, *form, b"other"), (6, "cv.exe", 9, None, *form, CV.encode()),
            (7, "cv.pdf", 20_000_000, None, *form, FX.pdf_of(CV)), (8, "cv.pdf", None, None, *form, FX.pdf_of(" ")),
            (9, None, None, None, *form, None), (10, "cv.pdf", None, None, *form, None)]
    landed = spark.createDataFrame(rows, UPLOAD_SCHEMA)
    got = {r.request_id: r for r in answer_requests(landed, jobs, top_n=2).collect()}
    assert [got[i].name for i in (1, 2, 3, 5)] == ["Ada Lovelace"] * 4
    assert got[2].jobs == got[1].jobs == got[3].jobs and got[4].profile_source == "file"
    assert (got[6].profile_source, got[9].profile_source) == ("form", "form")
    assert got[7].message == K.TOO_LARGE_ERROR and got[8].message == "Resume parsing error: " + K.EMPTY_TEXT_ERROR
    assert sorted(got) == list(range(1, 11))
    landing, answers, ckpt = (os.path.join(str(tmp_path), p) for p in ("landing", "answers", "ckpt"))
    landed.write.parquet(landing)
    start_request_stream(spark, landing, answers, ckpt, lambda: jobs, top_n=2).awaitTermination()
    assert {r.request_id: r for r in spark.read.parquet(answers).drop("batch").collect()} == got
