"""Registered queries of trained models, which SQL cannot express: they are
tested against the same computation in numpy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentmatch.operators.encoder import match_semantic
from talentmatch.operators.parse import parse_resumes
from talentmatch.plans.queries import job_texts, resume_texts
from talentmatch.sources import fixtures as FX


def match_topk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 and D5 from texts: an encoder trained on the jobs, then the dense
    matcher."""
    resumes = resume_texts(parse_resumes(FX.resumes_raw(spark, sf_dir)))
    return match_semantic(resumes, job_texts(spark, sf_dir)).select("resume_id", "job_id", "rank", "match_score")


TRAINED: dict[str, Callable[[SparkSession, str], DataFrame]] = {"match_topk_semantic": match_topk_semantic}
