"""Requests as a stream: landed request files in, answers out.

A file-source stream picks up requests as they land; each micro-batch is
resolved once, matched against the job table as it stands at that time (the
snapshot of :mod:`snapshot` grows between batches), and written as the
partition of its batch number.  Uploads land as text or as bytes.  A batch that is run again after a failure
replaces its own partition, so every request is answered once.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.plans.requests import UPLOAD_SCHEMA, answer_profiles, resolved_requests
from talentmatch.session import dealt, scratch_path


def start_request_stream(spark: SparkSession, landing: str, answers: str, checkpoint: str, jobs: Callable[[], DataFrame],
                         top_n: int = K.DEFAULT_TOP_N, files_per_batch: int | None = None):
    """Answer what has landed since the last run; returns the StreamingQuery.

    ``jobs`` gives the job table (job_id, title, company, location, link) and
    is called once a batch; ``files_per_batch`` bounds a batch."""
    def answer_batch(batch: DataFrame, epoch_id: int) -> None:
        # a batch may be one file of one split: dealt out before it is parsed.
        # Persisted for its two reads (matching, answers); a lost executor
        # reads the batch's files again
        resolved = resolved_requests(dealt(batch.select(*UPLOAD_SCHEMA.fieldNames()))).persist()
        try:
            (answer_profiles(resolved, jobs(), top_n).withColumn("batch", F.lit(epoch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(answers))
        finally:
            resolved.unpersist()

    reader = spark.readStream.schema(UPLOAD_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.parquet(landing).writeStream.foreachBatch(answer_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_requests(spark: SparkSession, requests: DataFrame, jobs: DataFrame, batches: int = 2) -> DataFrame:
    """Land ``requests`` as so many files, answer them by the stream and
    return what it wrote."""
    base = scratch_path(spark, "requests")
    landing, answers, ckpt = (os.path.join(base, p) for p in ("landing", "answers", "ckpt"))
    requests.repartition(batches, "request_id").write.parquet(landing)
    start_request_stream(spark, landing, answers, ckpt, lambda: jobs, files_per_batch=1).awaitTermination()
    return spark.read.parquet(answers).drop("batch")
