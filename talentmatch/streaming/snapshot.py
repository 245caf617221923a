"""Recurring re-ingest as Structured Streaming.

New job batches land as files in a folder.  A file-source stream with
``trigger(availableNow=True)`` picks up whatever landed since the last run
(progress is kept in the checkpoint under the shared checkpoint folder), and
``foreachBatch`` keeps the newest scrape date of the batch (several landings
can share one micro-batch), cleans it and writes it as that date's partition
of the snapshot table.  The snapshot is the newest partition: a landing of an
older date that comes late replaces nothing newer, and a write that fails
leaves the others as they were.  An empty batch writes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.operators.clean import clean_jobs
from talentmatch.session import scratch_path

CARD_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("card_no", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("date_scraped", T.DateType()),
])


def newest_landing(batch: DataFrame) -> DataFrame:
    """Rows of the newest ``date_scraped`` in the batch (global max as a
    one-row aggregate, broadcast back on the date)."""
    newest = batch.agg(F.max("date_scraped").alias("date_scraped"))
    return batch.join(F.broadcast(newest), "date_scraped")


def start_snapshot_stream(spark: SparkSession, landing: str, snapshot: str, checkpoint: str,
                          schema: T.StructType = CARD_SCHEMA):
    """Start the re-ingest; returns the StreamingQuery (await it)."""

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # partition folders of the landing add columns; keep the landed ones.
        # The batch's files are read twice (newest date, rows): cheaper than
        # keeping a whole landing in the executors' memory.
        landed = batch.select(*schema.fieldNames())
        newest = landed.agg(F.max("date_scraped")).first()[0]  # one row
        if newest is None:
            return
        (clean_jobs(landed.where(F.col("date_scraped") == F.lit(newest))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("date_scraped").parquet(snapshot))

    stream = spark.readStream.schema(schema).parquet(landing)
    return (stream.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    """The rows of the newest scrape date (partitions prune the rest)."""
    table = spark.read.parquet(snapshot)
    newest = table.agg(F.max("date_scraped").alias("date_scraped"))  # one row
    return table.join(F.broadcast(newest), "date_scraped").select(*CARD_SCHEMA.fieldNames(), "is_remote")


def run_snapshot_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the cards of the pages as two daily batches, run the re-ingest
    and return the snapshot it wrote."""
    from talentmatch.sources import fixtures as FX
    from talentmatch.sources.html_cards import extract_cards

    base = scratch_path(spark, "snapshot")
    landing, snapshot, ckpt = (os.path.join(base, p) for p in ("landing", "snapshot", "ckpt"))
    cards = extract_cards(FX.pages_jobs(spark, sf_dir))
    for day, parity in (("2025-08-16", 0), ("2025-08-17", 1)):
        (cards.where(F.col("page_id") % 2 == parity)
              .withColumn("date_scraped", F.to_date(F.lit(day)))
              .write.mode("append").parquet(os.path.join(landing, f"day={day}")))
    q = start_snapshot_stream(spark, landing, snapshot, ckpt)
    q.awaitTermination()
    return read_snapshot(spark, snapshot)
