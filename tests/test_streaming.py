"""The re-ingest stream keeps the newest landing and skips empty runs."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from talentmatch.streaming.snapshot import CARD_SCHEMA, read_snapshot, start_snapshot_stream


def _landing_rows(spark, day, titles):
    rows = [(i, 0, t, "Acme", "Remote " if i % 2 else "City", f"https://j/{i}", "LinkedIn", None)
            for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, CARD_SCHEMA).withColumn("date_scraped", F.to_date(F.lit(day)))


def test_snapshot_stream(spark, tmp_path):
    landing, snap, ckpt = (str(tmp_path / p) for p in ("landing", "snap", "ckpt"))
    os.makedirs(landing)
    _landing_rows(spark, "2025-08-16", ["Old A", "Old B"]).write.parquet(landing + "/d1")
    _landing_rows(spark, "2025-08-17", [" New A", "NEW B", "new c"]).write.parquet(landing + "/d2")
    # the two folders are not partition folders: read the files directly
    q = start_snapshot_stream(spark, landing + "/*", snap, ckpt)
    q.awaitTermination()
    got = read_snapshot(spark, snap)
    assert sorted(r.title for r in got.collect()) == ["new a", "new b", "new c"]
    assert {r.is_remote for r in got.where("page_id % 2 = 1").collect()} == {1}
    # a run with nothing new leaves the snapshot as it was
    q = start_snapshot_stream(spark, landing + "/*", snap, ckpt)
    q.awaitTermination()
    assert read_snapshot(spark, snap).count() == 3
    # a later landing replaces it
    _landing_rows(spark, "2025-08-18", ["Next"]).write.parquet(landing + "/d3")
    q = start_snapshot_stream(spark, landing + "/*", snap, ckpt)
    q.awaitTermination()
    assert [r.title for r in read_snapshot(spark, snap).collect()] == ["next"]
    # an older landing that comes late replaces nothing
    _landing_rows(spark, "2025-08-16", ["Late"]).write.parquet(landing + "/d4")
    q = start_snapshot_stream(spark, landing + "/*", snap, ckpt)
    q.awaitTermination()
    assert [r.title for r in read_snapshot(spark, snap).collect()] == ["next"]
    # the same date again replaces its rows
    _landing_rows(spark, "2025-08-18", ["Next 2", "Next 3"]).write.parquet(landing + "/d5")
    q = start_snapshot_stream(spark, landing + "/*", snap, ckpt)
    q.awaitTermination()
    assert sorted(r.title for r in read_snapshot(spark, snap).collect()) == ["next 2", "next 3"]
