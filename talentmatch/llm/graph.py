"""Connected components of a link table, by alternating star contractions.

Every step is joins and minimum aggregates over link rows: a hub with a third
of all links is pre-aggregated before the shuffle and its join is split by
the engine; no neighbourhood is gathered and nothing reaches the driver but
two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmatch.llm.common import written


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours tied to the smallest node around: all larger
    neighbours (large star), or the node and its smaller ones (small star)."""
    there = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if larger:
        there = there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = there.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = there.join(least, "u")
    if larger:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that
    the links ``a, b`` (longs) name, without the smallest nodes themselves."""
    now = written(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(state)
        now = written(_stars(_stars(now, True), False), "links")
