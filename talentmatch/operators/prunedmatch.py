"""Exact dense top-k with the right side grouped around pivots.

The plain matcher sends every left row to every right block.  Here right rows
go to the cell of their nearest pivot, and one row per cell (count, radius)
tells what a cell can hold: for a left direction l and a right direction x of
the cell around p,

    l.p - |l| radius  <=  l.x  <=  l.p + |l| radius.

The cells with the largest lower bounds that together hold k rows give each
left row a score it is sure to reach; it is scored only in cells whose upper
bound reaches that.  Blocks of left rows meet blocks of a cell's rows as in
:mod:`blockmatch`, and in each pair only the left rows that want the cell are
scored, so no row is copied for the cells it meets.  Scores, rounding and ties
are those of :mod:`blockmatch`, so the rows are the same.

Pivots (``n_pivots`` vectors) and the summary (``n_pivots`` rows) are read by
the driver while the query is built; cells are split by id hash into groups of
about ``block_rows``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.operators.blockmatch import UNITS, DenseBlock, _Dense, block_pairs, one_of_equals, packed, ranked, scored_pairs

_SLACK = 4.0 / UNITS


def wanted_cells(left: np.ndarray, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Whether each left direction has to look into each cell."""
    at = left @ pivots.T
    reach = np.sqrt((left * left).sum(axis=1))[:, None] * radius
    low, high = at - reach, at + reach
    order = np.argsort(-low, axis=1, kind="stable")
    held = np.cumsum(count[order], axis=1)
    enough = np.minimum((held < k).sum(axis=1), len(count) - 1)
    sure = np.take_along_axis(low, order, axis=1)[np.arange(len(left)), enough]
    sure = np.where(held[:, -1] >= k, sure, -np.inf)
    return (high + _SLACK >= sure[:, None]) & (count > 0)


def pruned_topk_cosine(left: DataFrame, right: DataFrame, k: int, *, left_id: str = "left_id",
                       right_id: str = "right_id", n_pivots: int = 64, block_rows: int = 2048,
                       partitions: int | None = None) -> DataFrame:
    """``(left_id, right_id, score, rank)``, as ``blockmatch.topk_cosine``
    gives for dense vectors ``vec``."""
    spark = left.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lefts = left.select(F.col(left_id).alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rights = right.select(F.col(right_id).alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    sample = rights.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()  # n_pivots rows
    dim = int(rights.agg(F.max(F.size("vec"))).first()[0] or 0)
    left_dim = int(lefts.agg(F.max(F.size("vec"))).first()[0] or 0)
    dim = max(dim, left_dim, 1)
    pivots = _Dense(sample, dim).m if len(sample) else np.zeros((1, dim))
    id_type = rights.schema["id"].dataType.simpleString()

    def to_cells(frames):
        for f in frames:
            m = _Dense(f, dim).m
            cell = (m @ pivots.T).argmax(axis=1)
            yield f.assign(cell=cell, away=np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1)))

    celled = rights.mapInPandas(to_cells, f"id {id_type}, vec array<double>, cell long, away double")
    radius, count = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in celled.groupBy("cell").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect():  # n_pivots rows
        radius[r.cell], count[r.cell] = r.away, r.n
    parts = np.maximum(1, -(-count // block_rows))

    def wants(left: pa.Table, table: pa.Table, right, own) -> np.ndarray:
        if own.wanted is None:
            own.wanted = wanted_cells(_Dense(left, dim).m, pivots, radius, count, k)
        return own.wanted[:, table["cell"][0].as_py()]

    part_of = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell").cast("int") + 1))
    held = celled.select("id", "vec", "cell", part_of.cast("long").alias("part")).repartition(partitions, "cell", "part")
    own = lefts.withColumnRenamed("id", "left_id")
    alike = one_of_equals(own, ["vec"])
    pairs = block_pairs(packed(alike.withColumnRenamed("first_id", "id"), max(1, block_rows // 2), "l"),
                        packed(held, block_rows, "r", by=("cell", "part")), partitions)
    schema = T.StructType([T.StructField("id", lefts.schema["id"].dataType), T.StructField("mark", T.LongType()),
                           T.StructField("right_id", rights.schema["id"].dataType), T.StructField("units", T.LongType())])
    return ranked(scored_pairs(pairs, DenseBlock, k, schema, wants), own, alike, ["vec"], k, left_id, right_id)
