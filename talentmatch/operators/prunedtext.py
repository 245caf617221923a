"""Exact sparse top-k with jobs in blocks and upper bounds per block.

The plain matcher scores every left row against every right block.  Here right
rows that share their leading term share a block - the term that tends to add
most to a score, by its weight in the row and its mean weight in left rows that
have it - and the largest weight of each term in a block bounds what a left row
can score there:

    score(l, x)  <=  sum over terms of  w_l(term) * max weight(term, block).

A block's maxima are themselves a sparse row, so the block of a left row's
highest bound is its best match among them.  A left row is first scored in that
block; the k-th best score there is one it is sure to reach.  Then blocks of
left rows meet blocks of right rows as in :mod:`blockmatch`, and in each pair
only the left rows whose bound reaches what they are sure of are scored.  Rows
go once to their first block and once to the pairs: nothing that grows with the
pairs of rows and blocks is shuffled or written.  Scores, rounding and ties are
those of :mod:`blockmatch`, and so are the rows.

A left row that meets fewer than k jobs with a common term is filled up with
the lowest right ids at score 0, as when every pair is scored.

While the query is built the driver reads bucket counts (``MOST_BUCKETS`` rows
at most); blocks and first scores are written to the shared checkpoint folder.
Hot blocks are split by id hash on both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.operators.blockmatch import (UNITS, SparseBlock, _Sparse, block_pairs, one_of_equals, packed, ranked,
                                              scored_block, scored_pairs)
from talentmatch.session import written as _written

MOST_BUCKETS = 4096
_SLACK = 2.0 / UNITS


def _entries(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per entry: ``code, w`` and the kept columns."""
    e = F.explode(F.arrays_zip(F.col("codes").alias("code"), F.col("weights").alias("w")))
    return rows.select(*keep, e.alias("e")).select(*keep, "e.code", "e.w")


def in_blocks(lefts: DataFrame, rights: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """``id, codes, weights, block`` and the number of blocks: rows go to
    buckets by their leading term, large buckets are split by id hash.  Rows
    without a term of any left row share the bucket of no term."""
    n = rights.count()
    buckets = int(np.clip(-(-2 * n // block_rows), 1, MOST_BUCKETS))
    demand = _entries(lefts).groupBy("code").agg(F.avg("w").alias("mean"))
    leads = _entries(rights, "id").join(demand, "code").groupBy("id").agg(
        F.max(F.struct((F.col("w") * F.col("mean")).alias("adds"), "code"))["code"].alias("lead"))
    rows = rights.join(leads, "id", "left").withColumn("bucket", F.pmod(F.xxhash64("lead"), F.lit(buckets)).cast("int")).drop("lead")
    rows = _written(rows, "pruned-buckets")
    count = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # MOST_BUCKETS rows
        count[r.bucket] = r.n
    parts = np.maximum(1, -(-count // block_rows))
    first = np.cumsum(parts) - parts

    layout = rights.sparkSession.createDataFrame(
        [(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts))], "bucket int, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    rows = rows.join(F.broadcast(layout), "bucket")  # MOST_BUCKETS rows
    return rows.select(*rights.columns, block.alias("block")), int(parts.sum())


def scored(pairs: DataFrame, lefts: DataFrame, rights: DataFrame, k: int, left_rows: int, partitions: int) -> DataFrame:
    """``id, mark, right_id, units``: the k best of each left row ``(id, mark)`` in its block."""
    asked = pairs.join(lefts.withColumnsRenamed({"id": "own_id", "mark": "own_mark"}),
                       F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))).select("id", "mark", "codes", "weights", "block")
    sizes = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / left_rows).alias("parts"))
    keys = ["block", "part"]
    asked = asked.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("id", "mark"), F.col("parts"))).drop("parts")
    held = rights.join(sizes, "block").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        name = left.select(["id", "mark"])
        found = scored_block(SparseBlock, left.drop_columns(["id"]).append_column("id", pa.array(np.arange(len(left)))), right, k)
        own = name.take(found["left_id"])
        return pa.table({"id": own["id"], "mark": own["mark"], "right_id": found["right_id"], "units": found["units"]})

    return (asked.repartition(partitions, *keys).groupBy(*keys)
            .cogroup(held.repartition(partitions, *keys).groupBy(*keys)).applyInArrow(best, _schema(lefts, rights.schema["id"].dataType)))


def _schema(lefts: DataFrame, right_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", lefts.schema["id"].dataType), T.StructField("mark", T.LongType()),
                         T.StructField("right_id", right_type), T.StructField("units", T.LongType())])


def may_score(left: pa.Table, table: pa.Table, right, own) -> np.ndarray:
    """Left rows whose bound in a right block reaches what they are sure of;
    not those that were scored there first."""
    most = np.maximum.reduceat(right.post_weight, right.post_start[:-1]) if len(right.vocabulary) else np.zeros(0)
    l = _Sparse(left)
    at = np.searchsorted(right.vocabulary, l.code)
    known = at < len(right.vocabulary)
    known[known] = right.vocabulary[at[known]] == l.code[known]
    bound = np.bincount(l.row[known], l.weight[known] * most[at[known]], len(left))
    sure = np.maximum(left["sure"].to_numpy(), own.reached)
    first = left["block"].to_numpy() == table["block"][0].as_py()
    return ~first & (bound > 0) & (bound + _SLACK >= sure)


def pruned_topk_sparse(left: DataFrame, right: DataFrame, k: int, *, left_id: str = "left_id", right_id: str = "right_id",
                       block_rows: int = 2048, partitions: int | None = None, many_blocks: int | None = None) -> DataFrame:
    """``(left_id, right_id, score, rank)``, as ``blockmatch.topk_cosine``
    gives for sparse rows.  ``many_blocks`` is kept for callers: terms of many
    blocks need no treatment of their own any more."""
    partitions = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["codes", "weights"]
    own = _written(left.select(F.col(left_id).alias("left_id"), *cols), "pruned-left")
    alike = _written(one_of_equals(own, cols), "pruned-alike")
    lefts = alike.withColumnRenamed("first_id", "id")
    rights = _written(right.select(F.col(right_id).alias("id"), *cols), "pruned-right")
    rights, n_blocks = in_blocks(lefts, rights, block_rows)
    rights = _written(rights, "pruned-blocks")
    half = max(1, block_rows // 2)

    # first the block of the highest bound: the best match among rows of maxima
    asked_codes = _entries(lefts).select("code").distinct()
    entry = F.struct("code", "most")
    summary = (_entries(rights, "block").join(asked_codes, "code", "left_semi").groupBy("code", "block").agg(F.max("w").alias("most"))
               .groupBy(F.col("block").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("e"))  # a block's own terms
               .select("id", F.col("e.code").alias("codes"), F.col("e.most").alias("weights")))
    bounds = scored_pairs(block_pairs(packed(lefts, half, "l"), packed(summary, 256, "r"), partitions), SparseBlock, 1,
                          _schema(lefts, summary.schema["id"].dataType))
    best_block = _written(bounds.groupBy("id", "mark").agg(F.max_by("right_id", F.struct("units", "right_id")).alias("block")), "pruned-first")
    head = _written(scored(best_block, lefts, rights, k, block_rows, partitions), "pruned-head")
    sure = head.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n"), F.min("units").alias("units"))
    sure = sure.select("id", "mark", F.when(F.col("n") >= k, F.col("units") / UNITS).otherwise(F.lit(0.0)).alias("sure"))
    knows = best_block.alias("b").join(sure.alias("s"), F.col("b.id").eqNullSafe(F.col("s.id")) & (F.col("b.mark") == F.col("s.mark")), "left")
    knows = knows.select(F.col("b.id").alias("own_id"), F.col("b.mark").alias("own_mark"), "block", "sure")
    told = lefts.join(knows, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left").select(
        "id", "mark", *cols, F.coalesce("sure", F.lit(0.0)).alias("sure"), F.coalesce("block", F.lit(-1).cast("long")).alias("block"))
    pairs = block_pairs(packed(told, half, "l"), packed(rights.repartition(partitions, "block"), block_rows, "r", by=("block",)), partitions)
    found = head.unionByName(scored_pairs(pairs, SparseBlock, k, _schema(lefts, rights.schema["id"].dataType), may_score))

    # the lowest ids at score 0: k rows for rows that nothing else fills
    lowest = rights.select(F.col("id").alias("right_id")).orderBy("id").limit(k).agg(F.collect_list("right_id").alias("ids"))
    found = _written(found, "pruned-found")
    filled = found.groupBy(F.col("id").alias("own_id"), F.col("mark").alias("own_mark")).agg(F.sum((F.col("units") > 0).cast("int")).alias("over"))
    short = lefts.join(filled, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left").where(
        F.coalesce("over", F.lit(0)) < k).select("id", "mark")
    pads = short.join(F.broadcast(lowest)).select("id", "mark", F.explode("ids").alias("right_id"), F.lit(0).cast("long").alias("units"))  # one row
    best = found.unionByName(pads).groupBy("id", "mark", "right_id").agg(F.max("units").alias("units"))
    return ranked(best, own, alike, cols, k, left_id, right_id)
