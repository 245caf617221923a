"""Op 3 — exact top-k by integer inner product: a Voronoi kNN join.

Data and queries are grouped by their nearest pivot.  Summaries of the groups
(counts, largest distance and norm, the k + 1 smallest distances to the
pivot) give every query group a score that each of its queries is sure to
reach: for a row x at distance r from pivot p_j, and a query q at distance u
from pivot p_i,

    q.x >= p_i.p_j - u |p_j| - |q| r      and      q.x <= p_i.x + u |x|.

A data row is sent to a query group only if the right-hand bound reaches the
group's sure score.  Small query groups share a block and large ones are
split, data cells are split by id hash, so no task holds more than about
``BLOCK_QUERIES`` queries and ``BLOCK_ROWS`` rows; each pair of blocks gives
its own top k and a window merges them.

Edge cases: rows with a null id, a null vector or a null or non-finite
component take no part; repeated rows count once; shorter vectors are padded
with zeros; a query's own row is every row with its id; ties go to the
smaller id; fewer candidates give shorter lists; an empty table gives an
empty result; other columns are ignored.  A score beyond a long is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.llm import vectors as V
from talentmatch.llm.common import written

N_PIVOTS = 64
BLOCK_QUERIES = 2048
BLOCK_ROWS = 4096
CELLS = {"id": "long", "v": "binary", "cell": "int", "away": "double", "norm": "double"}
ROUTED = {"block": "long", "cell": "int", "part": "int", "id": "long", "v": "binary"}
DEALT = {"block": "long", "id": "long", "v": "binary"}


def whole(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``id, v array<long>``, each component floor(scale * x)."""
    rows = V.usable(df, id_col, vec_col)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)))


def in_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each row with its nearest pivot, the distance to it and its norm."""
    dim = pivots.shape[1]
    def assigned(batches):
        for b in batches:
            x = V.matrix(b.column("v"), dim)
            f = x.astype(np.float64)
            squares = (f * f).sum(1)
            gap = squares[:, None] - 2 * f @ pivots.T + (pivots * pivots).sum(1)
            cell = gap.argmin(1)
            away = np.sqrt(((f - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), V.packed(x), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt(squares))],
                names=list(CELLS))

    return df.mapInArrow(assigned, V.ddl(CELLS))


class Bounds:
    """Per query group: how far its queries reach, the score that each is sure
    to reach, and its blocks.  ``N_PIVOTS`` entries at most."""

    def __init__(self, pivots: np.ndarray, query_rows, data_rows, k: int, block_queries: int):
        m = len(pivots)
        self.pivots = pivots
        self.reach, self.count = np.zeros(m), np.zeros(m, np.int64)
        most = np.zeros(m)
        for r in query_rows:
            self.reach[r.cell], most[r.cell], self.count[r.cell] = r.away, r.norm, r.n
        cells = np.array([r.cell for r in data_rows], np.int64)
        nearest = np.array([r.away for r in data_rows])
        norms = np.sqrt((pivots * pivots).sum(1))
        self.sure = np.full(m, -np.inf)
        dots = pivots @ pivots.T
        for i in np.flatnonzero(self.count):
            if len(cells) > k:
                low = dots[i, cells] - self.reach[i] * norms[cells] - most[i] * nearest
                self.sure[i] = np.partition(low, len(low) - k - 1)[len(low) - k - 1]
        self._deal(dots, block_queries)

    def _deal(self, dots: np.ndarray, block_queries: int) -> None:
        """First block and number of blocks of each group; neighbours share."""
        self.first, self.blocks = np.zeros(len(self.count), np.int64), np.zeros(len(self.count), np.int64)
        left = set(np.flatnonzero(self.count).tolist())
        block, held, at = 0, 0, None
        while left:
            at = min(left) if at is None else max(left, key=lambda j: (dots[at, j], -j))
            left.remove(at)
            n = int(self.count[at])
            if held and held + n > block_queries:
                block, held = block + 1, 0
            self.first[at], self.blocks[at] = block, -(-n // block_queries)
            if self.blocks[at] > 1:
                block, held = block + int(self.blocks[at]), 0
            else:
                held += n
        self.active = np.flatnonzero(self.count)

    def wanted(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Whether each row may be among the best of each active group."""
        high = x @ self.pivots[self.active].T + norm[:, None] * self.reach[self.active]
        slack = 1e-9 * (1 + np.abs(high) + norm[:, None] * np.abs(self.pivots).max(initial=0) * x.shape[1])
        return high + slack >= self.sure[self.active]


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding", n_pivots: int = N_PIVOTS, block_queries: int = BLOCK_QUERIES,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows of ``data``."""
    asked = whole(queries, scale, id_col, vec_col)
    rows = V.first_copies(whole(data, scale, id_col, vec_col), k + 1)
    n, dim = V.shape(rows)
    dim = max(1, dim, V.shape(asked)[1])
    rows, asked = V.padded(rows, dim), V.padded(asked, dim)
    pivots = V.sample_vectors(rows, n_pivots) if n else np.zeros((1, dim))
    s, r = written(in_cells(rows, pivots), "knn-data"), written(in_cells(asked, pivots), "knn-queries")

    of_cell = F.row_number().over(V.Window.partitionBy("cell").orderBy("away"))
    nearest = s.select("cell", "away", of_cell.alias("nth")).where(F.col("nth") <= k + 1).collect()  # n_pivots * (k + 1) rows
    sizes = {x.cell: x.n for x in s.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # n_pivots rows
    groups = r.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.max("norm").alias("norm")).collect()
    bounds = Bounds(pivots, groups, nearest, k, block_queries)
    splits = {c: -(-m // block_rows) for c, m in sizes.items()}

    def routed(batches):
        for b in batches:
            x = V.unpacked(b.column("v").to_pylist(), dim, np.int64).astype(np.float64)
            ids = b.column("id").to_numpy()
            cell = b.column("cell").to_numpy()
            part = V.spread(ids, np.array([splits[c] for c in cell.tolist()], np.int64)).astype(np.int32)
            want = bounds.wanted(x, b.column("norm").to_numpy())
            at, block = [], []
            for g, wanted in zip(bounds.active, want.T):
                own = np.flatnonzero(wanted)
                for j in range(bounds.blocks[g]):
                    at.append(own)
                    block.append(np.full(len(own), bounds.first[g] + j))
            if not at:
                continue
            pairs = np.unique(np.stack([np.concatenate(block), np.concatenate(at)], 1), axis=0)
            take = pa.array(pairs[:, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), b.column("cell").take(take), pa.array(part).take(take), b.column("id").take(take),
                 b.column("v").take(take)], names=list(ROUTED))

    def dealt(batches):
        for b in batches:
            ids, cell = b.column("id").to_numpy(), b.column("cell").to_numpy()
            block = bounds.first[cell] + V.spread(ids, np.maximum(1, bounds.blocks[cell]))
            yield pa.RecordBatch.from_arrays([pa.array(block), b.column("id"), b.column("v")], names=list(DEALT))

    rows_by_block = s.mapInArrow(routed, V.ddl(ROUTED))
    used = rows_by_block.select(*[F.col(c).alias(c) for c in ("block", "cell", "part")]).distinct()  # parts with rows for a block
    asked_by_block = r.mapInArrow(dealt, V.ddl(DEALT)).join(used, "block")

    def solved(_, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        x = x.sort_values("id", ignore_index=True)
        a, b = V.unpacked(q["v"], dim, np.int64), V.unpacked(x["v"], dim, np.int64)
        return block_best(q["id"].to_numpy(), a, x["id"].to_numpy(), b, k)

    keys = ["block", "cell", "part"]
    found = asked_by_block.groupBy(*keys).cogroup(rows_by_block.groupBy(*keys)).applyInPandas(solved, V.FOUND[T.LongType])
    return V.best(found, k, [F.desc("score"), F.asc("vec_id")])


def block_best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best of a block for each query, rows sorted by id."""
    largest = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, x.shape[1])
    if largest < 2 ** 53:  # every product and sum is a whole double
        scores = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    else:
        scores = q.astype(object) @ x.astype(object).T
    own = query_ids[:, None] == ids[None, :]
    n, m = scores.shape
    if largest * m < 2 ** 61:  # score and place in one number: no ties, larger is better
        key = scores.astype(np.int64) * m + np.arange(m - 1, -1, -1)
        key[own] = -(2 ** 62)
        top = np.argpartition(-key, min(k, m) - 1, axis=1)[:, :k]
    else:
        top = np.argsort(np.where(own, math.inf, -scores), axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(n), top.shape[1])
    col = top.ravel()
    keep = ~own[row, col]
    row, col = row[keep], col[keep]
    return pd.DataFrame({"query_id": query_ids[row], "vec_id": ids[col], "score": scores[row, col].astype(np.int64)})
