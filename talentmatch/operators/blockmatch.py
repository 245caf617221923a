"""Exact top-k cosine matching of every left row against every right row.

All-pairs scoring is quadratic by nature; this operator materialises neither
the pairs nor copies of the rows.  Either side is packed into blocks of about
``block_rows`` rows (half as many left ones), a block being one row of Arrow
bytes, and the blocks are dealt out once.  A scoring task takes one partition
of left blocks and streams one of ``_RIGHT_PARTS`` partitions of right blocks
past it (Spark's Cartesian product of the two), so what is shuffled grows with
the rows and not with the pairs.  One pair of blocks computes its scores with
numpy in bounded chunks; the task keeps the k best of each left row, and a
``row_number() <= k`` window merges those of the ``_RIGHT_PARTS`` tasks.  Left
rows of equal vectors have equal scores: one of them is scored, and its matches
are joined back to all.  Nothing runs while the query is being built.

Vectors are dense (``vec: array<float|double>``) or sparse (parallel
``codes: array<long>`` / ``weights: array<double>``, L2-normalised).  Scores
are cosine similarity.  A vector without a direction - null, empty, zero, or
with a null, NaN or infinite component - scores 0 against everything; shorter
dense vectors count missing components as 0.

One rounding rule decides, in a block and between blocks: the score in whole
millionths, halves away from zero.  Products of whole blocks only select
candidates; a candidate's score is summed component by component in a fixed
order, so it does not depend on the layout.  Ties go to the lower right id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = 1_000_000
#: Two products of one pair differ by less than this; rounding by half a unit.
_SLACK = 2.0 / UNITS
_LEFT_CHUNK = 256       # left rows scored at a time
_CELLS = 1 << 24        # cells of a dense helper matrix
_PAIRS = 1 << 16        # candidates summed at a time
_GROUPS = 64            # column groups whose maxima are compared
_RIGHT_PARTS = 4        # tasks that share the right blocks of a left partition


def units(scores: np.ndarray) -> np.ndarray:
    """Whole millionths, halves away from zero."""
    return (np.sign(scores) * np.floor(np.abs(scores) * UNITS + 0.5)).astype(np.int64)


def _lists(column, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined values of a column of lists (Arrow or pandas); a
    null list is empty, a null value not a number."""
    if isinstance(column, pd.Series):
        column = pa.array(column.tolist(), pa.list_(kind))
    elif isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return sizes.astype(np.int64), column.flatten().cast(kind).to_numpy(zero_copy_only=False)


class _Dense:
    """Directions of one side; ``pair`` sums left to right, so trailing zeros
    and the other rows of a block change nothing."""

    def __init__(self, frame, dim: int | None = None):
        sizes, values = _lists(frame["vec"], pa.float64())
        dim = int(sizes.max(initial=0)) if dim is None else dim
        m = np.zeros((len(sizes), dim))
        first = np.cumsum(sizes) - sizes
        m[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(first, sizes)] = values
        m[~np.isfinite(m).all(axis=1)] = 0
        largest = np.abs(m).max(axis=1, initial=0)
        m /= np.where(largest > 0, largest, 1)[:, None]
        norm = np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) if dim else np.zeros(len(m))
        self.m = m / np.where(norm > 0, norm, 1)[:, None]

    def __len__(self):
        return len(self.m)


class DenseBlock:
    """A left table against a right one, which ``prepared`` may have read."""

    prepared, repeats = _Dense, False

    def __init__(self, left, right):
        self.left, self.right = _Dense(left), right if isinstance(right, _Dense) else _Dense(right)
        self.dim = min(self.left.m.shape[1], self.right.m.shape[1])

    def rough(self, a: int, b: int) -> np.ndarray:
        return self.left.m[a:b, :self.dim] @ self.right.m[:, :self.dim].T

    def pair(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        both = self.left.m[rows, :self.dim] * self.right.m[cols, :self.dim]
        return np.cumsum(both, axis=1)[:, -1] if both.shape[1] else np.zeros(len(rows))


class _Sparse:
    """Entries of one side by row, codes ascending within a row."""

    def __init__(self, frame):
        self.size, self.code = _lists(frame["codes"], pa.int64())
        self.weight = _lists(frame["weights"], pa.float64())[1]
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        order = np.lexsort((self.code, self.row))
        self.code, self.weight = self.code[order], self.weight[order]
        self.end = np.cumsum(self.size)
        self.repeats = bool(((np.diff(self.code) == 0) & (np.diff(self.row) == 0)).any())


class _Postings(_Sparse):
    """Right rows with their entries by term."""

    def __init__(self, frame):
        super().__init__(frame)
        self.vocabulary = np.unique(self.code)
        self.col = np.searchsorted(self.vocabulary, self.code)
        by_col = np.argsort(self.col, kind="stable")
        self.post_row, self.post_weight = self.row[by_col], self.weight[by_col]
        self.post_start = np.searchsorted(self.col[by_col], np.arange(len(self.vocabulary) + 1))
        # (row, column) of every entry as one sorted number
        self.key = self.row * max(1, len(self.vocabulary)) + self.col


class SparseBlock:
    """A left table against a right one, which ``prepared`` may have read.
    Rough scores: the vocabulary of the right rows is cut into column groups
    so that no helper matrix passes ``_CELLS`` cells."""

    prepared = _Postings

    def __init__(self, left, right):
        self.l, self.r = _Sparse(left), right if isinstance(right, _Postings) else _Postings(right)
        self.vocabulary, self.r_key = self.r.vocabulary, self.r.key
        self.repeats = self.l.repeats or self.r.repeats  # a term twice in a row: rough scores are below the summed ones
        at = np.searchsorted(self.vocabulary, self.l.code)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == self.l.code[known]
        self.l_col = np.where(known, at, -1)

    def rough(self, a: int, b: int) -> np.ndarray:
        n_r = len(self.r.size)
        out = np.zeros((b - a, n_r))
        lo, hi = (self.l.end[a - 1] if a else 0), (self.l.end[b - 1] if b else 0)
        rows, cols, weights = self.l.row[lo:hi] - a, self.l_col[lo:hi], self.l.weight[lo:hi]
        rows, cols, weights = rows[cols >= 0], cols[cols >= 0], weights[cols >= 0]
        used, place = np.unique(cols, return_inverse=True)
        step = max(1, _CELLS // max(1, n_r))
        for at in range(0, len(used), step):
            own = used[at:at + step]
            here = (place >= at) & (place < at + step)
            left = np.zeros((b - a, len(own)))
            left[rows[here], place[here] - at] = weights[here]
            right = np.zeros((n_r, len(own)))
            counts = self.r.post_start[own + 1] - self.r.post_start[own]
            entry = np.repeat(self.r.post_start[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            right[self.r.post_row[entry], np.repeat(np.arange(len(own)), counts)] = self.r.post_weight[entry]
            out += left @ right.T
        return out

    def pair(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        sizes = self.l.size[rows]
        entry = np.repeat(self.l.end[rows] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        owner = np.repeat(np.arange(len(rows)), sizes)
        key = cols[owner] * max(1, len(self.vocabulary)) + self.l_col[entry]
        at = np.minimum(np.searchsorted(self.r_key, key), max(0, len(self.r_key) - 1))
        hit = (self.l_col[entry] >= 0) & (self.r_key[at] == key) if len(self.r_key) else np.zeros(len(key), bool)
        return np.bincount(owner[hit], self.l.weight[entry[hit]] * self.r.weight[at[hit]], len(rows))


def least_best(rough: np.ndarray, k: int) -> np.ndarray:
    """A value that each row's ``k`` best columns are sure to reach: the k-th
    largest of the maxima of many column groups (a full selection of the k-th
    best reads every cell several times)."""
    n, m = rough.shape
    groups = max(_GROUPS, 8 * k)
    if m >= 2 * groups:
        whole = m - m % groups
        rough = rough[:, :whole].reshape(n, whole // groups, groups).max(axis=1)
        m = groups
    return np.partition(rough, m - k, axis=1)[:, m - k]


def block_topk(block, n_left: int, n_right: int, k: int, reached: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right places and scores in millionths of each left row's ``k``
    best, right rows being in id order.  ``reached`` is a score that k other
    right rows reach already (minus infinity where none is known): what lies
    below it may be left out."""
    k = min(k, n_right)
    found = []
    for a in range(0, n_left, _LEFT_CHUNK):
        b = min(n_left, a + _LEFT_CHUNK)
        rough = block.rough(a, b)
        if reached is None or not np.isfinite(reached[a:b]).all():
            least = least_best(rough, k) - _SLACK
        else:
            least = reached[a:b] - _SLACK
        maybe = rough >= least[:, None]
        low = np.flatnonzero(least <= 0)
        if len(low):  # pairs without a common direction: only the first k can count
            zero = maybe[low] & (rough[low] == 0)
            maybe[low] &= ~zero | (np.cumsum(zero, axis=1) <= k)
        rows, cols = np.divmod(np.flatnonzero(maybe), n_right)
        score = np.zeros(len(rows), np.int64)
        for at in range(0, len(rows), _PAIRS):
            part = slice(at, at + _PAIRS)
            score[part] = units(np.clip(block.pair(rows[part] + a, cols[part]), -1, 1))
        order = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        found.append((rows[keep] + a, cols[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def scored_block(make, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """``left_id, right_id, units`` of the k best right rows of each left row
    of one group; lists go from Arrow to numpy as they are."""
    if not len(left) or not len(right):
        at, to, units = (np.zeros(0, np.int64) for _ in range(3))
    else:
        right = right.sort_by("id")
        at, to, units = block_topk(make(left, right), len(left), len(right), k)
    return pa.table({"left_id": left["id"].take(pa.array(at)), "right_id": right["id"].take(pa.array(to)), "units": pa.array(units)})


def to_bytes(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def from_bytes(data: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def packed(df: DataFrame, rows: int, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``<name>, <name>_rows``: the rows of ``df`` in id order as blocks of
    at most ``rows``, one row of bytes each; a block does not cross partitions
    and holds one value of the ``by`` columns, whose rows share a partition."""
    def pack(batches):
        number = (TaskContext.get().partitionId() << 32) - 1
        held, n, last = [], 0, None
        for batch in batches:
            ends = [batch.num_rows]
            if by and batch.num_rows:
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by], axis=1)
                ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            at = 0
            for end in ends:
                key = tuple(keys[at].tolist()) if by and at < end else None
                if n and key != last:
                    number += 1
                    yield block(number, held)
                    held, n = [], 0
                last = key
                while at < end:
                    part = batch.slice(at, min(end - at, rows - n))
                    at += part.num_rows
                    held.append(part)
                    n += part.num_rows
                    if n == rows:
                        number += 1
                        yield block(number, held)
                        held, n = [], 0
        if n:
            yield block(number + 1, held)

    def block(number, held):
        return pa.RecordBatch.from_pydict({name: pa.array([number], pa.int64()), f"{name}_rows": pa.array(
            [to_bytes(pa.Table.from_batches(held).combine_chunks())], pa.binary())})

    # in id order, so that a task that runs again cuts the same blocks
    return df.sortWithinPartitions(*by, "id").mapInArrow(pack, f"{name} long, {name}_rows binary")


def by_block(df: DataFrame, rows: DataFrame, block_rows: int = 2048, partitions: int | None = None) -> DataFrame:
    """``df(id, ...)`` with a ``block`` by the id's hash, partitioned by it;
    ``rows`` is counted for the number of blocks."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"))
    layout = F.broadcast(n.select(F.ceil(F.col("n") / block_rows).alias("blocks")))  # one row
    return df.crossJoin(layout).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks").repartition(partitions, "block")


def block_pairs(lefts: DataFrame, rights: DataFrame, partitions: int) -> DataFrame:
    """Every right block beside every left block of a task, right ones first.
    Only the left blocks of a task (one partition of them) are held at once."""
    return (rights.repartition(_RIGHT_PARTS, rights.columns[0]).hint("shuffle_replicate_nl")
            .crossJoin(lefts.repartition(partitions, lefts.columns[0])))


class Best:
    """The k best right rows so far of each row of a left block."""

    def __init__(self, left: pa.Table, k: int):
        self.left, self.k, self.wanted = left, k, None
        self.reached = np.full(len(left), -np.inf)
        self.rows = None

    def add(self, at: np.ndarray, right_ids, score: np.ndarray) -> None:
        if not len(at):
            return
        new = pa.table({"at": pa.array(at, pa.int64()), "right_id": right_ids, "units": pa.array(score, pa.int64())})
        rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        rows = rows.sort_by([("at", "ascending"), ("units", "descending"), ("right_id", "ascending")])
        at = rows["at"].to_numpy()
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        self.rows = rows.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        self.reached[at[last]] = rows["units"].to_numpy()[last] / UNITS

    def table(self, names: list[str]) -> pa.Table:
        at = self.rows["at"]
        return pa.table({n: self.left[n].take(at) for n in names} | {"right_id": self.rows["right_id"], "units": self.rows["units"]})


def scored_pairs(pairs: DataFrame, make, k: int, schema: T.StructType, asks=None) -> DataFrame:
    """The k best right rows of each left row within a task of
    :func:`block_pairs`; ``schema`` names left columns, ``right_id, units``.
    ``asks(left table, right table, prepared right, Best)`` tells which left
    rows have to meet a right block; without it all do."""
    names = schema.fieldNames()[:-2]

    def best(batches):
        held, number, right, ids = {}, None, None, None
        for batch in batches:
            for r, r_rows, l, l_rows in zip(*batch.columns):
                if number != r.as_py():
                    number, table = r.as_py(), from_bytes(r_rows)
                    table = table.sort_by("id")
                    right, ids = make.prepared(table), table["id"]
                left = from_bytes(l_rows)
                own = held.get(l.as_py())
                if own is None:
                    own = held[l.as_py()] = Best(left.select(names), k)
                met, reached = None, own.reached
                if asks:
                    met = np.flatnonzero(asks(left, table, right, own))
                    if not len(met):
                        continue
                    left, reached = left.take(pa.array(met)), reached[met]
                block = make(left, right)
                at, to, score = block_topk(block, len(left), len(ids), k, None if block.repeats else reached)
                own.add(at if met is None else met[at], ids.take(pa.array(to)), score)
        for own in held.values():
            if own.rows is not None:
                yield from own.table(names).to_batches()

    return pairs.mapInArrow(best, schema)


def topk_cosine(left: DataFrame, right: DataFrame, k: int, *, kind: str = "dense",
                left_id: str = "left_id", right_id: str = "right_id", block_rows: int = 2048,
                partitions: int | None = None) -> DataFrame:
    """``(left_id, right_id, score, rank)`` for the k best right rows of
    every left row.

    Ids are keys (unique and not null per side) of any orderable type.
    Right rows are packed where they are, or by a column ``block`` where they
    have one (:func:`by_block`), and their blocks shuffled.
    ``partitions`` is the number of partitions of left blocks."""
    make, cols = {"dense": (DenseBlock, ["vec"]), "sparse": (SparseBlock, ["codes", "weights"])}[kind]
    partitions = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = left.select(F.col(left_id).alias("left_id"), *cols)
    alike = one_of_equals(own, cols)
    lefts = packed(alike.withColumnRenamed("first_id", "id"), max(1, block_rows // 2), "l")
    by = [c for c in ("block",) if c in right.columns]
    rights = packed(right.select(F.col(right_id).alias("id"), *cols, *by), 2 * block_rows, "r", by=tuple(by))
    schema = T.StructType([T.StructField("id", left.schema[left_id].dataType), T.StructField("mark", T.LongType()),
                           T.StructField("right_id", right.schema[right_id].dataType), T.StructField("units", T.LongType())])
    found = scored_pairs(block_pairs(lefts, rights, partitions), make, k, schema)
    return ranked(found, own, alike, cols, k, left_id, right_id)


def one_of_equals(own: DataFrame, cols: list[str]) -> DataFrame:
    """``first_id, mark`` and the vector for each distinct vector; the smallest
    id and a hash name it (ids alone would not if they repeat or are null)."""
    return own.groupBy(*cols).agg(F.min("left_id").alias("first_id")).select("first_id", F.xxhash64(*cols).alias("mark"), *cols)


def ranked(found: DataFrame, own: DataFrame, alike: DataFrame, cols: list[str], k: int, left_id: str, right_id: str) -> DataFrame:
    """The k best of ``found(id, mark, right_id, units)`` for every row of ``own``."""
    by_score = [F.desc("units"), F.asc("right_id")]
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("id", "mark").orderBy(*by_score))).where(F.col("n") <= k).drop("n")
    o, a = own.alias("o"), alike.alias("a")
    same = F.lit(True)
    for c in cols:
        same &= F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}"))
    members = o.join(a, same).select("left_id", "first_id", F.col("mark").alias("own_mark"))
    rows = best.join(members, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("own_mark")))
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy("left_id").orderBy(*by_score))).where(F.col("rank") <= k)
            .select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id), (F.col("units") / UNITS).alias("score"), "rank"))
