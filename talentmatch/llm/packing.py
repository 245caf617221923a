"""Op 5 — best-fit packing by patterns fitted with non-negative least squares.

Documents become token ids plus an end id; only longer ones are cut, into
pieces of ``size`` tokens, the first one shorter.  Packing then needs nothing
but the histogram of piece lengths, ``size`` numbers at most:

1. patterns of up to three lengths that fill a sequence exactly are
   enumerated, and repeat counts fitted to the histogram by non-negative
   least squares (long pieces weigh more, being harder to place);
2. counts are rounded, never using more pieces than there are;
3. what is left is packed best-fit decreasing, a whole pattern at a time and
   as often as it goes, so the work depends on ``size`` alone.

Every piece gets a rank among those of its length, from counts per length and
bucket and a window inside each; rank and length say which repeat of which
pattern takes the piece and where.  No sequence is ever gathered.

Edge cases: null and empty texts are the end id alone (length 1); ids may be
null or repeat, each row is its own document; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.llm.common import written
from talentmatch.llm.tokencount import safe_pieces, vocabulary_path

#: Numbering a length is split over so many groups.
N_BUCKETS = 64
_ENCODINGS: dict[str, object] = {}


def encoding(ranks_file: str):
    """Byte-level BPE with the vocabulary of ``byte_bpe_50k.json``, from the
    same vocabulary as ranks: the same ids in a fifth of the time.  Its one
    special string is taken as such inside texts, the library's default."""
    if ranks_file not in _ENCODINGS:
        import public_tokenizers
        import tiktoken
        with open(vocabulary_path(ranks_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[ranks_file] = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={"<|endoftext|>": len(ranks)})
    return _ENCODINGS[ranks_file]


def token_ids(text: str, ranks_file: str, end_id: int) -> np.ndarray:
    enc = encoding(ranks_file)
    parts = [enc.encode_to_numpy(p, allowed_special="all") for p in safe_pieces(text, 1 << 16)]
    return np.concatenate([*parts, [end_id]]).astype("<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces_of(df: DataFrame, size: int, end_id: int, ranks_file: str, id_col: str, text_col: str,
              keep_ids: bool) -> DataFrame:
    """One row per piece.  ``bucket`` deals the pieces out evenly; it is fixed
    by being written with them."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()),
              ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()),
              ("bucket", T.IntegerType(), pa.int32())]
    if keep_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t, _ in fields)])

    def tokenized(batches):
        dealt = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                owner, columns = [], [[] for _ in fields]
                for k, text in enumerate(part.column("text").to_pylist()):
                    ids = token_ids(text, ranks_file, end_id)
                    for piece, (start, length) in enumerate(cut(len(ids), size)):
                        own = ids[start:start + length]
                        owner.append(k)
                        row = (piece, start, length, zlib.crc32(own.tobytes()), dealt % N_BUCKETS, own)
                        for column, value in zip(columns, row):
                            column.append(value)
                        dealt += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner, pa.int64())),
                     *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, fields))],
                    names=schema.names)

    return rows.mapInArrow(tokenized, schema)


def exact_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All (a >= b >= c >= 0) with a + b + c = size over lengths in use; 0 is no piece."""
    used = np.zeros(size + 1, bool)
    used[lengths] = True
    used[0] = True
    a, b = np.meshgrid(np.arange(size + 1), np.arange(size + 1), indexing="ij")
    c = size - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = used[a] & used[b] & used[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of
    (pieces used - pieces there), by accelerated projected gradient."""
    size = len(counts) - 1
    weight = np.arange(size + 1) / size  # 0 for "no piece"

    def used(x):
        return np.bincount(patterns.ravel(), np.repeat(x, 3), size + 1)

    def back(r):
        return r[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(weight * used(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(weight * (used(y) - counts)) / (1.05 * bound))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """``({length: pieces of it in the pattern}, repeats)`` that use every
    piece of the histogram exactly once."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], repeats: int) -> None:
        for length, m in pattern.items():
            left[length] -= m * repeats
        out.append((pattern, int(repeats)))

    if left[size]:
        take({size: 1}, left[size])
    patterns = exact_patterns(np.flatnonzero(left), size)
    if len(patterns):
        fitted = fit_counts(patterns, left.astype(float))
        for p in np.argsort(-fitted, kind="stable"):
            wanted = int(round(fitted[p]))
            if not wanted:
                break
            lengths, m = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
            repeats = min(wanted, int((left[lengths] // m).min()))
            if repeats:
                take(dict(zip(lengths.tolist(), m.tolist())), repeats)
    while (there := np.flatnonzero(left)).size:
        room, pattern = size, {}
        while room:
            k = np.searchsorted(there, room, side="right") - 1
            while k >= 0 and there[k] in pattern:  # each length is considered once, with all that fit
                k -= 1
            if k < 0:
                break
            length = int(there[k])
            pattern[length] = min(room // length, int(left[length]))
            room -= length * pattern[length]
        take(pattern, min(int(left[length]) // m for length, m in pattern.items()))
    return out


def places(planned: list[tuple[dict[int, int], int]], size: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks by the pattern that takes them: sorted
    keys ``length << 40 | first rank``, pieces per sequence, first sequence
    and offset of the first such piece in a sequence."""
    ranks = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    for pattern, repeats in planned:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length << 40 | int(ranks[length]), pattern[length], sequence, offset))
            ranks[length] += pattern[length] * repeats
            offset += length * pattern[length]
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "per", "sequence", "offset"), table.T))


def pack(df: DataFrame, size: int = 1024, end_id: int = 2, ranks_file: str = "byte_bpe_50k.tiktoken",
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every
    piece, and with ``keep_ids`` its token ids."""
    pieces = written(pieces_of(df, size, end_id, ranks_file, id_col, text_col, keep_ids), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    table = places(plan(histogram, size), size)

    so_far = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("length", "bucket", (F.sum("n").over(so_far) - F.col("n")).alias("before")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (pieces.withColumn("nth", F.row_number().over(inside)).join(before, ["length", "bucket"])
              .withColumn("rank", F.col("before") + F.col("nth") - 1).drop("before", "nth", "bucket"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = T.StructType([*(pieces.schema[n] for n in names), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def placed(batches):
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(table["key"], length << 40 | rank, side="right") - 1
            nth = rank - (table["key"][at] & ((1 << 40) - 1))
            per = table["per"][at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(table["sequence"][at] + nth // per),
                 pa.array(table["offset"][at] + nth % per * length)], names=schema.names)

    return ranked.select(*names, "rank").mapInArrow(placed, schema)
