"""Op 1 — MinHash near-dedup with sequential Bayesian verification.

1. One pass over whole texts: the word sequence's hash (exact copies share
   it), the size of its shingle set and a signature of ``HASHES`` minima.
   Copies fall together into one class before anything is paired.
2. Band keys; in each bucket every class is paired with the smallest one, so
   a bucket of m classes gives m - 1 pairs.
3. Signatures of a pair are compared batch by batch.  Given m agreements in n
   comparisons and a uniform prior, the similarity reaches the threshold with
   probability P(Binomial(n + 1, threshold) <= m); a pair is given up once
   that falls below ``MISS``.
4. Survivors are verified on full shingle sets and joined into components.
5. The classes that share a smallest one form a crowd.  Where a crowd still
   holds more than one component, its pairs across components are compared in
   tiles of bounded size, by signatures and then on full sets; a tile returns
   no more links than it has components.  So every banded pair is decided,
   except those inside one component, which cannot change the result.

A pair at the threshold shares no band with probability
(1 - 0.75 ** 4) ** 32 = 5e-6, and is given up in step 3 with about ``MISS``.
Words, shingles and classes are told apart by 64-bit hashes.

Edge cases: null text and text without words give the empty set, linked with
nothing; rows may repeat, each gets its own result and identical ones are
linked; a null id never names a component if another id is there; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.llm.common import written
from talentmatch.llm.graph import components

WORDS = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
TILE = 256
#: Parts into which the members of one crowd are dealt for a join.
SALTS = 32

_RNG = np.random.default_rng(97)
_MULTIPLY = _RNG.integers(0, 2 ** 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2 ** 63, HASHES, np.uint64)
_PLACE = _RNG.integers(0, 2 ** 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between white space 0x20, 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; one for fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n = min(WORDS, len(words))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        total += h[j:len(h) - n + 1 + j] * _PLACE[j]
    return np.unique(_mixed(total))


def signature(own: np.ndarray) -> np.ndarray:
    """Minima of ``HASHES`` hash functions, 16 bits of each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, (own[at:at + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def class_hash(words: list[bytes]) -> int:
    """64 bits, signed, of the word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2 ** 63


def text_mark(text_col: str = "text") -> Column:
    """64 bits of the text as it stands; with the id they tell rows apart."""
    return F.xxhash64(F.col(text_col))


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, mark, n_shingles, node, sig`` of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_mark(text_col).alias("mark"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["mark"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType())])

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sizes, nodes, sigs = [], [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    own = shingles(words)
                    sizes.append(len(own))
                    nodes.append(class_hash(words) if words else None)
                    sigs.append(signature(own).tobytes() if words else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                     pa.array(sigs, pa.binary())], names=schema.names)

    return rows.mapInArrow(printed, schema)


def least_agreements(threshold: float, miss: float) -> list[tuple[int, int]]:
    """``(n, m)`` per batch: with fewer than m agreements in n comparisons the
    similarity reaches ``threshold`` with probability below ``miss``."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def may_reach(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, miss: float) -> np.ndarray:
    """Places of the pairs of signature rows that stay after every batch; set
    sizes that rule the threshold out end a pair at once."""
    alive = np.flatnonzero(100 * np.minimum(size_a, size_b) >= THRESHOLD * np.maximum(size_a, size_b))
    agreed = np.zeros(len(alive), np.int64)
    for n, m in least_agreements(THRESHOLD / 100, miss):
        agreed = agreed + (a[alive, n - BATCH:n] == b[alive, n - BATCH:n]).sum(axis=1)
        alive, agreed = alive[agreed >= m], agreed[agreed >= m]
    return alive


def _signatures(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u2").reshape(len(values), HASHES)


def _likely(pairs: DataFrame, classes: DataFrame, miss: float) -> DataFrame:
    """Pairs ``a, b`` that survive the Bayesian comparison."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n_shingles").alias(f"n_{name}"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                p = batch.slice(at, 4096)
                stay = may_reach(_signatures(p.column("sig_a").to_pylist()), _signatures(p.column("sig_b").to_pylist()),
                                 p.column("n_a").to_numpy(), p.column("n_b").to_numpy(), miss)
                yield p.select(["a", "b"]).take(pa.array(stay))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(kept, "a long, b long")


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, s``: the full shingle set of each wanted class, read from the
    row of its smallest id.  ``docs`` has ``doc_id, text``."""
    texts = (wanted.join(classes.select("node", "rep"), "node")
             .join(docs, F.col("rep").eqNullSafe(F.col("doc_id"))).select("node", "text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, found = [], []
                for node, text in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                    words = words_of(text)
                    if words and class_hash(words) == node:  # the id may name other texts too
                        nodes.append(node)
                        found.append(shingles(words).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "s"])

    return texts.mapInArrow(sets, "node long, s binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose full shingle sets reach the threshold."""
    # written, so that both joins read plain rows and the engine can split a centre with many pairs
    own = written(_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs), "sets")
    both = (pairs.join(own.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a")
            .join(own.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for k, (x, y) in enumerate(zip(batch.column("s_a"), batch.column("s_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= THRESHOLD * (len(x) + len(y) - common):
                    stay.append(k)
            yield batch.select(["a", "b"]).take(pa.array(stay, pa.int64()))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(linked, "a long, b long")


def _across(members: DataFrame, classes: DataFrame, docs: DataFrame, miss: float) -> DataFrame:
    """Links ``a, b`` that join different components of one crowd, enough to
    span what a tile joins.  Members are rows ``centre, node, component``; a
    crowd is all classes that share a centre.

    Pairs inside a component need no look, so every pair has a side outside
    the crowd's largest component.  Members go to blocks of about ``TILE``,
    and those outside the largest also to blocks of their own kind; a tile is
    a block of either sort.  Few outsiders make few copies of the rest."""
    sizes = members.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("n"))
    crowds = (sizes.groupBy("centre").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
              .where(F.col("all") > F.col("top.n"))
              .select("centre", F.col("top.component").alias("largest"),
                      F.ceil(F.col("all") / TILE).cast("int").alias("blocks"),
                      F.ceil((F.col("all") - F.col("top.n")) / TILE).cast("int").alias("outer_blocks")))
    mark = F.xxhash64("node")
    salted = crowds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = members.withColumn("salt", F.pmod(mark, F.lit(SALTS)).cast("int")).join(salted, ["centre", "salt"])
    names = ["centre", "node", "component", "block", "outer_block", "outer"]
    left = (rows.withColumn("block", F.pmod(mark, "blocks").cast("int")).withColumn("outer", F.lit(False))
            .withColumn("outer_block", F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1))).select(names))
    right = (rows.where("component <> largest").withColumn("outer_block", F.pmod(mark, "outer_blocks").cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("outer", F.lit(True)).select(names))
    own = _sets(rows.select("node").distinct(), classes, docs).join(classes.select("node", "sig"), "node")
    tiles = left.unionByName(right).join(own, "node")

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        outer = frame["outer"].to_numpy()
        order = np.r_[np.flatnonzero(~outer), np.flatnonzero(outer)]
        n = int((~outer).sum())
        node, comp = frame["node"].to_numpy()[order], frame["component"].to_numpy()[order]
        sig = _signatures(frame["sig"].to_numpy()[order])
        sets = [np.frombuffer(x, np.uint64) for x in frame["s"].to_numpy()[order]]
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        flag = np.zeros(codes.max() + 1, bool)
        joined = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while joined[c] != c:
                c = joined[c]
            return c

        out = []
        for i in range(n, len(order)):
            j = np.flatnonzero(comp[:n] != comp[i])
            j = j[may_reach(sig[j], np.broadcast_to(sig[i], (len(j), HASHES)), sizes[j], np.full(len(j), sizes[i]), miss)]
            if not len(j):
                continue
            mine = codes[ends[i] - sizes[i]:ends[i]]
            flag[mine] = True
            for k in j:
                if root(int(comp[k])) != root(int(comp[i])):
                    common = int(flag[codes[ends[k] - sizes[k]:ends[k]]].sum())
                    if 100 * common >= THRESHOLD * (sizes[i] + sizes[k] - common):
                        joined[root(int(comp[k]))] = root(int(comp[i]))
                        out.append((node[i], node[k]))
            flag[mine] = False
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return tiles.groupBy("centre", "block", "outer_block").applyInPandas(linked, "a long, b long")


def _grouped(df: DataFrame, id_col: str, text_col: str, miss: float) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and ``node, rep, component`` of every class."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(fingerprints(df, id_col, text_col), "prints")
    classes = written(prints.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")

    width = 2 * ROWS  # bytes of a band
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.col("sig").substr(i * width + 1, F.lit(width))))
    banded = classes.select("node", F.explode(keys).alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    members = written(banded.join(centres, "bucket").select("centre", "node").distinct(), "members")

    stars = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = written(_verified(written(_likely(stars, classes, miss), "pairs"), classes, docs), "verified")
    found = components(links)
    placed = members.join(found, "node", "left").select("centre", "node", F.coalesce("component", "node").alias("component"))
    more = written(_across(placed, classes, docs, miss), "verified")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    return prints, (classes.select("node", "rep").join(found, "node", "left")
                    .select("node", "rep", F.coalesce("component", "node").alias("component")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    prints, ends = _grouped(df, id_col, text_col, miss)
    names = ends.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = ends.join(names, "component").select("node", "component_id")
    return prints.join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def surplus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """``doc_id, mark, first`` of the rows with words that are not alone the
    first of their component, by id (null last) and mark; ``first`` is true
    where the first one itself is repeated, id and text."""
    prints, ends = _grouped(df, id_col, text_col, miss)
    rows = written(prints.where(F.col("node").isNotNull()).groupBy("doc_id", "mark", "node").agg(
        F.count(F.lit(1)).alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    firsts = (rows.groupBy("node").agg(F.min(order).alias("own")).join(ends, "node")
              .groupBy("component").agg(F.min("own").alias("own"))
              .select(F.col("own.doc_id").alias("first_id"), F.col("own.mark").alias("first_mark")))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    first = F.col("first_mark").isNotNull()
    return written(rows.join(firsts, same, "left").where(~first | (F.col("n") > 1)).select(
        "doc_id", "mark", first.alias("first")), "surplus")
