"""Op 9: places recomputed in plain Python, laws and edge rows."""
from __future__ import annotations

import struct
import zlib
from collections import Counter

import pytest
import xxhash

from talentmatch.llm import queries, sharding
from talentmatch.llm.common import read_table


def python_place(x, n, seed):
    bits = max(2, len(bin(n - 1)) - 2)
    c = bits - bits // 2
    low, high = (1 << c) - 1, (1 << (bits - c)) - 1

    def mixed(half, i):
        h = 42
        for v in (half, i, seed):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
        return h

    def once(v):
        left, right = v >> c, v & low
        for i in range(sharding.ROUNDS):
            left, right = right, left ^ (mixed(right, i) & (high if i % 2 == 0 else low))
        return left << c | right

    y = once(x)
    while y >= n:
        y = once(y)
    return y


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 1000])
def test_feistel_is_a_computable_permutation(spark, n):
    from pyspark.sql import functions as F
    df = spark.range(n).select("id", F.lit(n).cast("long").alias("n"))
    got = {r.id: r.p for r in df.select("id", sharding.feistel(F.col("id"), F.col("n"), 7).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    assert got == {x: python_place(x, n, 7) for x in range(n)}


def checked(rows, n_shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    counts = [len(by_shard.get(k, [])) for k in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and set(by_shard) <= set(range(n_shards))


def test_query_law_rows(spark, small_sf):
    docs = {r.doc_id: r.text for r in read_table(spark, small_sf, "documents").collect()}
    out = queries.op9_sharding(spark, small_sf)
    rows = out.collect()
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    checked(rows, 24)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_layout_does_not_matter(spark, small_sf):
    docs = read_table(spark, small_sf, "documents")
    a = sorted(map(tuple, sharding.shard_rows(docs, 24).drop("grown_shard").collect()))
    b = sorted(map(tuple, sharding.shard_rows(docs.repartition(13, "source"), 24).drop("grown_shard").collect()))
    assert a == b


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPY_BLOCK", 4)
    rows = [(1, None, 9), (1, None, 9), (None, "é", 1), (None, None, 1), (2, "", 5)] + [(7, "copy", 3)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    out = sharding.shard_rows(df, 4).collect()
    checked(out, 4)
    assert Counter((r.doc_id, r.size) for r in out) == {(1, 8): 2, (None, 10): 1, (None, 8): 1, (2, 8): 1, (7, 12): 50}
    carried = sharding.shard_rows(df, 4, carry_row=True)
    assert Counter(r.row.slot for r in carried.collect()) == {9: 2, 1: 2, 5: 1, 3: 50}
    assert sharding.shard_rows(df.limit(0), 4).count() == 0


def test_written_shards_keep_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(40)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 4, rows_per_file=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.row.doc_id, r.row.text) for r in back.collect()) == sorted(map(tuple, df.collect()))
