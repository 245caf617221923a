"""Op 5: pieces against the tokenizer library, sequences against plain best fit."""
from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talentmatch.llm import packing, queries
from talentmatch.llm.common import read_table

BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked_sequences(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_query(spark, small_sf):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, small_sf, "documents").collect()}
    rows = queries.op5_best_fit_packing(spark, small_sf).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_doc) == sorted(docs)
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        ids = np.array(BYTE.encode(docs[d], add_special_tokens=False).ids + [2], "<u4")
        assert [(r.piece, r.start, r.length) for r in own] == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    n = checked_sequences(rows, 1024)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def best_fit_decreasing(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else size
        bisect.insort(rooms, room - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    size = 64
    draws = [[rng.randint(1, size) for _ in range(3000)], [min(size, int(rng.expovariate(0.1)) + 1) for _ in range(2000)],
             [1] * 500, [33] * 40 + [31] * 40 + [2] * 9, [size] * 7, []][seed]
    planned = packing.plan(Counter(draws), size)
    used = Counter()
    for pattern, repeats in planned:
        assert repeats > 0 and sum(n * m for n, m in pattern.items()) <= size
        for n, m in pattern.items():
            used[n] += m * repeats
    assert used == Counter(draws)
    assert sum(r for _, r in planned) <= best_fit_decreasing(draws, size) * 1.02 + 1


def test_special_strings_and_edges(spark):
    long = ("<|endoftext|> words and é漢 " * 900) + "\n\n  \n"
    rows = [(1, None, 7), (None, "", 7), (2, long, 7), (2, long, 7), (3, "x" * 30000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = packing.pack(df, keep_ids=True).collect()
    checked_sequences(out, 1024)
    assert Counter((r.doc_id, r.piece) for r in out)[(2, 0)] == 2
    want = BYTE.encode(long, add_special_tokens=False).ids + [2]
    own = sorted({(r.piece, tuple(r.ids)) for r in out if r.doc_id == 2})
    assert [i for _, ids in own for i in ids] == want
    assert [r.length for r in out if r.doc_id in (1, None)] == [1, 1]
    assert packing.pack(df.limit(0)).count() == 0
