"""The pruned sparse matcher gives the plain one's rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentmatch.operators import prunedtext as P
from talentmatch.operators.blockmatch import topk_cosine
from talentmatch.operators.match import match_tfidf

SPARSE = "id long, codes array<long>, weights array<double>"


def sparse_rows(seed, n, vocabulary=60, start=0, zero=0.1, common=2):
    """Rows of one to six terms; the first ``common`` codes lie in most rows."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if rng.random() < zero:
            out.append((start + i, [], []))
            continue
        codes = set(rng.choice(np.arange(common, vocabulary), size=rng.integers(1, 5), replace=False).tolist())
        codes |= {c for c in range(common) if rng.random() < 0.7}
        codes = sorted(codes)
        w = rng.choice([0.2, 0.5, 0.5, 1.0], size=len(codes)) * [0.3 if c < common else 1.0 for c in codes]
        out.append((start + i, codes, (w / np.linalg.norm(w)).tolist()))
    return out


def rows(df):
    return sorted((r.left_id, r["rank"], r.right_id, r.score) for r in df.collect())


def both(spark, left, right, k, **kw):
    ldf, rdf = (spark.createDataFrame(x, SPARSE).withColumnRenamed("id", n) for x, n in ((left, "left_id"), (right, "right_id")))
    return rows(P.pruned_topk_sparse(ldf, rdf, k, **kw)), rows(topk_cosine(ldf, rdf, k, kind="sparse"))


@pytest.mark.parametrize("seed,common,many", [(1, 2, None), (2, 2, 1), (3, 0, 3)])
def test_same_rows(spark, seed, common, many):
    left, right = sparse_rows(seed, 150, common=common), sparse_rows(seed + 50, 400, common=common)
    got, want = both(spark, left, right, 4, block_rows=40, many_blocks=many)
    assert got == want and len(got) == 600


def test_one_vector_for_a_third_of_the_rows(spark):
    right = sparse_rows(7, 200) + [(1000 + i, [5, 9], [0.6, 0.8]) for i in range(100)]
    left = sparse_rows(8, 60) + [(1000 + i, [5, 9], [0.6, 0.8]) for i in range(50)]
    got, want = both(spark, left, right, 3, block_rows=25)
    assert got == want


EDGES = [[], [(1, [], [])], [(1, [], []), (2, [3], [1.0])], [(1, [77], [1.0]), (2, [3], [1.0]), (3, [3], [1.0])]]


@pytest.mark.parametrize("left,right", [(EDGES[3], EDGES[0]), (EDGES[0], EDGES[3]), (EDGES[2], EDGES[1]), (EDGES[3], EDGES[2]), (EDGES[3], EDGES[3])])
def test_edges(spark, left, right):
    got, want = both(spark, left, right, 2, block_rows=2)
    assert got == want


def test_rows_meet_few_blocks(spark, monkeypatch):
    """Each left row shares its heavy term with one block alone."""
    rng = np.random.default_rng(1)
    right = [(i, [1000 + i % 40, i % 3], [0.95, 0.3]) for i in range(2000)]
    left = [(i, [1000 + int(rng.integers(40)), i % 3], [0.95, 0.3]) for i in range(200)]
    met = []
    plain = P.scored
    monkeypatch.setattr(P, "scored", lambda pairs, *a: (met.append(pairs.count()), plain(pairs, *a))[1])
    got, want = both(spark, left, right, 5, block_rows=50)
    assert got == want
    assert sum(met) < 0.1 * 200 * 40


def test_texts(spark):
    jobs = spark.createDataFrame([(i, f"skill{i % 7} engineer remote {'senior' if i % 2 else ''}") for i in range(60)] + [(99, " ")],
                                 "job_id long, text string")
    resumes = spark.createDataFrame([(1, "skill3 senior"), (2, "engineer"), (3, "unknown"), (4, None)], "resume_id long, text string")
    plain, pruned = (match_tfidf(resumes, jobs, 3, pruned=p).select("resume_id", "rank", "job_id", F.round("match_score", 6).alias("s"))
                     for p in (False, True))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, pruned.collect()))
