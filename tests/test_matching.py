"""Block matcher against brute force; matching properties."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentmatch.operators import match as M
from talentmatch.operators import tfidf as TF
from talentmatch.operators.blockmatch import topk_cosine


def _brute_dense(L, R, k):
    out = {}
    for i, a in L.items():
        sc = []
        for j, b in R.items():
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            s = float(a @ b / (na * nb)) if na > 0 and nb > 0 else 0.0
            sc.append((-round(s, 6), j))
        out[i] = [j for _, j in sorted(sc)[:k]]
    return out


@pytest.mark.parametrize("block_rows", [7, 64, 4096])
def test_dense_blocks_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(7)
    L = {int(i): rng.normal(size=6).round(1) for i in range(40)}
    R = {int(j): rng.normal(size=6).round(1) for j in range(1000, 1150)}
    L[3] = np.zeros(6)
    R[1001] = R[1002].copy()       # exact tie
    ldf = spark.createDataFrame([(i, v.tolist()) for i, v in L.items()], "l long, vec array<double>")
    rdf = spark.createDataFrame([(j, v.tolist()) for j, v in R.items()], "r long, vec array<double>")
    got = topk_cosine(ldf, rdf, 5, left_id="l", right_id="r", block_rows=block_rows)
    have = {}
    for r in got.orderBy("l", "rank").collect():
        have.setdefault(r.l, []).append(r.r)
    assert have == _brute_dense(L, R, 5)


def _tfidf_brute(res, jobs, k):
    import math
    import re
    tok = re.compile(r"\w{2,}")
    docs = {j: tok.findall(t.lower()) for j, t in jobs.items()}
    n = len(jobs)
    df = {}
    for terms in docs.values():
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}

    def vec(terms):
        v = {}
        for t in terms:
            if t in idf:
                v[t] = v.get(t, 0) + idf[t]
        nrm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / nrm for t, x in v.items()} if nrm > 0 else {}

    jv = {j: vec(ts) for j, ts in docs.items()}
    out = {}
    for i, t in res.items():
        rv = vec(tok.findall(t.lower()))
        sc = sorted((-round(sum(w * jv[j].get(tt, 0.0) for tt, w in rv.items()), 6), j) for j in jobs)
        out[i] = [j for _, j in sc[:k]]
    return out


def test_tfidf_equals_brute_force_with_padding(spark):
    jobs = {10: "python data engineer", 11: "java developer", 12: "python python sql",
            13: "react node javascript", 14: "sales manager", 15: "data science python",
            16: "rust systems", 17: "go backend"}
    res = {1: "python sql data", 2: "react javascript", 3: "cooking baking",  # no shared term
           4: "rust"}
    jdf = spark.createDataFrame(list(jobs.items()), "job_id long, text string")
    rdf = spark.createDataFrame(list(res.items()), "resume_id long, text string")
    got = M.match_tfidf(rdf, jdf, 3, block_rows=3)
    have = {}
    for r in got.orderBy("resume_id", "rank").collect():
        have.setdefault(r.resume_id, []).append(r.job_id)
    assert have == _tfidf_brute(res, jobs, 3)
    # every résumé gets n rows, even one sharing no term
    assert got.groupBy("resume_id").count().where("count <> 3").count() == 0


def test_topn_nested(spark, small_sf):
    from talentmatch.plans.queries import embedding_sides
    res, jobs = embedding_sides(spark, small_sf)
    t5 = {(r.resume_id, r.job_id) for r in M.match_dense(res, jobs, 5).collect()}
    t6 = {(r.resume_id, r.job_id) for r in M.match_dense(res, jobs, 6).collect()}
    assert t5 <= t6 and len(t6) - len(t5) == res.count()


def test_cosine_range_and_symmetry(spark, small_sf):
    e = spark.read.parquet(f"{small_sf}/embeddings.parquet").limit(40)
    a = e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    p = a.join(b, F.col("i") < F.col("j") + 3).select(
        M.cosine(F.col("a"), F.col("b")).alias("ab"), M.cosine(F.col("b"), F.col("a")).alias("ba"))
    rows = p.collect()
    assert rows
    for r in rows:
        assert -1.0 - 1e-9 <= r.ab <= 1.0 + 1e-9 and abs(r.ab - r.ba) < 1e-12


def test_tfidf_weights_unit_norm(spark):
    docs = spark.createDataFrame([(1, "a bb bb cc"), (2, "bb dd"), (3, "x")], "id long, t string")
    counts = TF.term_counts(docs, "id", "t")
    w = TF.weights(TF.vectors(counts, TF.fit_idf(docs, "t")))
    norms = w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r.id for r in norms} == {1, 2}  # single-letter tokens are dropped
    for r in norms:
        assert abs(r.n - 1.0) < 1e-9


def test_term_counts_inside_the_row(spark):
    from collections import Counter
    texts = {1: "bb a bb cc", 2: "", 3: None, 4: "x y", 5: "zz " * 300 + "Zz yy"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = {r.id: {c.term: c.tf for c in r.counts} for r in TF.term_counts(df, "id", "t").collect()}
    assert got == {i: dict(Counter(w for w in (t or "").lower().split() if len(w) > 1)) for i, t in texts.items()}


def test_no_exchange_above_text_and_no_job_while_building(spark, small_sf):
    """Texts are parsed and counted where they are read; building the query
    runs nothing but the listing of its files."""
    from talentmatch.plans.queries import q_match_topk_tfidf
    spread = spark.conf.get("spark.talentmatch.spread")
    spark.conf.unset("spark.talentmatch.spread")
    try:
        spark.sparkContext.setJobGroup("building", "")
        df = q_match_topk_tfidf(spark, small_sf)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.talentmatch.spread", spread)
    assert len(jobs) <= 2  # footers of the two tables
    below = [plan[m.start():].splitlines()[0] for m in re.finditer("Exchange hashpartitioning", plan)]
    assert below and not [x for x in below if "text#" in x]


class _Half:
    """Vectors whose cosines with (1, 0) lie half way between two millionths."""
    scores = [(2 * n + 1) / 2e6 for n in (123456, 123457, 400000, 7, 500001)]
    rows = {10 + i: [s, math.sqrt(1 - s * s)] for i, s in enumerate(scores)} | {
        20 + i: [s + 5e-8, math.sqrt(1 - (s + 5e-8) ** 2)] for i, s in enumerate(scores)}


@pytest.mark.parametrize("k", [1, 3, 7])
def test_layout_changes_nothing(spark, k):
    left = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)] + [(9, [3.0, 1e-9])], "l long, vec array<double>")
    right = spark.createDataFrame(list(_Half.rows.items()), "r long, vec array<double>")
    out = []
    for block_rows, partitions in ((1, 5), (2, 1), (3, 16), (4096, 1), (4096, 64)):
        got = topk_cosine(left, right, k, left_id="l", right_id="r", block_rows=block_rows, partitions=partitions)
        out.append(sorted(map(tuple, got.collect())))
    assert all(x == out[0] for x in out)


def test_sparse_layouts_equal(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    jobs = spark.createDataFrame([(i, " ".join(rng.choice(words, 6))) for i in range(150)] + [(200, ""), (201, None)], "job_id long, text string")
    res = spark.createDataFrame([(i, " ".join(rng.choice(words, 9))) for i in range(70)] + [(99, "")], "resume_id long, text string")
    out = [sorted(map(tuple, M.match_tfidf(res, jobs, 4, block_rows=b, partitions=p).collect())) for b, p in ((5, 3), (64, 8), (4096, 1))]
    assert out[0] == out[1] == out[2]
    assert not {200, 201} & {r[1] for r in out[0]}  # jobs without text take no part
    assert [r[1] for r in out[0] if r[0] == 99] == [0, 1, 2, 3]


def test_vectors_without_direction_and_string_ids(spark):
    nan, inf = float("nan"), float("inf")
    vecs = {"a": [1.0, 2.0], "b": None, "c": [nan, 1.0], "d": [inf, 1.0], "e": [0.0, 0.0], "f": [], "g": [None, 1.0],
            "h": [2.0, 4.0, 0.0], "i": [-1.0, 0.5], "j": [1e-200, 2e-200]}
    df = spark.createDataFrame(list(vecs.items()), "id string, vec array<double>")
    got = {(r.l, r.r): r.score for r in topk_cosine(
        df.withColumnRenamed("id", "l"), df.withColumnRenamed("id", "r"), 20, left_id="l", right_id="r", block_rows=3).collect()}
    pairs = df.select(F.col("id").alias("l"), F.col("vec").alias("x")).crossJoin(df.select(F.col("id").alias("r"), F.col("vec").alias("y")))
    want = {(r.l, r.r): r.s for r in pairs.select("l", "r", F.round(M.cosine(F.col("x"), F.col("y")), 6).alias("s")).collect()}
    tiny = {k for k in want if "j" in k}  # squares of tiny components vanish in the plain formula
    assert len(got) == 100 and {k: v for k, v in got.items() if k not in tiny} == {k: v for k, v in want.items() if k not in tiny}
    assert got["a", "h"] == got["a", "j"] == 1.0 and got["c", "a"] == 0.0


def test_one_resume_ranked(spark, small_sf):
    from talentmatch.plans.queries import embedding_sides
    res, jobs = embedding_sides(spark, small_sf)
    one = res.orderBy("resume_id").limit(1)
    (first,) = one.collect()
    got = [(r.job_id, r.match_score) for r in M.match_one(one, jobs, 5).collect()]
    want = [(r.job_id, r.match_score) for r in M.match_dense(res, jobs, 5).where(F.col("resume_id") == first.resume_id).orderBy("rank").collect()]
    assert got == want


def test_pruning_leaves_cells_out_and_keeps_the_rows(spark):
    from talentmatch.operators.blockmatch import _Dense
    from talentmatch.operators.prunedmatch import pruned_topk_cosine, wanted_cells
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 8))
    def some(n):
        return [(centres[rng.integers(6)] + 0.05 * rng.normal(size=8)).tolist() for _ in range(n)]
    left = spark.createDataFrame([(i, v) for i, v in enumerate(some(60) + [[0.0] * 8, None, [1.0]])], "l long, vec array<double>")
    right = spark.createDataFrame([(i, v) for i, v in enumerate(some(400) + [[0.0] * 8, None, [float("nan")] * 8])], "r long, vec array<double>")
    want = sorted(map(tuple, topk_cosine(left, right, 4, left_id="l", right_id="r").collect()))
    for block_rows, n_pivots in ((2048, 24), (30, 24), (2048, 1)):
        got = pruned_topk_cosine(left, right, 4, left_id="l", right_id="r", n_pivots=n_pivots, block_rows=block_rows, partitions=5)
        assert sorted(map(tuple, got.collect())) == want
    assert pruned_topk_cosine(left, right.limit(0), 4, left_id="l", right_id="r").count() == 0
    frame = right.limit(400).toPandas()
    x = _Dense(frame, 8).m
    pivots = x[rng.permutation(400)[:24]]
    cell = (x @ pivots.T).argmax(1)
    away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
    radius = np.array([away[cell == c].max(initial=0) for c in range(24)])
    sent = wanted_cells(_Dense(left.limit(60).toPandas(), 8).m, pivots, radius, np.bincount(cell, minlength=24), 4)
    assert sent.sum() < 0.5 * sent.size  # copies of left rows against one per cell
