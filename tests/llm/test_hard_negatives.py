"""Op 11 against brute force and SQL."""
from __future__ import annotations

import numpy as np
import pytest

import oracle_compare as OC
from talentmatch.llm import hard_negatives as H
from talentmatch.llm import queries

INF, NAN = float("inf"), float("nan")


def brute(rows, step=50, n_pos=5, n_neg=3, scale=256):
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    good = sorted({(i, y, tuple(int(np.floor(scale * x)) for x in [*v, *[0.0] * (dim - len(v))])) for i, v, y in rows
                   if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, label, v in good:
        if a % step == 0:
            scored = sorted((-sum(p * q for p, q in zip(v, w)), i, y) for i, y, w in good if i != a)
            for ps, p, _ in [x for x in scored if x[2] == label][:n_pos]:
                found = [x for x in scored if x[2] != label and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:n_neg]
                out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2) for i, v, y in rows], "vec_id long, embedding array<double>, label int, score int, row int")


def run(spark, rows, **kw):
    df = frame(spark, rows)
    out = H.mine(df, df.where("vec_id % 50 = 0"), **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def random_rows(seed, n=700, dim=6, labels=4, centres=5, spread=0.4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    rows = [(i, (rng.uniform(0.2, 2) * (c[i % centres] + spread * rng.normal(size=dim))).tolist(), int(rng.integers(labels))) for i in range(n)]
    return rows + [(n + i, rows[3][1], i % 3) for i in range(n // 3)]  # one vector for a fourth of the rows


EDGE = [(0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (None, [1.0, 1.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [NAN, 1.0], 1),
        (4, [INF, 1.0], 2), (5, [0.0, 0.0], 2), (6, [], 1), (7, [0.5], 1), (8, [0.5, 0.25], 1), (9, [0.4, 0.2], 2), (10, [0.3, 0.2], None),
        (50, [0.0, 0.0], 2), (100, [1e3, 2.0], 2), (150, [0.5, 0.25], 3), (-50, [-0.1, -0.2], 1), (11, [0.4, 0.2], 2), (12, [0.3, 0.3], 2)]


@pytest.mark.parametrize("rows", [EDGE, [], EDGE[:1], random_rows(1)])
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed,spread", [(2, 0.1), (3, 1.5)])
def test_several_clusters_blocks_and_parts(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(H, "CLUSTER_ANCHORS", 4)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(H, "BLOCK_ROWS", 90)
    monkeypatch.setattr(H, "STRIDE", 16)
    rows = [(5 * i, v, y) for i, v, y in random_rows(seed, 600, spread=spread)] + [(50, [0.3] * 6, 77), (10000, [0.2] * 6, 78)]
    assert run(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(10 * i, [float(2 ** 22 + i), float(3 * i - 40)], i % 3) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_walk_stops_early_and_loses_nothing():
    rng = np.random.default_rng(5)
    centre = np.eye(16)[0]
    a = np.floor(256 * (centre + 0.1 * rng.normal(size=(40, 16)))).astype(np.int64)
    x = np.floor(256 * rng.normal(size=(8000, 16))).astype(np.int64)
    c = H.Clusters(centre[None, :])
    c.widest = np.array([c.place(a.astype(float))[0].max()])
    angle, _, norm = c.place(x.astype(float))
    bound = c.bounds(angle, norm)[:, 0]
    lengths = np.sqrt((a * a).sum(1))
    assert (a @ x.T <= lengths[:, None] * bound + 1e-3).all()
    order = np.argsort(-bound, kind="stable")
    best = [np.zeros(0, np.int64)] * len(a)
    cutoff = np.full(len(a), H.LEAST)

    def visit(alive, at, scores):
        for i, s in zip(alive, scores):
            best[i] = np.sort(np.concatenate([best[i], s]))[::-1][:10]
            cutoff[i] = best[i][-1]

    looked = H.walk(a, x[order], bound[order], cutoff, visit)
    assert looked < 0.6 * a.shape[0] * x.shape[0]
    assert all((np.sort(a[i] @ x.T)[::-1][:10] == best[i]).all() for i in range(len(a)))


def test_op11_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    problems, n, _ = OC.compare(spark, OC.duck(sf), "op11", queries.op11_hard_negatives, queries.ORACLES["op11_hard_negatives"], sf)
    assert not problems and n
