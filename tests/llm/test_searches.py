"""Ops 3 and 7 against brute force."""
from __future__ import annotations

import numpy as np
import pytest

import oracle_compare as OC
from talentmatch.llm import ann, queries, voronoi
from talentmatch.llm.common import read_table

INF, NAN = float("inf"), float("nan")


def brute(rows, step, k, measure, zero_ok):
    """Lists of (query_id, rank, vec_id, score) by comparing all rows."""
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    good = {(i, tuple([*v, *[0.0] * (dim - len(v))])) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    good = {(i, v) for i, v in good if zero_ok or any(v)}
    out = []
    for qi, q in sorted(good):
        if qi % step == 0:
            found = sorted((measure(np.array(q), np.array(v)), i) for i, v in good if i != qi)[:k]
            out += [(qi, n + 1, i, abs(s)) for n, (s, i) in enumerate(found)]
    return sorted(out)


def whole_product(a, b):
    return -int(np.floor(64 * a).astype(object) @ np.floor(64 * b).astype(object))


def distance(a, b):
    return float(np.sqrt(((a - b) ** 2).sum()))


EDGE = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (None, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [NAN, 1.0]), (4, [INF, 1.0]),
        (5, [0.0, 0.0]), (6, []), (7, [0.5]), (8, [0.5, -0.25]), (9, [0.5, -0.25]), (100, [1e3, 2.0]), (200, [0.5, -0.25]), (-100, [0.1, 0.2])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")


def random_rows(seed, n=400, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(n // 3)]  # one vector for a fourth of the rows


def as_rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("rows", [EDGE, random_rows(1), [], EDGE[:1]])
def test_exact_top_k(spark, rows):
    df = frame(spark, rows)
    out = voronoi.top_k(df, df.where("vec_id % 20 = 0"), k=5, n_pivots=8, block_queries=7, block_rows=30)
    want = brute(rows, 20, 5, whole_product, True)
    assert [(q, r, v, abs(s)) for q, r, v, s in as_rows(out)] == [(q, r, v, abs(s)) for q, r, v, s in want]


def test_exact_top_k_of_large_components(spark):
    rows = [(i, [float(2 ** 24 + i), float(-i * 3)]) for i in range(30)]
    df = frame(spark, rows)
    out = voronoi.top_k(df, df.where("vec_id % 20 = 0"), k=4, n_pivots=3)
    assert as_rows(out) == brute(rows, 20, 4, whole_product, True)


def test_bounds_leave_rows_out():
    rng = np.random.default_rng(4)
    centres = 100 * rng.normal(size=(8, 5))
    x = centres[rng.integers(0, 8, 800)] + rng.normal(size=(800, 5))
    away = np.sqrt(((x[:, None] - centres) ** 2).sum(2))
    cell, near = away.argmin(1), away.min(1)

    class Row:
        def __init__(self, **kw):
            self.__dict__.update(kw)

    norm = np.sqrt((x * x).sum(1))
    groups = [Row(cell=c, n=int((cell == c).sum()), away=near[cell == c].max(), norm=norm[cell == c].max()) for c in range(8)]
    closest = [Row(cell=c, away=a) for c in range(8) for a in np.sort(near[cell == c])[:6]]
    b = voronoi.Bounds(centres, groups, closest, 5, 100)
    wanted = b.wanted(x, norm)
    assert wanted.mean() < 0.4
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    for i in range(800):
        best = np.argsort(-scores[i])[:5]
        assert wanted[best, list(b.active).index(cell[i])].all()


def test_op3_matches_sql(spark, small_sf):
    problems, _, _ = OC.compare(spark, OC.duck(small_sf), "op3", queries.op3_exact_top_k,
                                queries.ORACLES["op3_exact_top_k"], small_sf)
    assert not problems


@pytest.mark.parametrize("rows", [EDGE, [], EDGE[:1]])
def test_neighbours_of_small_tables_are_exact(spark, rows):
    df = frame(spark, rows)
    out = as_rows(ann.search(df, df.where("vec_id % 100 = 0"), k=4))
    want = brute(rows, 100, 4, distance, False)
    assert [x[:3] for x in out] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in out], [x[3] for x in want], rtol=1e-15, atol=0)


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in read_table(spark, sf, "embeddings").collect()]
    want = brute(rows, 100, 10, distance, False)
    out = as_rows(queries.op7_nearest_neighbours(spark, sf))
    assert len(out) == len(want)
    near = {(q, v): s for q, _, v, s in want}
    assert sum((q, v) in near for q, _, v, _ in out) >= 0.9 * len(want)
    assert all(s == pytest.approx(near[q, v], rel=1e-14) for q, _, v, s in out if (q, v) in near)
    ranks = [(q, s, v) for q, _, v, s in out]
    assert ranks == sorted(ranks)


def test_adaptive_scan_gives_up_early():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = ann.rotation(64)
    kept, exact = [], 0
    for i in range(20):
        own = np.arange(3000) == i
        place, far = ann.scan(x[i], x[i] @ turn, x, x @ turn, own, 10, ann.EPSILON)
        kept.append(len(place))
        true = np.argsort(np.where(own, np.inf, ((x - x[i]) ** 2).sum(1)))[:10]
        exact += len(set(true) & set(place))
    assert np.mean(kept) < 60 and exact >= 0.98 * 200


def test_copies_of_the_query_stay():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 64))
    x[:300] = x[0]
    turn = ann.rotation(64)
    rotated = x @ turn
    asked = rotated[0] * (1 + 1e-15 * rng.choice([-2, 2], 64))  # as another product routine may round
    place, far = ann.scan(x[0], asked, x, rotated, np.arange(600) == 0, 10, ann.EPSILON)
    assert set(range(1, 300)) <= set(place) and (far[place < 300] == 0).all()


def test_one_query_among_copies(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 32)))]
    rows += [(400 + i, rows[0][1]) for i in range(300)]
    df = frame(spark, rows)
    out = as_rows(ann.search(df, df.where("vec_id = 0"), k=10))
    assert [(v, s) for _, _, v, s in out] == [(400 + i, 0.0) for i in range(10)]
