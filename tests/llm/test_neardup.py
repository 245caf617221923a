"""Op 1 against all pairs compared in plain Python."""
from __future__ import annotations

import random
import re

import numpy as np
import pytest

from talentmatch.llm import graph, neardup, queries
from talentmatch.llm.common import read_table


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for ids in where.values():
        for i in ids:
            for j in ids:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                        comp[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    least = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    return sorted(((rows[i][0], len(sets[i]), least[i], rows[i][0] == least[i]) for i in range(len(rows))), key=repr)


def as_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    out = as_rows(queries.op1_minhash_near_dedup(spark, sf))
    assert out == brute(rows)
    assert sum(not kept for *_, kept in out) > 10


def test_families_at_the_threshold(spark):
    """Copies with edits spread so that similarities fall around the threshold
    and stars alone do not join a family."""
    rng = random.Random(3)
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((k, " ".join(words)))
            k += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(neardup.near_duplicates(df)) == brute(rows)


def test_tiles_find_the_pairs_that_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3])):
            words[at] = f"x{k}.{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(neardup.near_duplicates(df)) == brute(rows)


EDGE = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one\x0btwo"), (10, "one two three"), (3, "A b c D e f"),
        (3, "a b c d e f"), (4, "a B c d e f"), (4, "q w r t y"), (None, "a b c d e f"), (None, "z z z z z z z"),
        (20, "É b c d e"), (21, "é b c d e"), (22, "a\xa0b c d e"), (30, "long " * 40000), (31, "long " * 39000)]


def test_edges(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in EDGE], "doc_id long, text string, node int")
    out = as_rows(neardup.near_duplicates(df))
    want = [(i, n, c, (i == c)) for i, n, c, _ in brute(EDGE)]
    assert out == want
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_posterior_bounds():
    bounds = neardup.least_agreements(0.75, 1e-6)
    assert [n for n, _ in bounds] == [32, 64, 96, 128]
    rng = np.random.default_rng(1)
    for s, least in ((0.78, 0.9999), (0.3, 0.0)):
        agree = rng.random((4000, neardup.HASHES)) < s
        a = np.zeros((4000, neardup.HASHES), np.uint16)
        kept = len(neardup.may_reach(a, (~agree).astype(np.uint16), np.ones(4000), np.ones(4000), 1e-6)) / 4000
        assert kept >= least if s > 0.5 else kept < 0.001


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, x) for x in range(501, 560)]
    links += [(x, x + 1) for x in range(600, 640)]
    comp = {x: x for l in links for x in l}
    for _ in range(300):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in comp} == comp
