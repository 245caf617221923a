"""Op 12 against SQL and a plain building of the trees."""
from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import oracle_compare as OC
from talentmatch.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def climbed(nodes):
    """All levels from the nodes to one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        low = at - at % 16
        out.append(("".join(nodes[low:at]), "".join(nodes[at + 1:low + 16])))
        at //= 16
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """Sorted result rows of (doc_id, source, lang, n_chars, text) rows."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {s: climbed([leaf(r) for r in trees[s]]) for s in order}
    over = climbed([levels[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for at, r in enumerate(trees[s]):
            path = siblings(levels[s], at) + siblings(over, n)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], lowered(r[4]))) if hit else leaf(r)
            for before, after in path:
                node = h(before, node, after)
            out.append((r[0], leaf(r), levels[s][-1][0], over[-1][0], h(*[b + a for b, a in path]), node, node == over[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, tree int"


def made(spark, rows, parts=1):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


def run(df):
    out = merkle.digests(merkle.verify(merkle.proofs(merkle.manifest(df, tampered=merkle.lower_cased_fifth))))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in out.collect()], key=repr)


def random_rows(seed, sizes):
    rng = random.Random(seed)
    return [(rng.choice([None, i, i, i, 7]), s, rng.choice([None, "en", ""]), rng.choice([None, 3]), rng.choice([None, "", "aé", f"Word {i} É"]))
            for s, n in sizes.items() for i in range(n)]


EDGE = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", 1, "A"), (None, "", "en", 1, "A"), (5, "b", "é", -1, "É A")]


@pytest.mark.parametrize("rows", [[], EDGE[:1], EDGE, random_rows(1, {None: 1, "": 16, "é": 17, "z": 256, "Z": 257}),
                                  random_rows(2, {"hot": 4200, **{f"s{i}": 1 + i % 3 for i in range(300)}})])
def test_against_plain_trees(spark, rows):
    assert run(made(spark, rows, 3)) == plain(rows)


def test_one_row_repeated(spark):
    rows = [(1, "s", "en", 2, "Ab")] * 700
    assert run(made(spark, rows, 5)) == plain(rows)


def test_numbers_do_not_depend_on_the_layout(spark):
    rows = random_rows(3, {"a": 900, "b": 40, "c": 1})
    assert run(made(spark, rows, 1)) == run(made(spark, rows, 9))


@pytest.mark.parametrize("field", merkle.FIELDS)
def test_change_of_any_field_is_seen(spark, field):
    rows = [(i, "s", "en", 2, f"t{i}") for i in range(40)]
    def changed(f):
        other = merkle.leaf_of(lambda c: F.lit("9") if c == field else f(c))
        return F.when(f("doc_id") == 3, other)

    checked = merkle.verify(merkle.proofs(merkle.manifest(made(spark, rows), tampered=changed)))
    assert [r.doc_id for r in checked.where("not verified").collect()] == [3]


def test_only_every_other_level_is_kept(spark):
    rows = [(i, "s", "en", 2, f"t{i}") for i in range(600)]
    m = merkle.manifest(made(spark, rows))
    stored = [sum(len(r.entries) for r in b.collect()) for b in m.levels]
    assert stored == [600, 3]  # the 38 nodes between are computed again
    levels = climbed([leaf(r) for r in rows])
    assert [e.node for e in m.levels[1].first().entries] == levels[2]


def test_saved_manifest_and_some_proofs(spark, tmp_path):
    rows = random_rows(6, {"hot": 700, None: 3, **{f"s{i}": 1 + i % 5 for i in range(40)}})
    df = made(spark, rows, 4)
    merkle.manifest(df, tampered=merkle.lower_cased_fifth).save(str(tmp_path / "m"))
    m = merkle.Manifest.load(spark, str(tmp_path / "m"))
    want = plain(rows)
    assert sorted([tuple(r) for r in merkle.digests(merkle.verify(merkle.proofs(m))).collect()], key=repr) == want
    ids = spark.createDataFrame([(7,), (None,), (3,), (650,), (650,), (-5,)], "id long")
    some = sorted([tuple(r) for r in merkle.digests(merkle.verify(merkle.proofs(m, ids))).collect()], key=repr)
    assert some == [r for r in want if r[0] in (7, None, 3, 650)] and some
    assert merkle.proofs(m, ids.where("id = -5")).count() == 0


def test_changed_rows(spark):
    rows = [(i % 300, s, "en", 2, f"t{i}") for s in ("a", "b", None) for i in range(300)] + [(None, "b", "en", 2, "x"), (1, "a", "en", 2, "t1")]
    m = merkle.manifest(made(spark, rows))
    assert merkle.changed(m, made(spark, rows, 3)).count() == 0
    later = [r for r in rows if r[:2] != (7, None)] + [(9, "c", "en", 2, "new")]
    later[5] = (5, "a", "de", 2, "t5")
    later.remove((1, "a", "en", 2, "t1"))  # one of two equal rows
    later.remove((None, "b", "en", 2, "x"))
    got = sorted([tuple(r) for r in merkle.changed(m, made(spark, later, 2)).collect()], key=repr)
    assert got == sorted([("a", 5, leaf((5, "a", "en", 2, "t5")), leaf((5, "a", "de", 2, "t5"))),
                          ("a", 1, leaf((1, "a", "en", 2, "t1")), None), ("b", None, leaf((None, "b", "en", 2, "x")), None),
                          (None, 7, leaf((7, None, "en", 2, "t7")), None), ("c", 9, None, leaf((9, "c", "en", 2, "new")))], key=repr)


def test_op12_matches_sql(spark, small_sf):
    problems, n, _ = OC.compare(spark, OC.duck(small_sf), "op12", queries.op12_merkle_manifest,
                                queries.ORACLES["op12_merkle_manifest"], small_sf)
    assert not problems and n
