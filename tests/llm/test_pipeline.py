"""The pipeline against its parts applied in plain Python."""
from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from talentmatch.llm import secret_scan, toxicity
from talentmatch.llm.common import read_table
from test_neardup import brute
from test_packing import checked_sequences

BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows, on the smallest documents."""
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents").where("doc_id < 400")
    out, columns = [docs.collect()], docs.columns
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, sf)
        if name != "packing":
            assert got.columns == columns and got.dtypes == docs.dtypes
        path = str(tmp_path_factory.mktemp("stage") / name)
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return sf, out


def test_toxic_documents_go(spark, stages):
    sf, out = stages
    docs = spark.createDataFrame(out[0])
    model = toxicity.fit(docs, read_table(spark, sf, "labels"))
    assert sorted(out[1]) == sorted(r for r in out[0] if model.score(r.text) < 0.5)


def test_one_of_each_group_stays(stages):
    _, out = stages
    kept = {i for i, _, c, _ in brute([(r.doc_id, r.text) for r in out[1]]) if i == c}
    assert sorted(out[2]) == sorted(r for r in out[1] if r.doc_id in kept)
    assert len(out[2]) < len(out[1])


def test_secrets_are_blanked(stages):
    _, out = stages
    after = {r.doc_id: r for r in out[3]}
    assert sorted(after) == sorted(r.doc_id for r in out[2])
    for r in out[2]:
        clean = after[r.doc_id]
        if r.text is not None and secret_scan.base_spans(r.text):
            assert not secret_scan.base_spans(clean.text) and clean.n_chars == len(clean.text)
        elif "[SECRET]" not in (clean.text or ""):
            assert clean == r


def test_everything_left_is_packed(stages):
    _, out = stages
    texts = {r.doc_id: r.text or "" for r in out[3]}
    by_doc = {}
    for r in out[4]:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert by_doc == {d: len(BYTE.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    n = checked_sequences(out[4], 1024)
    assert n <= 1.02 * -(-sum(by_doc.values()) // 1024) + 1


def test_run_and_edge_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", None), (None, "", None, None, 0), (2, "token=abcdefgh1 x", "en", "a", 17),
            (2, "token=abcdefgh1 x", "en", "a", 17), (3, "long word " * 30000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id or 0 for r in out}) == [0, 1, 2, 3]
    assert np.all([r.length for r in out if r.doc_id in (1, None)]) == 1
    none = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0


def test_one_row_of_each_group_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{name}{i}" for i in range(60)) for name in "abcd")
    near = c.replace("c59", "other")
    rows = [(3, b), (7, a), (7, b), (None, a + " "), (None, b), (None, c), (None, near), (None, d), (9, near), (None, None),
            (None, None), (5, " "), (7, ""), (11, "x y"), (11, "x y"), (11, "x z"), (None, "x w"), (None, "x w")]
    docs = spark.createDataFrame([(i, t, None, "s", k) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.dtypes == docs.dtypes
    want = [(3, b), (7, a), (9, near), (None, d), (None, None), (None, None), (5, " "), (7, ""), (11, "x y"), (11, "x z"), (None, "x w")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


def test_sequences_hold_the_texts(stages):
    _, out = stages
    ids = {}
    for r in sorted(out[4], key=lambda r: (r.doc_id, r.piece)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {r.doc_id: [*BYTE.encode(r.text or "", add_special_tokens=False).ids, 2] for r in out[3]}
