"""Op 4 against the SentencePiece library."""
from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from talentmatch.llm import queries, wfst
from talentmatch.llm.common import read_table

MODEL = "piece_bpe_32k.model"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
OURS = wfst.compiled(MODEL)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(st.sampled_from("aehinorst th "), max_size=60), st.text(st.sampled_from(" ▁a\n"), max_size=60),
                 st.text(st.sampled_from("<s>/unk0x41漢字é́ß\x00\r\t 123"), max_size=40)))
def test_random_texts(text):
    ids = OURS.encode(text).tolist()
    assert ids == LIBRARY.encode(text)
    assert OURS.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", " " * 100, "x" * 3000, "the " * 500, "ab▁▁ c", "한국어 漢字かな 🙂👩‍💻", "internationalization" * 50])
def test_cases(text):
    assert OURS.encode(text).tolist() == LIBRARY.encode(text)


def test_only_one_path_is_finite():
    """Every piece sequence of short inputs but the encoding has weight infinity."""
    def paths(chunk):
        if not chunk:
            yield []
        for n in range(1, len(chunk) + 1):
            if chunk[:n] in OURS.id or n == 1:
                for rest in paths(chunk[n:]):
                    yield [chunk[:n], *rest]

    for chunk in ("▁there", "▁other", "tionsh", "▁▁▁ab", "é漢a"):
        finite = [p for p in paths(chunk) if all(OURS.weight(a, b) == 0 for a, b in zip(["", *p], p))]
        assert finite == [OURS.joined(chunk)] == [OURS.path(chunk)]


def test_query_matches_library(spark, small_sf):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, small_sf, "documents").collect()}
    rows = queries.op4_sentencepiece(spark, small_sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert (r.decoded_crc32, r.round_trip) == (zlib.crc32(LIBRARY.decode(ids).encode()), True)


def test_encode_decode_and_edges(spark):
    rows = [(1, None, 3), (None, "", 3), (2, "tie one▁two  ", 3), (2, "tie one▁two  ", 3), (3, "y" * 100000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    made = wfst.encode(df)
    back = sorted((r.doc_id or 0, r.text) for r in wfst.decode(made).collect())
    assert back == [(0, ""), (1, ""), (2, "tie one two  "), (2, "tie one two  "), (3, "y" * 100000)]
    assert wfst.digests(df.limit(0)).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(wfst, "CACHE", 10)
    monkeypatch.setattr(wfst, "PAIRS", 10)
    small = wfst.Transducer(open(public_tokenizers.path(MODEL), "rb").read())
    text = " ".join(f"word{i}" for i in range(200))
    assert small.encode(text).tolist() == LIBRARY.encode(text)
    assert len(small.paths) <= 10 and len(small.apart) <= 10
