"""Op 8: counts against the tokenizer library over whole texts."""
from __future__ import annotations

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from talentmatch.llm import queries, tokencount
from talentmatch.llm.common import read_table

WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_matches_library(spark, small_sf):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, small_sf, "documents").collect()}
    rows = queries.op8_token_counts(spark, small_sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(WORD.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab É́ß' s1.\n\t \x1c<|endoftext|>漢́")))
def test_cut_places_are_safe(text):
    pieces = list(tokencount.safe_pieces(text, 2))
    assert "".join(pieces) == text
    for tok in (WORD, BYTE):
        whole = tok.encode(text, add_special_tokens=False).ids
        assert [i for p in pieces for i in tok.encode(p, add_special_tokens=False).ids] == whole


def test_edge_rows(spark):
    long = "word <|endoftext|> é " * 20000
    solid = "x" * 50000
    df = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, long, 5), (2, long, 5), (3, solid, 5)],
                               "doc_id long, text string, n_tokens int")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tok = Tokenizer.from_file(public_tokenizers.path(name))
        got = sorted((r.doc_id or 0, r.n_tokens) for r in tokencount.count_tokens(df, name, 10, piece_chars=100,
                                                                                 batch_bytes=1000).collect())
        n = len(tok.encode(long, add_special_tokens=False).ids)
        assert got == [(0, 0), (1, 0), (2, n), (2, n), (3, len(tok.encode(solid, add_special_tokens=False).ids))]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, "piece_bpe_32k.model", 10).collect()}
    assert got[2] == len(sp.encode(long)) and got[3] == len(sp.encode(solid))
    assert tokencount.count_tokens(df.limit(0), "word_bpe_49k.json", 10).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB É́ß' s1.\n\t \x1c<|endoftext|>漢\u00a0"), max_size=30), max_size=6))
def test_remembered_words_change_nothing(texts):
    for name, tok in (("word_bpe_49k.json", WORD), ("byte_bpe_50k.json", BYTE)):
        want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
        assert tokencount.counted(texts, name, 50, 4) == want


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 20)
    texts = [" ".join(f"word{i}x{k}" for i in range(15)) for k in range(9)]
    got = [tokencount.counted([t], "word_bpe_49k.json", 1000, 100)[0] for t in texts]
    assert got == [len(WORD.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(tokencount._KNOWN["word_bpe_49k.json"]) <= 20
