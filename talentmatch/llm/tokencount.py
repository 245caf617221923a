"""Op 8 — token counts by batch encoding, lengths only.

One narrow pass: an Arrow function takes the texts, cuts them where a cut
cannot change the tokens, encodes the pieces in batches of about
``batch_bytes`` bytes and gives back one number per text.  No shuffle, no ids
and no offsets leave the function.  A text whose spaces are all safe cuts is
cut at each of them, and a process remembers the counts of ``CACHE`` such
words, so it encodes a word once; other texts are cut into long pieces.

Safe cut: before a single space that stands between two characters that are
not white space.  Both kinds of pre-tokenizer in use drop that space or bind
it to the word behind it, no added token holds white space, and a space
neither composes nor decomposes under NFC.  A text without such a place, and
any text for a SentencePiece model, is encoded whole.

Edge cases: null text counts as empty (0 bytes, 0 tokens); ids may be null
or repeat, each row is counted on its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENCODERS: dict[str, tuple] = {}
_KNOWN: dict[str, dict[str, int]] = {}
CACHE = 500_000
UNSAFE = re.compile(r"\s | \s|^ | $")


def vocabulary_path(name: str) -> str:
    """A tokenizer file by name among the installed public ones, or the path
    itself if it has a folder."""
    if os.path.dirname(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(name: str) -> tuple:
    """``(count, may_cut)`` of a tokenizer file, loaded once per process."""
    if name not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary_path(name)
        if path.endswith(".model"):
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _ENCODERS[name] = (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], False)
        else:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            with open(path, encoding="utf-8") as f:
                added = json.load(f).get("added_tokens") or []
            cut = not any(a["lstrip"] or a["rstrip"] or any(c.isspace() for c in a["content"]) for a in added)
            _ENCODERS[name] = (
                lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], cut)
    return _ENCODERS[name]


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at safe places."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and at + 1 < len(text) and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 >= len(text):
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encoded(texts: list[str], count, batch_bytes: int) -> list[int]:
    """Tokens of each text, in batches of about ``batch_bytes``."""
    out: list[int] = []
    at = held = 0
    for k, text in enumerate(texts):
        held += 4 * len(text)  # at most, in UTF-8
        if held >= batch_bytes:
            out += count(texts[at:k + 1])
            at, held = k + 1, 0
    return out + (count(texts[at:]) if at < len(texts) else [])


def counted(texts: list[str], name: str, batch_bytes: int, piece_chars: int) -> list[int]:
    """Tokens of each text."""
    count, may_cut = encoder(name)
    if not may_cut:
        return encoded(texts, count, batch_bytes)
    known = _KNOWN.setdefault(name, {})
    words: list[list[str] | None] = [None if UNSAFE.search(t) else t.split(" ") for t in texts]
    new = list({w for own in words if own for w in own[1:] if w not in known})
    if len(known) + len(new) > CACHE:
        known.clear()
        new = list({w for own in words if own for w in own[1:]})
    known.update(zip(new, encoded([" " + w for w in new], count, batch_bytes)))
    # what is left: first words, and texts with other white space beside a space
    pieces = [[own[0]] if own else list(safe_pieces(t, piece_chars)) for own, t in zip(words, texts)]
    flat = iter(encoded([p for own in pieces for p in own], count, batch_bytes))
    rest = [sum(next(flat) for _ in own) for own in pieces]
    return [n + sum([known[w] for w in own[1:]]) if own else n for n, own in zip(rest, words)]


def count_tokens(df: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = 1 << 20, piece_chars: int = 1 << 15) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def lengths(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = b.column("text").to_pylist()
                sizes = pa.compute.binary_length(b.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), sizes, pa.array(counted(texts, tokenizer, batch_bytes, piece_chars), pa.int64())],
                    names=["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(lengths, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
