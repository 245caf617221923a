"""Op 6 — toxicity: subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed into
``BUCKETS`` rows).  A text is the mean of its distinct words and of
``PADDING`` zero vectors, so that neither repetition nor a handful of words
decides; a linear softmax over two classes reads the text vector.  Vectors
and softmax are trained jointly, in numpy, from at most ``PER_CLASS``
labelled documents of either class, the first in hash order.  A misspelt or
inflected word that training never saw still shares n-grams with those it did.
A word of more than ``LONGEST_WORD`` characters, as unspaced scripts have,
counts as overlapping windows of ``WINDOW`` that hold all its n-grams.

The model is linear above the n-grams, so scoring needs one number per n-gram.
It is one narrow pass over whole texts.

Edge cases: null text and text without words score by the constant alone;
labels that are null, and labelled ids without a document, train nothing;
ids may repeat, each row is scored on its own; without labels of both classes
the score follows the share of toxic labels (one half without any); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 4
PADDING = 40
#: Share of the toxic texts in the loss, whatever their number.
TOXIC_SHARE = 0.45
PER_CLASS = (3000, 1500)
STEPS, RATE, DECAY = 50, 0.5, 1e-6
#: Distinct words whose numbers a process keeps between texts.
CACHE = 600_000
LONGEST_WORD, WINDOW = 40, 12


def grams(word: str) -> list[int]:
    """Buckets of the word's n-grams and of the word itself."""
    raw = f"<{word}>"
    found = [raw[i:i + n] for n in GRAMS for i in range(len(raw) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in (*found, "=" + word)]


def words_of(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    if max(map(len, words), default=0) > LONGEST_WORD:
        shared = max(GRAMS) - 1
        for w in [w for w in words if len(w) > LONGEST_WORD]:
            words.remove(w)
            words.update(w[i:i + WINDOW] for i in range(0, len(w) - shared, WINDOW - shared))
    return words


@dataclass
class SubwordModel:
    """Per bucket its share of the log-odds, and the constant."""

    weight: np.ndarray
    constant: float

    def __post_init__(self):
        self.cache: dict[str, float] = {}
        self.table: list[float] = []

    def word(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.table = self.table or self.weight.tolist()
            own = grams(word)
            found = self.cache[word] = sum([self.table[g] for g in own]) / len(own)
        return found

    def score(self, text: str | None) -> float:
        words = words_of(text)
        known = self.cache.get
        total = math.fsum(self.word(w) if (x := known(w)) is None else x for w in words)  # in any order
        odds = self.constant + total / (len(words) + PADDING)
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))

    def __getstate__(self):
        return {"weight": self.weight, "constant": self.constant, "cache": {}, "table": []}


class _Bags:
    """Scaled sums of matrix rows, a bag of row numbers for each sum, and the
    way back.  Works a column at a time, which holds less memory."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray, scale: np.ndarray, n_items: int):
        self.items, self.n_items, self.n = items, n_items, len(sizes)
        self.full = np.flatnonzero(sizes)
        self.sizes = sizes[self.full]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.scale = scale[self.full].astype(np.float32)

    def forth(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, m.shape[1]), np.float32)
        if len(self.full):
            for k in range(m.shape[1]):
                out[self.full, k] = np.add.reduceat(m[:, k][self.items], self.starts) * self.scale
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_items, g.shape[1]), np.float32)
        for k in range(g.shape[1]):
            each = np.repeat(g[self.full, k] * self.scale, self.sizes)
            out[:, k] = np.bincount(self.items, each, self.n_items)
        return out


def train(texts: Iterable[list[str]], labels: list[int], steps: int = STEPS, seed: int = 3) -> SubwordModel:
    """Joint training of n-gram vectors and softmax by Adam, on the distinct
    words of each text."""
    labels = np.asarray(labels, np.int64)
    toxic = float(labels.mean()) if len(labels) else 0.5
    if not 0 < toxic < 1:
        return SubwordModel(np.zeros(BUCKETS, np.float32), float(np.log((toxic + 1e-3) / (1 - toxic + 1e-3))))
    index: dict[str, int] = {}
    word, sizes = array("i"), []
    for words in texts:
        word.extend(index.setdefault(w, len(index)) for w in words)
        sizes.append(len(words))
    word, sizes = np.array(word, np.int32), np.array(sizes, np.int32)
    gram, own = array("i"), np.zeros(len(index), np.int32)
    for k, w in enumerate(index):
        bag = grams(w)
        gram.extend(bag)
        own[k] = len(bag)
    gram = np.array(gram, np.int32)
    used = np.flatnonzero(np.bincount(gram, minlength=BUCKETS))
    if not len(used):
        return SubwordModel(np.zeros(BUCKETS, np.float32), float(np.log(toxic / (1 - toxic))))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    of_words = _Bags(place[gram], own, 1 / np.maximum(1, own), len(used))
    of_texts = _Bags(word, sizes, 1 / (sizes + PADDING), len(index))
    del index, gram

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), DIMENSIONS)).astype(np.float32),
              rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32), np.zeros((1, 2), np.float32)]
    vectors, soft, bias = params
    wanted = np.eye(2, dtype=np.float32)[labels]
    weights = np.where(labels == 1, TOXIC_SHARE / (labels == 1).sum(), (1 - TOXIC_SHARE) / (labels == 0).sum())[:, None].astype(np.float32)
    mean = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        text = of_texts.forth(of_words.forth(vectors))
        odds = text @ soft + bias
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        gap = (p / p.sum(axis=1, keepdims=True) - wanted) * weights
        grads = [of_words.back(of_texts.back(gap @ soft.T)) + DECAY * vectors,
                 text.T @ gap, gap.sum(axis=0, keepdims=True)]
        for q, g, m, s in zip(params, grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            q -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-10)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = vectors @ (soft[:, 1] - soft[:, 0])
    return SubwordModel(weight, float(bias[0, 1] - bias[0, 0]))


def held_out(id_col: str):
    """Rows that never train: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_set(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, toxic, words`` of the labelled documents to train on, words
    joined by line feeds."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(n) for c, n in enumerate(PER_CLASS)]
    ids = picked[0].unionByName(picked[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # PER_CLASS ids

    def distinct_words(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "toxic": frame["toxic"],
                                "words": ["\n".join(sorted(words_of(t))) for t in frame["text"]]})

    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInPandas(distinct_words, f"id {kind}, toxic int, words string")
            .dropDuplicates(["id"]).select("id", "toxic", "words"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    found = sorted(training_set(docs, labels, id_col, text_col).collect(), key=lambda r: r.id)
    return train((r.words.split("\n") if r.words else [] for r in found), [r.toxic for r in found])


def score_column(model: SubwordModel):
    """A column function: the score of a text."""
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None).astype("float64")

    return score


def scored(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row."""
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"),
                       score_column(model)(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
