"""A text encoder trained on the jobs, for dense matching of texts.

Latent semantic analysis.  With ``A`` the jobs' TF-IDF rows (jobs x terms),
the encoder spans ``A``'s leading right singular vectors, so terms that occur
together point the same way.  They are found by randomized subspace iteration:
every term starts with a direction drawn from its hash, and a round is

    Y = A Q      a dense row per job
    Z = A' Y     a dense row per term
    Q = Z W      columns made orthonormal by the eigenvectors of Z'Z

Jobs are packed into blocks once.  In a round a task holds its own blocks and
streams the blocks of ``Q`` past them; ``Y`` stays in the task, ``Z`` leaves it
as one partial sum per term, so neither the jobs nor ``Y`` are shuffled.  The
driver sees ``Z'Z`` alone, a square of ``dim + OVERSAMPLE`` numbers a side.
The blocks, each round's ``Z`` and the model are written to the shared
checkpoint folder, which cuts the lineage.

A text's vector is the TF-IDF sum of its terms' rows.  Unknown terms add
nothing, a text without known terms is the zero vector (cosine 0).  The result
does not depend on the layout beyond the last bits of its sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.functions import constants as K
from talentmatch.operators import tfidf
from talentmatch.operators.blockmatch import packed
from talentmatch.operators.match import match_dense, with_text
from talentmatch.operators.termblocks import MODEL_ROWS, TEXT_ROWS, column, entries, flat, met
from talentmatch.session import written as _written

DIM = 32
ROUNDS = 3
OVERSAMPLE = 8
#: Directions with less than this share of the leading one's energy are noise.
LEAST_SHARE = 1e-14


def _matrix(model: pa.Table, width: int) -> np.ndarray:
    return flat(model, "v").to_numpy(zero_copy_only=False).reshape(len(model), width)


def _sums(to: np.ndarray, weight: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows: the weighted sums of ``rows[at]`` by ``to``, a column at a time."""
    return np.stack([np.bincount(to, weight * rows[at, c], n) for c in range(rows.shape[1])], axis=1).astype(float)


def _round(texts: DataFrame, q: DataFrame, width: int) -> DataFrame:
    """``term, v``: A'(A Q), summed in each task first."""
    def product(blocks, model):
        v = _matrix(model, width)
        z, seen = np.zeros(v.shape), np.zeros(len(v), bool)
        for block in blocks:
            row, place, weight = entries(block, "weights", model)
            y = _sums(row, weight, v, place, len(block))
            z += _sums(place, weight, y, row, len(v))
            seen[place] = True
        at = np.flatnonzero(seen)
        for part in np.split(at, range(MODEL_ROWS, len(at), MODEL_ROWS)):
            yield pa.RecordBatch.from_pydict({"term": column(model, "id").take(pa.array(part)), "v": _vectors(z[part])})

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    sums = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]
    parts = met(texts, q, ["v"], product, schema)
    return parts.groupBy("term").agg(*sums).select("term", F.array(*[f"v{i}" for i in range(width)]).alias("v"))


def _vectors(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Z'Z: a partial square per task, summed by Spark."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for f in frames:
            z = np.stack(f["v"].to_numpy()) if len(f) else np.zeros((0, width))
            total += z.T @ z
        yield pd.DataFrame({"i": range(width), "g": list(total)})

    sums = [F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(width)]
    out = np.zeros((width, width))
    for r in rows.select("v").mapInPandas(partial, "i int, g array<double>").groupBy("i").agg(*sums).collect():  # width rows
        out[r.i] = [r[f"g{j}"] for j in range(width)]
    return (out + out.T) / 2


def _turned(rows: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """``key, v``: the rows times a small matrix."""
    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({key: f[key], "v": list(np.stack(f["v"].to_numpy()) @ turn)})

    return rows.select(key, "v").mapInPandas(product, f"{key} string, v array<double>")


def _orthonormal(gram: np.ndarray, keep: int) -> np.ndarray:
    """The matrix that makes the ``keep`` leading directions orthonormal; the
    columns of directions that are only noise are zero."""
    value, vector = np.linalg.eigh(gram)
    order = np.argsort(-value)[:keep]
    value, vector = value[order], vector[:, order]
    real = value > max(value.max(initial=0), 0) * LEAST_SHARE
    vector *= np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])])
    return np.where(real, vector / np.sqrt(np.where(real, value, 1)), 0)


@dataclass
class TextEncoder:
    """``model``: (term, idf, v), a row per term of the vocabulary."""
    model: DataFrame
    dim: int

    def encode(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """``(id_col, vec)`` of every document."""
        # texts of one id are one text; what is shuffled are their counts
        counts = tfidf.term_counts(docs, id_col, text_col).groupBy("id").agg(F.flatten(F.collect_list("counts")).alias("c"))
        texts = packed(counts.select("id", F.col("c.term").alias("terms"), F.col("c.tf").alias("tf")), TEXT_ROWS, "t")

        def product(blocks, model):
            v, idf = _matrix(model, dim), model["idf"].to_numpy()
            for block in blocks:
                row, place, tf = entries(block, "tf", model)
                yield pa.RecordBatch.from_pydict({id_col: column(block, "id"), "vec": _vectors(_sums(row, tf * idf[place], v, place, len(block)))})

        dim = self.dim
        schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("vec", T.ArrayType(T.DoubleType()))])
        return met(texts, self.model, ["idf", "v"], product, schema)

    def save(self, path: str) -> None:
        self.model.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> TextEncoder:
        model = spark.read.parquet(path)
        first = model.select(F.size("v").alias("n")).first()
        return cls(model, first.n if first else 1)


def fit_encoder(docs: DataFrame, dim: int = DIM, rounds: int = ROUNDS, *, id_col: str = "job_id", text_col: str = "text") -> TextEncoder:
    """An encoder of ``dim`` components from the documents that have text."""
    docs = with_text(docs, text_col)
    width = dim + OVERSAMPLE
    idf = _written(tfidf.fit_idf(docs, text_col), "encoder-idf")
    texts = _written(packed(tfidf.vectors(tfidf.term_counts(docs, id_col, text_col), idf), TEXT_ROWS, "t"), "encoder-texts")

    def start(i: int) -> Column:
        return F.xxhash64("term", F.lit(i)) / F.lit(2.0 ** 63)

    q = idf.select("term", F.array(*[start(i) for i in range(width)]).alias("v"))
    for k in range(rounds):
        z = _written(_round(texts, q, width), f"encoder-{k}")
        q = _turned(z, "term", _orthonormal(_gram(z, width), dim if k == rounds - 1 else width))
    return TextEncoder(_written(idf.join(q, "term"), "encoder-model"), dim)


def match_semantic(resumes: DataFrame, jobs: DataFrame, top_n: int = K.DEFAULT_TOP_N, *, encoder: TextEncoder | None = None,
                   dim: int = DIM, resume_id: str = "resume_id", job_id: str = "job_id", text: str = "text", **kw) -> DataFrame:
    """Top-n jobs per résumé by cosine of encoded texts, the encoder fitted on
    the jobs unless one is given: ``(resume_id, job_id, match_score, rank)``."""
    jobs = with_text(jobs, text)
    encoder = encoder or fit_encoder(jobs, dim, id_col=job_id, text_col=text)
    left = _written(encoder.encode(resumes, resume_id, text), f"encoded-{resume_id}")  # read twice
    return match_dense(left, encoder.encode(jobs, job_id, text), top_n, resume_id=resume_id, job_id=job_id, **kw)
