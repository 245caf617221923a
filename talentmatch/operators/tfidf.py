"""Model-free TF-IDF features as sparse vectors.

Tokens are lower-cased runs of two or more word characters; term frequency
is the raw count; ``idf = ln((1 + n) / (1 + df)) + 1`` is fitted on the job
side (n = job rows, df = jobs containing the term); vectors are
L2-normalised.  Terms unknown to the fitted vocabulary are dropped from the
other side before normalising.

Plan: terms are counted inside the row (sorted tokens, then the places where
the token changes), so no text is shuffled; one ``groupBy(term)`` for df
(partial aggregation absorbs hot terms) against n as a one-row aggregate; a
join on term (AQE broadcasts the vocabulary when its measured size allows,
else a sort-merge join whose hot-term partitions AQE splits); one
``groupBy(doc)`` that packs each document's own terms into arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.operators.blockmatch import packed
from talentmatch.operators.termblocks import TEXT_ROWS, column, entries, met
from talentmatch.session import spread

TOKEN = r"[\p{L}\p{N}_]{2,}"
COUNTS = "array<struct<term:string,tf:bigint>>"


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, counts)``: the distinct terms of every document with their
    number of occurrences, by term; an empty array without any token."""
    tokens = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), 0)
    d = spread(docs).select(F.col(id_col).alias("id"), F.coalesce(F.array_sort(tokens), F.array().cast("array<string>")).alias("s"))
    size = F.size("s")

    def token(i: Column) -> Column:
        return F.get(F.col("s"), i)

    firsts = F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (token(i) != token(i - 1))))
    d = d.select("id", "s", F.coalesce(firsts, F.array().cast("array<int>")).alias("p"))
    ends = F.concat(F.slice("p", 2, F.size("p")), F.array(size))
    counts = F.transform(F.arrays_zip(F.col("p").alias("a"), ends.alias("b")), lambda x: F.struct(
        token(x["a"]).alias("term"), (x["b"] - x["a"]).cast("bigint").alias("tf")))
    return d.select("id", F.when(size > 0, counts).otherwise(F.array().cast(COUNTS)).alias("counts"))


def fit_idf(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, idf)`` of all documents.  Distinct tokens are exploded straight
    from the text: a field of the counts would be computed per entry."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), 0))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = spread(docs).select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select(  # one row
        "term", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """``(id, terms, weights)`` sparse rows, L2-normalised, terms ascending,
    one per document (empty when it has no term of the vocabulary).

    A document without tokens carries a key of its own through the join, so
    such rows do not gather under one null key."""
    e = counts.select("id", F.explode_outer("counts").alias("c")).select(
        "id", "c.term", "c.tf", F.coalesce("c.term", F.concat(F.lit("\u0000"), F.col("id").cast("string"))).alias("key"))
    known = e.join(idf.select(F.col("term").alias("key"), "idf"), "key", "left").select(
        "id", F.when(F.col("idf").isNotNull(), F.struct("term", (F.col("tf") * F.col("idf")).alias("w"))).alias("e"))
    packed = known.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("e"))  # one document's own vocabulary
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    packed = packed.select("id", "e", norm.alias("norm"))
    return packed.select("id", F.col("e.term").alias("terms"), F.transform(
        "e", lambda x: F.when(F.col("norm") > 0, x["w"] / F.col("norm")).otherwise(F.lit(0.0))).alias("weights"))


def weights(vectors_: DataFrame) -> DataFrame:
    """``(id, term, weight)`` of every entry of :func:`vectors`."""
    entry = F.explode(F.arrays_zip("terms", "weights"))
    return vectors_.select("id", entry.alias("e")).select("id", F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))


def coded(vectors_: DataFrame) -> DataFrame:
    """Vectors with terms as 64-bit hashes: ``(id, codes, weights)``."""
    return vectors_.select("id", F.transform("terms", lambda t: F.xxhash64(t)).alias("codes"), "weights")


def coded_vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """The rows of ``coded(vectors(counts, idf))``, with the other columns of
    ``counts`` (functions of the id): the vocabulary streams past blocks of
    texts, so terms are not shuffled, nor texts partitioned by such a column."""
    own = ["id", *[c for c in counts.columns if c not in ("id", "counts")]]
    # texts of one id are one text
    c = counts.groupBy(*own).agg(F.array_sort(F.flatten(F.collect_list("counts"))).alias("c"))
    texts = packed(c.select(*own, F.col("c.term").alias("terms"), F.col("c.tf").alias("tf")), TEXT_ROWS, "t")

    def weighted(blocks, model):
        code, idf_ = model["code"].to_numpy(), model["idf"].to_numpy()
        for block in blocks:
            row, place, tf = entries(block, "tf", model)
            w = tf * idf_[place]
            norm = np.sqrt(np.bincount(row, w * w, len(block)))[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(block)))]), pa.int32())
            yield pa.RecordBatch.from_pydict({c: column(block, c) for c in own} | {
                "codes": pa.ListArray.from_arrays(ends, pa.array(code[place], pa.int64())),
                "weights": pa.ListArray.from_arrays(ends, pa.array(np.where(norm > 0, w / np.where(norm > 0, norm, 1), 0.0), pa.float64()))})

    schema = T.StructType([counts.schema[c] for c in own] + [T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return met(texts, idf.withColumn("code", F.xxhash64("term")), ["code", "idf"], weighted, schema)
