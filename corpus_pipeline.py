"""A training corpus from ``documents``: toxic texts go, one document of each
near-duplicate group stays, secrets are blanked, and the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet into the folder that ``spark.checkpoint.dir`` names and
read again as the next one's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmatch.llm import neardup, packing, secret_scan, toxicity
from talentmatch.llm.common import free_name, read_table, written

#: Cell-exact SQL cannot express trained models or tokenizers.
ORACLE_SQL = None
SEQUENCE, END_ID = 1024, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict as toxic.  The model
    learns from the labels of these documents that training may see."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "score")
    return docs.withColumn(score, toxicity.score_column(model)(F.coalesce("text", F.lit("")))).where(
        F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of the smallest id; ids may be
    null or stand on several texts.  Rows without words all stay."""
    surplus = neardup.surplus(docs).withColumnsRenamed({"doc_id": "other_id", "mark": "other_mark"})
    same = docs["doc_id"].eqNullSafe(F.col("other_id")) & (neardup.text_mark() == F.col("other_mark"))
    alone = docs.join(surplus, same, "left_anti")
    repeated = surplus.where("first")
    if repeated.isEmpty():
        return alone
    copies = docs.join(repeated, same, "left_semi").groupBy("doc_id", neardup.text_mark().alias("mark"))
    return alone.unionByName(copies.agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark and ``n_chars`` counted anew."""
    clean = secret_scan.redact(docs, secret_scan.fit(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its token ids, which sequence takes it, and where."""
    return packing.pack(docs, SEQUENCE, END_ID, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", blank_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
