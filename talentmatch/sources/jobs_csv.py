"""Job and match tables as CSV; the default-jobs bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.functions import constants as K

JOBS_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("date_scraped", T.DateType()),
])
CLEAN_JOBS_SCHEMA = T.StructType(JOBS_SCHEMA.fields + [T.StructField("is_remote", T.IntegerType())])

_READ_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "dateFormat": "yyyy-MM-dd",
                 "mode": "PERMISSIVE", "multiLine": "true"}
_WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "dateFormat": "yyyy-MM-dd",
                  "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def normalise_missing(df: DataFrame) -> DataFrame:
    """Missing-value sentinels ('N/A', 'NA', 'null', '' ...) become NULL in
    every string column, as a pandas CSV read does."""
    na = list(K.CSV_NA_VALUES)
    return df.select(*[
        F.when(F.col(f.name).isin(na), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields])


def read_jobs_csv(spark: SparkSession, path: str, schema: T.StructType = JOBS_SCHEMA) -> DataFrame:
    """A1: header CSV with a fixed schema (never inferred); quoted values may
    hold line feeds, so a file is read by one task: land many files, and keep
    Parquet between stages."""
    return normalise_missing(spark.read.options(**_READ_OPTIONS).schema(schema).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", *,
              bucket_by: str | None = None, buckets: int = 0) -> None:
    """A2/A3: header CSV, values written verbatim (no whitespace trimming).

    With ``bucket_by``/``buckets`` the rows go to ``bucket=<n>`` folders by a
    hash of that column, one task and file per bucket (choose ``buckets`` by
    the table's size); one résumé's rows land in one folder."""
    w = df
    if bucket_by and buckets > 0:
        w = df.withColumn("bucket", F.pmod(F.xxhash64(bucket_by), F.lit(buckets)))
    writer = w.write.mode(mode).options(**_WRITE_OPTIONS)
    if bucket_by and buckets > 0:
        writer = w.repartition(buckets, "bucket").write.mode(mode).options(**_WRITE_OPTIONS).partitionBy("bucket")
    writer.csv(path)


def empty_jobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], JOBS_SCHEMA)


def jobs_or_default(jobs: DataFrame) -> DataFrame:
    """The job table, or the three default jobs when it has no rows.

    The emptiness test is a ``limit(1)`` anti join, so nothing is counted
    and the defaults are a 3-row literal."""
    spark = jobs.sparkSession
    defaults = spark.createDataFrame(list(K.DEFAULT_JOBS), "title string, company string, "
                                     "location string, link string")
    any_row = jobs.select(F.lit(1).alias("_k")).limit(1)
    fallback = defaults.withColumn("_k", F.lit(1)).join(any_row, "_k", "left_anti").drop("_k")
    return jobs.unionByName(fallback, allowMissingColumns=True)
