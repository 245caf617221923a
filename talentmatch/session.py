"""Session, table loading and reliable scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app_name: str = "talentmatch") -> SparkSession:
    """Session for tests and local runs (a cluster passes its own)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.conf.set("spark.talentmatch.spread", str(spark.sparkContext.defaultParallelism))
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared reliable folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset and the master is local
    (tests) a private folder is created and registered.  Elsewhere a folder
    of the driver's machine would hide each executor's files from the rest,
    so an unset folder is an error.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="talentmatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written under the checkpoint folder: computed once, its
    lineage cut and its size known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over as many partitions as ``spark.talentmatch.spread``
    says, for CPU-heavy text work over a file of one split; unchanged where
    that is unset, as on a cluster, whose input comes in many splits."""
    n = int(df.sparkSession.conf.get("spark.talentmatch.spread", "0"))
    return df.repartition(n) if n else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all tasks where it comes in fewer splits: for
    tables of compact rows, of which one split becomes hours of text work.
    Rows leave through a generator, or filters on what is made of them would
    move below the exchange and run in the few tasks that read the splits."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n).select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
