"""Vector helpers of the two searches: which rows take part, copies of one
vector, packed rows and the merge of block results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id long, v array<double>`` of the rows that take part: id and vector
    are there and every component is finite.  Repeated rows count once."""
    infinite = F.lit(float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).dropDuplicates(["id", "v"])


def first_copies(df: DataFrame, n: int) -> DataFrame:
    """Of each distinct vector the ``n`` smallest ids.  Copies of a vector
    score alike and ties go to smaller ids, so the others can be in no list
    of ``n - 1`` besides the query's own row."""
    order = Window.partitionBy("v").orderBy("id")
    return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def shape(df: DataFrame) -> tuple[int, int]:
    """``(rows, most components)``."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    return r.n, r.d or 0


def padded(df: DataFrame, dim: int) -> DataFrame:
    """Vectors of ``dim`` components, missing ones zero."""
    return df.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(df.schema["v"].dataType.elementType),
                                                            dim - F.size("v"))))


def sample_vectors(df: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors, first in hash order of their ids."""
    rows = df.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return np.array([r.v for r in rows], np.float64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())


def unpacked(values, dim: int, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), dim)


def spread(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A part for each id, evenly whatever the ids' steps."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


def best(found: DataFrame, k: int, order: list) -> DataFrame:
    """``query_id, rank, vec_id, score``: the first ``k`` of each query."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


FOUND = {kind: T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                             T.StructField("score", kind())]) for kind in (T.LongType, T.DoubleType)}
