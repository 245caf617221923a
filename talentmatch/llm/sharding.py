"""Op 9 — reproducible shuffle and sharding by a Feistel permutation.

Every row gets a global row number in an order that depends only on the
rows, the number goes through a keyed permutation of ``0 .. N-1``, and the
result ``p`` gives shard ``p % n_shards`` and slot ``p div n_shards``.  Any
row's place can be computed from its number, N and the seed alone; shard
sizes differ by one row at most (law ``rows``).

Global numbers need no global sort: rows are hashed into a fixed number of
buckets, bucket totals (``N_BUCKETS`` rows at most) give each bucket's first
number, and a window numbers the rows inside a bucket.  Rows that agree in
every carried column are counted first (map-side), numbered as one block and
spread out again afterwards, so a row that repeats for a third of the table
never sits in one task.

Native: DataFrame functions only.

Edge cases: null text counts as empty (size 8, crc32 0); null ids are
ordinary values; repeated rows each get a place of their own; an empty table
gives an empty result; extra columns are ignored, or carried inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed, so that the order never depends on the cluster or the input size.
N_BUCKETS = 4096
ROUNDS = 6
#: Each walk step ends inside 0..N-1 with probability over one half.
MAX_WALK = 96
#: Copies of one row that a single task writes out.
COPY_BLOCK = 1 << 16


def feistel(x: Column, total: Column, seed: int) -> Column:
    """Keyed permutation of ``0 .. total-1``: a Feistel network over the
    smallest binary domain that holds ``total``, walked along its cycle until
    it falls below ``total`` again."""
    bits = F.greatest(F.lit(2), F.length(F.bin(total - 1)))
    low_bits = bits - F.floor(bits / 2).cast("int")
    one = F.lit(1).cast("long")

    def power(n: Column) -> Column:
        return F.call_function("shiftleft", one, n)

    low = power(low_bits) - 1
    high = power(bits - low_bits) - 1
    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))

    def mixed(half: Column, i: Column) -> Column:
        return F.xxhash64(half, i, F.lit(seed).cast("long"))

    def step(s: Column, i: Column) -> Column:
        mask = F.when(i % 2 == 0, high).otherwise(low)
        return F.struct(s["r"].alias("l"),
                        s["l"].bitwiseXOR(mixed(s["r"], i).bitwiseAND(mask)).alias("r"))

    def once(v: Column) -> Column:
        start = F.struct(F.call_function("shiftright", v, low_bits).alias("l"),
                         v.bitwiseAND(low).alias("r"))
        return F.aggregate(rounds, start, step,
                           lambda s: F.call_function("shiftleft", s["l"], low_bits).bitwiseOR(s["r"]))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_WALK)), once(x.cast("long")),
                         lambda y, _: F.when(y < total, y).otherwise(once(y)))
    return F.when(walked < total, walked).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_rows(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
               seed: int = 20240229, carry_row: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every
    row, and with ``carry_row`` the whole input row as the struct ``row``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"),
                     (F.octet_length(text) + 8).cast("long").alias("size"),
                     F.crc32(text).alias("text_crc32"),
                     *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry_row else []))
    identity = rows.columns
    blocks = (rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies"))
              .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(N_BUCKETS)).cast("int")))
    by_bucket = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = (blocks.groupBy("bucket").agg(F.sum("copies").alias("n"))
              .select("bucket", (F.sum("n").over(by_bucket) - F.col("n")).alias("first"),
                      F.sum("n").over(Window.partitionBy()).alias("total")))
    inside = (Window.partitionBy("bucket").orderBy(*identity)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = (blocks.withColumn("before", F.sum("copies").over(inside) - F.col("copies"))
                .join(F.broadcast(firsts), "bucket")  # N_BUCKETS rows at most
                .withColumn("part", F.explode(F.sequence(
                    F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPY_BLOCK)))))
    spread = numbered.repartition("bucket", "part")
    copy = F.explode(F.sequence(
        F.col("part") * COPY_BLOCK,
        F.least(F.col("copies"), (F.col("part") + 1) * COPY_BLOCK) - 1)).alias("copy")
    placed = (spread.select(*identity, "first", "before", "total", copy)
              .withColumn("place", feistel(F.col("first") + F.col("before") + F.col("copy"), F.col("total"), seed)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *identity[3:])


def write_shards(df: DataFrame, path: str, n_shards: int, rows_per_file: int = 1_000_000, **kwargs) -> None:
    """Whole rows as Parquet under ``shard=<n>/``, in slot order, a file for
    each run of ``rows_per_file`` slots."""
    out = shard_rows(df, n_shards, carry_row=True, **kwargs)
    run = F.floor(F.col("slot") / rows_per_file)
    (out.select("shard", "slot", "row").repartition(F.col("shard"), run)
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
