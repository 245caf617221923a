"""Op 12 — Merkle manifest of a dataset by checkpoint and recompute.

Every row is a leaf, every source a tree of fan-out 16, and a last tree of
the same kind stands over the sources.  Levels are handled two at a time: an
aligned block of 256 nodes has a top two levels higher, and only leaves and
such tops are kept; the level between is never stored.  A proof needs nodes of
every level: extraction goes from the root down, joins each stored block with
the path of its top, computes the missing level of that block again, gives
each of its nodes the siblings of two more levels, and drops the rest.

Order inside a source comes from a range partitioning, so a hot source lies in
many tasks: a task numbers its own rows, and one row per partition tells how
many rows of its first source lie before it.  Texts are hashed where they are
read; only ids and digests are shuffled, and no group holds more than 256
nodes.

Results: ``manifest`` gives the stored levels and the root (``save`` and
``load`` keep them), ``proofs`` the path of every row or of those asked for
(siblings before and after, per level), ``verify`` folds leaves along paths,
``changed`` names the rows in which a table differs from a manifest.

Edge cases: null ids come first, rows of one id go by their digest, repeated
rows are leaves of their own; a null source is a source of its own, before all
others; null fields hash as ``-``; a lone leaf is its source's subroot and a
lone subroot the root; an empty table has no root and gives no rows; columns
that are not fields are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.llm.common import read_table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 16
BLOCK = FAN_OUT * FAN_OUT
DIGEST = 64
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(field: Callable[[str], Column], fields=FIELDS) -> Column:
    """Digest of a row: each field as byte count, colon and value."""
    def encoded(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*[encoded(field(f)) for f in fields])


def lower_ascii(c: Column) -> Column:
    return F.translate(c, CAPITALS, CAPITALS.lower())


def tree_key(source: Column) -> Column:
    """A source as a key that is never null; a null one sorts first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


# -- positions ---------------------------------------------------------------

def counted_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree, each with its partition and its number among the
    rows of its tree in this partition."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    last, held = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        trees = b.column("tree")
        change = np.ones(b.num_rows, bool)
        change[1:] = pc.not_equal(trees.slice(1), trees.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        change[0] = trees[0].as_py() != last
        at = np.arange(b.num_rows)
        start = np.maximum.accumulate(np.where(change, at, -1))
        local = np.where(start >= 0, at - start, at + held)
        last, held = trees[-1].as_py(), int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(local)],
                                         names=[*b.schema.names, "part", "local"])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``position``, the row's number from 0 among the rows of its
    ``tree`` in the given order, written."""
    spread = df.withColumn("tie", F.monotonically_increasing_id())  # equal rows may be split
    keys = ["tree", *order, "tie"]
    schema = T.StructType([*spread.drop("tie").schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    placed = written(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
                     .mapInArrow(counted_in_task, schema), name)
    ends = placed.groupBy("part").agg(F.min("tree").alias("first"), F.max(F.struct("tree", "local")).alias("last"))
    before, carry, open_tree = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r.part):  # one row per partition
        if r.first == open_tree:
            before.append((r.part, r.first, carry))
        here = carry if r.first == open_tree and r.first == r.last.tree else 0
        open_tree, carry = r.last.tree, here + r.last.local + 1
    carried = df.sparkSession.createDataFrame(before, "part int, tree string, carried long")
    return (placed.join(F.broadcast(carried), ["part", "tree"], "left")  # at most one row per partition
            .withColumn("position", F.col("local") + F.coalesce("carried", F.lit(0))).drop("part", "local", "carried"))


# -- blocks ------------------------------------------------------------------

def blocks_of(nodes: DataFrame) -> DataFrame:
    """``tree, block, entries``: aligned blocks of nodes in order.  ``nodes``
    has ``tree, position, node`` and what else goes along."""
    others = [c for c in nodes.columns if c not in ("tree", "position", "node")]
    entry = F.struct("position", "node", *others)
    return (nodes.groupBy("tree", F.floor(F.col("position") / BLOCK).cast("long").alias("block"))
            .agg(F.sort_array(F.collect_list(entry)).alias("entries")))  # BLOCK entries at most


def runs(nodes: Column) -> Column:
    """The joined digests of each run of ``FAN_OUT`` nodes."""
    last = F.floor((F.size(nodes) - 1) / FAN_OUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last),
                       lambda r: F.array_join(F.slice(nodes, r * FAN_OUT + 1, F.lit(FAN_OUT)), ""))


def with_levels(blocks: DataFrame) -> DataFrame:
    """Blocks with ``lower``, the runs of their nodes, ``upper``, the joined
    digests one level up, and ``levels``, how many levels lie between the
    nodes and the top.  A block that is a whole tree ends as soon as one node
    is left; a tree has other blocks only if its first one is full."""
    size = F.size("entries")
    levels = F.when((F.col("block") > 0) | (size > FAN_OUT), 2).when(size > 1, 1).otherwise(0)
    nodes = F.transform("entries", lambda e: e["node"])
    return (blocks.withColumn("levels", levels).withColumn("lower", runs(nodes))
            .withColumn("upper", F.array_join(F.transform("lower", lambda r: F.sha2(r, 256)), "")))


def tops(blocks: DataFrame) -> DataFrame:
    """``tree, position, node`` of the blocks' tops: nodes two levels up."""
    top = (F.when(F.col("levels") == 2, F.sha2("upper", 256)).when(F.col("levels") == 1, F.col("upper"))
           .otherwise(F.element_at("lower", 1)))
    return with_levels(blocks).select("tree", F.col("block").alias("position"), top.alias("node"))


def step(run: Column, at: Column) -> Column:
    """Siblings of the node at place ``at`` of a run."""
    return F.struct(F.substring(run, F.lit(1), at * DIGEST).alias("before"),
                    F.substring(run, at * DIGEST + DIGEST + 1, F.lit(FAN_OUT * DIGEST)).alias("after"))


def lowered(blocks: DataFrame, paths: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Paths of the blocks' nodes from those of their tops: the level between
    is computed again, gives its siblings and goes.  With ``asked`` (tree,
    position) only those nodes, from their blocks alone."""
    if asked is not None:
        blocks = blocks.join(lifted(asked).withColumnRenamed("position", "block"), ["tree", "block"], "left_semi")
    above = paths.select("tree", F.col("position").alias("block"), "path", "subroot", "root")
    entry = F.posexplode("entries").alias("at", "entry")
    rows = with_levels(blocks.join(above, ["tree", "block"])).select(
        "tree", "levels", "lower", "upper", "path", "subroot", "root", entry)
    run = F.floor(F.col("at") / FAN_OUT).cast("int")
    near = step(F.element_at("lower", run + 1), F.col("at") % FAN_OUT)
    far = step(F.col("upper"), run)
    path = F.concat(F.when(F.col("levels") > 0, F.array(near)).otherwise(F.array().cast(f"array<{STEP}>")),
                    F.when(F.col("levels") > 1, F.array(far)).otherwise(F.array().cast(f"array<{STEP}>")), "path")
    out = rows.select("tree", "entry.*", path.alias("path"), "subroot", "root")
    return out if asked is None else out.join(asked, ["tree", "position"], "left_semi")


def lifted(nodes: DataFrame) -> DataFrame:
    """``tree, position`` of the tops over nodes."""
    return nodes.select("tree", F.floor(F.col("position") / BLOCK).cast("long").alias("position")).distinct()


def nodes_where(blocks: DataFrame, field: str, wanted: DataFrame) -> DataFrame:
    """``tree, position`` of the entries whose ``field`` is in the one column of ``wanted``."""
    values = wanted.toDF("wanted").distinct()
    entries = blocks.select("tree", F.explode("entries").alias("e")).select("tree", "e.position", F.col(f"e.{field}").alias("value"))
    return entries.join(values, F.col("value").eqNullSafe(F.col("wanted")), "left_semi").select("tree", "position")


# -- manifest ----------------------------------------------------------------

@dataclass
class Manifest:
    """``levels[0]`` the leaves in blocks, the others blocks of tops, each two
    levels above the one before; ``over`` the same for the tree over the
    sources; ``root`` one row with ``node``, none if there are no rows."""
    levels: list[DataFrame]
    over: list[DataFrame]
    subroots: DataFrame
    root: DataFrame

    def save(self, path: str) -> None:
        """All that is kept, as Parquet under ``path``."""
        tables = {"subroots": self.subroots, "root": self.root}
        tables |= {f"{kind}-{2 * k}": b for kind in ("levels", "over") for k, b in enumerate(getattr(self, kind))}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        counts = self.root.sparkSession.createDataFrame([(len(self.levels), len(self.over))], "levels int, over int")
        counts.write.mode("overwrite").parquet(f"{path}/layout")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        counts = spark.read.parquet(f"{path}/layout").first()
        kept = [[spark.read.parquet(f"{path}/{kind}-{2 * k}") for k in range(counts[kind])] for kind in ("levels", "over")]
        return cls(*kept, spark.read.parquet(f"{path}/subroots"), spark.read.parquet(f"{path}/root"))


def stored_levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every other level, written, and the last nodes."""
    kept = []
    while True:
        kept.append(written(blocks_of(nodes), f"{name}-{2 * len(kept)}"))
        nodes = tops(kept[-1])
        if not kept[-1].where("block > 0").take(1):
            return kept, nodes


def manifest(df: DataFrame, fields=FIELDS, id_col: str = "doc_id", source_col: str = "source",
             tampered: Callable[[Callable], Column] | None = None) -> Manifest:
    """Trees over ``df``, one a source, in the order of ids.  With ``tampered``
    leaves also carry the digest that it gives as ``other``."""
    def own(f: str) -> Column:
        return F.col(f"`{f}`")

    leaves = df.select(tree_key(own(source_col)).alias("tree"), own(id_col).alias("doc_id"), leaf_of(own, fields).alias("node"),
                       (tampered(own) if tampered else F.lit(None).cast("string")).alias("other"))
    hashed = written(leaves, "merkle-hashed")  # ranges are sampled: texts would be read and hashed twice
    levels, last = stored_levels(numbered(hashed, ["doc_id", "node"], "merkle-leaves"), "merkle")
    subroots = written(last.select("tree", "node"), "merkle-subroots")
    # The order by source is that of one tree: keys go along as its rows' order.
    one = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_key"), "node")
    over, root = stored_levels(numbered(one, ["source_key"], "merkle-order"), "merkle-over")
    return Manifest(levels, over, subroots, root)


def proofs(m: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id, leaf, other, position, path, subroot, root`` of every leaf, or
    of those whose ids are in the one column of ``wanted``: then only the
    blocks on their paths are joined and recomputed.  ``path`` has a step per
    level, leaf first: the siblings' digests before and after, joined."""
    asked: list[DataFrame | None] = [None] * len(m.levels)
    asked_over: list[DataFrame | None] = [None] * len(m.over)
    if wanted is not None:
        asked[0] = written(nodes_where(m.levels[0], "doc_id", wanted), "merkle-asked")
        asked_over[0] = nodes_where(m.over[0], "source_key", asked[0].select("tree"))
        for nodes in (asked, asked_over):
            for k in range(1, len(nodes)):
                nodes[k] = lifted(nodes[k - 1])
    none = F.array().cast(f"array<{STEP}>")
    paths = m.root.select("tree", "position", none.alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for blocks, nodes in zip(reversed(m.over), reversed(asked_over)):
        paths = lowered(blocks, paths, nodes)
    paths = paths.select(F.col("source_key").alias("tree"), F.lit(0).cast("long").alias("position"), "path",
                         F.col("node").alias("subroot"), "root")
    for blocks, nodes in zip(reversed(m.levels), reversed(asked)):
        paths = lowered(blocks, paths, nodes)
    return paths.select("doc_id", F.col("node").alias("leaf"), "other", "position", "path", "subroot", "root")


def changed(m: Manifest, df: DataFrame, fields=FIELDS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``source, doc_id, before, after``: the leaves in which ``df`` differs
    from the manifest, ``before`` null for rows that are new and ``after`` for
    rows that are gone.  Sources whose subroot is the same are not compared."""
    now = manifest(df, fields, id_col, source_col)
    roots = m.subroots.select("tree", F.col("node").alias("old")).join(
        now.subroots.select("tree", F.col("node").alias("new")), "tree", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("tree")

    def leaves(of: Manifest, side: int) -> DataFrame:
        e = of.levels[0].join(roots, "tree", "left_semi").select("tree", F.explode("entries").alias("e"))
        return e.select("tree", "e.doc_id", F.col("e.node").alias("node"), F.lit(side).alias("side"))

    # repeated rows: each digest counts as often as it occurs on either side
    both = leaves(m, -1).unionByName(leaves(now, 1)).groupBy("tree", "doc_id", "node").agg(F.sum("side").alias("more")).where("more != 0")
    source = F.when(F.col("tree") != "", F.substring("tree", F.lit(2), F.length("tree")))
    gone, new = (both.where(F.col("more") * side > 0).select("tree", "doc_id", F.col("node").alias(name), F.row_number().over(
        Window.partitionBy("tree", "doc_id").orderBy("node")).alias("nth")) for side, name in ((-1, "before"), (1, "after")))
    same = (F.col("b.tree") == F.col("a.tree")) & F.col("b.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("b.nth") == F.col("a.nth"))
    out = gone.alias("b").join(new.alias("a"), same, "full").select(
        F.coalesce("b.tree", "a.tree").alias("tree"), F.coalesce("b.doc_id", "a.doc_id").alias("doc_id"), "before", "after")
    return out.select(source.alias("source"), "doc_id", "before", "after")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def verify(proven: DataFrame) -> DataFrame:
    """``proven`` with ``folded_root``, from ``other`` where there is one, else
    from ``leaf``, and ``verified``, whether it is the root."""
    root = folded(F.coalesce("other", "leaf"), F.col("path"))
    return proven.withColumn("folded_root", root).withColumn("verified", F.col("folded_root") == F.col("root"))


def digests(checked: DataFrame) -> DataFrame:
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                          "folded_root", "verified")


def lower_cased_fifth(field: Callable[[str], Column]) -> Column:
    """The tampering of the registered query: rows whose id's crc32 five
    divides have their text's A-Z in lower case."""
    hit = F.crc32(field("doc_id").cast("string")) % 5 == 0
    return F.when(hit, leaf_of(lambda f: lower_ascii(field(f)) if f == "text" else field(f)))


def checked_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return digests(verify(proofs(manifest(docs, tampered=lower_cased_fifth))))


# -- SQL -----------------------------------------------------------------------

def oracle(levels: int = 5) -> str:
    """DuckDB SQL of the registered query for up to ``16 ** levels`` leaves a
    source and as many sources.  crc32 by its definition, bit by bit."""
    def enc(e: str) -> str:
        return f"coalesce(octet_length(encode(CAST({e} AS VARCHAR))) || ':' || {e}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(enc, FIELDS[:4]), enc(text)]) + ")"

    def climb(name: str, start: str) -> list[str]:
        """CTEs of the levels over ``start`` (tree, pos, node): runs, then nodes."""
        out = [f"{name}0 AS ({start})"]
        for k in range(levels):
            out.append(
                f"{name}r{k} AS (SELECT tree, pos // 16 AS run, count(*) AS n, string_agg(node, '' ORDER BY pos) AS nodes, "
                f"any_value(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k}) GROUP BY tree, pos // 16)")
            out.append(f"{name}{k + 1} AS (SELECT tree, run AS pos, CASE WHEN c = 1 THEN nodes ELSE sha256(nodes) END AS node FROM {name}r{k})")
        return out

    def others(name: str, k: int, pos: str) -> str:
        at = f"(({pos} // CAST(power(16, {k}) AS BIGINT)) % 16)"
        return f"CASE WHEN {name}{k}.c = 1 THEN NULL ELSE [left({name}{k}.nodes, 64 * {at}), substr({name}{k}.nodes, 64 * {at} + 65)] END"

    def joins(name: str, key: str, pos: str) -> str:
        return " ".join(f"JOIN {name}r{k} {name}{k} ON {name}{k}.tree = {key} AND {name}{k}.run = {pos} // CAST(power(16, {k + 1}) AS BIGINT)"
                        for k in range(levels))

    steps = [*[others("t", k, "l.pos") for k in range(levels)], *[others("s", k, "o.pos") for k in range(levels)]]
    fold = "coalesce(l.other, l.node)"
    names = [f"p{i}" for i in range(2 * levels)]
    folds = [f"f0 AS (SELECT *, {', '.join(f'{s} AS {n}' for s, n in zip(steps, names))}, {fold} AS f FROM l "
             f"JOIN o ON o.key = l.tree {joins('t', 'l.tree', 'l.pos')} {joins('s', repr(''), 'o.pos')})"]
    folds = [folds[0].replace("SELECT *,", "SELECT l.doc_id, l.node AS leaf, l.tree AS tree,")]
    for i, n in enumerate(names):
        folds.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {n} IS NULL THEN f ELSE sha256({n}[1] || f || {n}[2]) END AS f) FROM f{i})")
    proof = " || ".join(f"coalesce({n}[1] || {n}[2], '')" for n in names)
    crc = "list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(CAST(doc_id AS VARCHAR)))), " \
          "lambda c, i: CASE WHEN ((xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END)) & 1) = 1 " \
          "THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END) >> 1, 3988292384) " \
          "ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END) >> 1 END)"
    low = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    ctes = [
        f"h AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS node, "
        f"CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(low)} END AS other FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM h)",
        *climb("t", "SELECT tree, pos, node FROM l"),
        f"o AS (SELECT tree AS key, node, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t{levels})",
        *climb("s", "SELECT '' AS tree, pos, node FROM o"), *folds]
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, t{levels}.node AS subroot, s{levels}.node AS root, "
            f"sha256({proof}) AS proof_sha256, f AS folded_root, f = s{levels}.node AS verified "
            f"FROM f{2 * levels} z JOIN t{levels} ON t{levels}.tree = z.tree, s{levels}")
