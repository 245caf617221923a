"""Op 11 — hard negatives by anchor-clustered shared lists.

Anchors are clustered by angle.  Per cluster the candidates form one list,
sorted once by an upper bound that holds for every member: with ``phi`` the
candidate's angle to the cluster's centre and ``theta`` the widest angle of a
member,

    a.x <= |a| |x| cos(max(0, phi - theta)).

Every member walks that list from the top, keeps what it looks for, and stops
where the bound of the next candidate falls below the least score that could
still enter its result.  That certifies the result: nothing further down can.

A list is too long for one task, so it is walked in two legs.  The head holds
the candidates nearest to the cluster's own centre.  It gives every member a
first cutoff; the rest of the list reaches a cluster only as far down as the
bound exceeds its members' least cutoff.  Inside a leg the list is dealt out
by id hash into parts of about ``BLOCK_ROWS``, each of them walked in order,
and a window merges the parts.  Both legs run for the positives (best rows of
the anchor's label) and again for the negatives (best rows of other labels
inside each positive's band of scores).

Scores are integer inner products of ``floor(scale * x)``.

Edge cases: rows with a null id, label or vector or a null or non-finite
component take no part; repeated rows count once; an id on several rows gives
an anchor each, and none of its rows is a candidate for it; shorter vectors
are padded with zeros; ties go to the smaller id; anchors without positives
and positives without rows in their band (always so below a score of 0) give
no rows; an empty table gives an empty result; other columns are ignored.  A
score beyond a long is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmatch.llm import vectors as V
from talentmatch.llm.ann import centroids_of
from talentmatch.llm.common import written

#: Anchors per cluster that are aimed at, most clusters, and the sample for their centres.
CLUSTER_ANCHORS, MOST_CLUSTERS, SAMPLE = 512, 256, 20_000
BLOCK_ANCHORS = 1024
BLOCK_ROWS = 4096
#: Candidates that members look at in one product.
STRIDE = 512
LEAST, MOST = -(2 ** 62), 2 ** 62
PLACED = {"id": "long", "label": "string", "v": "binary", "cell": "int", "angle": "double", "norm": "double"}
LISTED = {"block": "long", "part": "int", "id": "long", "label": "string", "v": "binary", "bound": "double"}
POSITIVE = {"anchor_id": "long", "row": "long", "other": "long", "score": "long"}
NEGATIVE = {"anchor_id": "long", "row": "long", "positive_id": "long", "positive_score": "long", "other": "long", "score": "long"}


def labelled(df: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, label, v array<long>`` of the rows that take part, each once."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                     F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
            .withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))).dropDuplicates(["id", "label", "v"]))


class Clusters:
    """Centres of the anchor clusters (unit vectors), and per cluster the
    widest angle of a member and its blocks."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def place(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Angles to all centres, the nearest centre, the norm."""
        norm = np.sqrt(np.einsum("ij,ij->i", f, f))
        cosine = (f @ self.centres.T) / np.where(norm > 0, norm, 1)[:, None]
        angle = np.arccos(np.clip(cosine, -1, 1))
        return angle, angle.argmin(1), norm

    def measure(self, placed_anchors: DataFrame) -> None:
        m = len(self.centres)
        self.widest, count = np.zeros(m), np.zeros(m, np.int64)
        summary = placed_anchors.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n"))
        for r in summary.collect():  # MOST_CLUSTERS rows
            self.widest[r.cell], count[r.cell] = r.angle, r.n
        self.blocks = -(-count // BLOCK_ANCHORS)
        self.first = np.cumsum(self.blocks) - self.blocks

    def bounds(self, angle: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Per row and cluster the most that a member of norm 1 can score; a
        little more than that, since angles are rounded."""
        return norm[:, None] * (np.cos(np.maximum(0, angle - self.widest - 1e-7)) + 1e-12)


def placed(df: DataFrame, clusters: Clusters, dim: int, name: str) -> DataFrame:
    """``PLACED`` rows, written."""
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = V.matrix(b.column("v"), dim)
            angle, cell, norm = clusters.place(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), V.packed(x), pa.array(cell.astype(np.int32)),
                 pa.array(angle[np.arange(len(cell)), cell]), pa.array(norm)], names=list(PLACED))

    return written(df.mapInArrow(assigned, V.ddl(PLACED)), name)


def products(a: np.ndarray, x: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products; ``whole`` where doubles hold every sum exactly."""
    return (a @ x.T).astype(np.int64) if whole else a.astype(object) @ x.astype(object).T


def walk(a: np.ndarray, x: np.ndarray, bound: np.ndarray, cutoff: np.ndarray, visit: Callable) -> int:
    """All members go down the list together; each stops where the bound says
    that nothing below can reach its ``cutoff``, which ``visit`` raises.
    Returns the number of candidates that were looked at, over all members."""
    reach = np.sqrt(np.einsum("ij,ij->i", a.astype(np.float64), a.astype(np.float64)))
    top = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    whole = top < 2 ** 53
    if whole:
        a, x = a.astype(np.float64), x.astype(np.float64)
    alive, looked = np.arange(len(a)), 0
    for at in range(0, len(x), STRIDE):
        high = reach[alive] * bound[at]
        alive = alive[(cutoff[alive] < MOST) & (high + 1e-9 * np.abs(high) + 1e-3 >= cutoff[alive])]
        if not len(alive):
            break
        looked += len(alive) * len(x[at:at + STRIDE])
        visit(alive, at, products(a[alive], x[at:at + STRIDE], whole))
    return looked


def merged(kept: list, scores: np.ndarray, ids: np.ndarray, n: int) -> list:
    """The best ``n`` of (-score, id) pairs."""
    return heapq.nsmallest(n, [*kept, *zip((-scores).tolist(), ids.tolist())])


class PositiveWalk:
    """Rows of the member's label: the best ``n``."""

    def __init__(self, a: pd.DataFrame, x: pd.DataFrame, n: int):
        codes = pd.factorize(pd.concat([a["label"], x["label"]]))[0]
        self.own, self.label = codes[:len(a)], codes[len(a):]
        self.member, self.ids, self.n = a["id"].to_numpy(), x["id"].to_numpy(), n
        self.cutoff = a["cut"].to_numpy(np.int64).copy()
        self.kept: list[list] = [[] for _ in range(len(a))]

    def __call__(self, alive: np.ndarray, at: int, scores: np.ndarray) -> None:
        here = slice(at, at + scores.shape[1])
        want = ((scores >= self.cutoff[alive][:, None]) & (self.own[alive][:, None] == self.label[here])
                & (self.member[alive][:, None] != self.ids[here]))
        for row in np.flatnonzero(want.any(1)):
            i, col = alive[row], np.flatnonzero(want[row])
            self.kept[i] = merged(self.kept[i], scores[row, col], self.ids[at + col], self.n)
            if len(self.kept[i]) == self.n:
                self.cutoff[i] = max(int(self.cutoff[i]), -self.kept[i][-1][0])

    def result(self, a: pd.DataFrame) -> pd.DataFrame:
        rows = [(m, r, i, -s) for m, r, kept in zip(a["id"], a["row"], self.kept) for s, i in kept]
        return pd.DataFrame(rows, columns=list(POSITIVE)).astype(np.int64)


def band(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and largest whole s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


class NegativeWalk:
    """Rows of other labels: for each positive of the member the best ``n``
    inside its band."""

    def __init__(self, a: pd.DataFrame, x: pd.DataFrame, n: int, low: int, high: int):
        codes = pd.factorize(pd.concat([a["label"], x["label"]]))[0]
        self.own, self.label = codes[:len(a)], codes[len(a):]
        self.member, self.ids, self.n = a["id"].to_numpy(), x["id"].to_numpy(), n
        self.kept: list[list[list]] = []
        self.bands: list[list[list[int]]] = []
        for scores, cuts in zip(a["scores"], a["cuts"]):
            bands = [band(int(s), low, high) for s in scores]
            self.bands.append([[max(least, int(c)) if least <= most else MOST, most] for (least, most), c in zip(bands, cuts)])
            self.kept.append([[] for _ in bands])
        self.cutoff = np.array([min((b[0] for b in bands), default=MOST) for bands in self.bands], np.int64)
        self.ceiling = np.array([max((b[1] for b in bands if b[0] < MOST), default=LEAST) for bands in self.bands], np.int64)

    def __call__(self, alive: np.ndarray, at: int, scores: np.ndarray) -> None:
        here = slice(at, at + scores.shape[1])
        want = ((scores >= self.cutoff[alive][:, None]) & (scores <= self.ceiling[alive][:, None])
                & (self.own[alive][:, None] != self.label[here]) & (self.member[alive][:, None] != self.ids[here]))
        for row in np.flatnonzero(want.any(1)):
            i, col = alive[row], np.flatnonzero(want[row])
            found, ids = scores[row, col], self.ids[at + col]
            for kept, limits in zip(self.kept[i], self.bands[i]):
                inside = (found >= limits[0]) & (found <= limits[1])
                if inside.any():
                    kept[:] = merged(kept, found[inside], ids[inside], self.n)
                    if len(kept) == self.n:
                        limits[0] = max(limits[0], -kept[-1][0])
            self.cutoff[i] = min(limits[0] for limits in self.bands[i])

    def result(self, a: pd.DataFrame) -> pd.DataFrame:
        rows = [(m, r, p, ps, i, -s) for m, r, ids, scores, lists in zip(a["id"], a["row"], a["positives"], a["scores"], self.kept)
                for p, ps, kept in zip(ids, scores, lists) for s, i in kept]
        return pd.DataFrame(rows, columns=list(NEGATIVE)).astype(np.int64)


def leg(anchors: DataFrame, rows: DataFrame, clusters: Clusters, dim: int, head: bool, least: np.ndarray,
        walker: Callable, schema: dict) -> DataFrame:
    """One leg of the walk: ``least`` is, per cluster, the bound below which no
    candidate can matter to a member (infinite: none is left)."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            x = V.unpacked(b.column("v").to_pylist(), dim, np.int64).astype(np.float64)
            angle, _, norm = clusters.place(x)
            cell, bound = b.column("cell").to_numpy(), clusters.bounds(angle, norm)
            own = cell[:, None] == np.arange(len(least))
            yield b, bound, np.nonzero((bound >= least) & (own if head else ~own) & (clusters.blocks > 0))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(least), np.int64)
        for _, _, (_, cluster) in listed(batches):
            total += np.bincount(cluster, minlength=len(least))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    held = np.zeros(len(least), np.int64)
    for r in rows.mapInArrow(counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # MOST_CLUSTERS rows
        held[r.cell] = r.n
    parts = np.maximum(1, -(-held // BLOCK_ROWS))
    first, blocks = clusters.first, clusters.blocks

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bound, (at, cluster) in listed(batches):
            part = V.spread(b.column("id").to_numpy()[at], parts[cluster])
            copies = np.repeat(np.arange(len(at)), blocks[cluster])
            nth = np.arange(len(copies)) - np.repeat(np.cumsum(blocks[cluster]) - blocks[cluster], blocks[cluster])
            take = pa.array(at[copies])
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[cluster[copies]] + nth), pa.array(part[copies].astype(np.int32)), b.column("id").take(take),
                 b.column("label").take(take), b.column("v").take(take), pa.array(bound[at, cluster][copies])], names=list(LISTED))

    schema_in = anchors.schema
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cell = b.column("id").to_numpy(), b.column("cell").to_numpy()
            block = first[cell] + V.spread(ids, np.maximum(1, blocks[cell]))
            n = np.where(held[cell] > 0, parts[cell], 0)
            copies = np.repeat(np.arange(len(ids)), n)
            nth = np.arange(len(copies)) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(copies)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[copies]), pa.array(nth.astype(np.int32)), *[c.take(take) for c in b.columns]],
                names=["block", "part", *b.schema.names])

    def walked(_, a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if a.empty or x.empty:
            return pd.DataFrame(columns=list(schema)).astype(np.int64)
        x = x.sort_values(["bound", "id"], ascending=[False, True], ignore_index=True)
        w = walker(a, x)
        walk(V.unpacked(a["v"], dim, np.int64), V.unpacked(x["v"], dim, np.int64), x["bound"].to_numpy(), w.cutoff, w)
        return w.result(a)

    fields = "block long, part int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema_in.fields)
    return (anchors.mapInArrow(asked, fields).groupBy("block", "part")
            .cogroup(rows.mapInArrow(dealt, V.ddl(LISTED)).groupBy("block", "part")).applyInPandas(walked, V.ddl(schema)))


def first_of(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("other"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def least_bounds(anchors: DataFrame, cut: Column, m: int) -> np.ndarray:
    """Per cluster the least of cutoff / norm: a candidate with a lower bound
    reaches no member's cutoff.  ``cut`` is ``MOST`` for members that are done."""
    ratio = F.when(cut >= MOST, float("inf")).when((F.col("norm") == 0) | (cut <= LEAST), float("-inf")).otherwise(
        (cut - F.abs(cut) * 1e-9 - 1e-3) / F.col("norm"))
    out = np.full(m, np.inf)
    for r in anchors.select("cell", ratio.alias("r")).groupBy("cell").agg(F.min("r").alias("r")).collect():  # MOST_CLUSTERS rows
        out[r.cell] = r.r
    return out


def mine(data: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each anchor and each of its ``n_positives`` best rows
    of its label the ``n_negatives`` best rows of other labels whose score is
    ``low`` to ``high`` percent of the positive's."""
    rows, asked = labelled(data, scale, id_col, vec_col, label_col), labelled(anchors, scale, id_col, vec_col, label_col)
    # Of copies of one vector and label only the smallest ids can be among the first; one may be the anchor.
    same = Window.partitionBy("label", "v").orderBy("id")
    rows = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= max(n_positives, n_negatives) + 1).drop("nth")
    dim = max(1, V.shape(rows)[1], V.shape(asked)[1])
    n = asked.count()
    rows, asked = V.padded(rows, dim), V.padded(asked, dim)

    sample = V.sample_vectors(asked, SAMPLE).reshape(-1, dim)
    sample = sample / np.maximum(1e-300, np.sqrt((sample * sample).sum(1)))[:, None]
    centres = centroids_of(sample, int(np.clip(n // CLUSTER_ANCHORS, 1, MOST_CLUSTERS))) if n else np.zeros((1, dim))
    lengths = np.sqrt((centres * centres).sum(1))
    clusters = Clusters(centres / np.where(lengths > 0, lengths, 1)[:, None])
    m = len(centres)
    rows = placed(rows, clusters, dim, "negatives-rows")
    members = placed(asked, clusters, dim, "negatives-anchors").withColumn("row", F.xxhash64("id", "label", "v"))
    clusters.measure(members)

    # Positives: how many there can be tells whether a member is done.
    per_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    members = members.join(per_label, "label", "left").withColumn(
        "wanted", F.least(F.lit(n_positives), F.coalesce("n_label", F.lit(0)) - 1).cast("int")).drop("n_label", "angle")

    def positives(a: pd.DataFrame, x: pd.DataFrame) -> PositiveWalk:
        return PositiveWalk(a, x, n_positives)

    def negatives(a: pd.DataFrame, x: pd.DataFrame) -> NegativeWalk:
        return NegativeWalk(a, x, n_negatives, low, high)

    key = ["anchor_id", "row"]
    members = written(members.withColumn("cut", F.lit(LEAST)), "negatives-members")
    found = written(first_of(leg(members, rows, clusters, dim, True, np.full(m, -np.inf), positives, POSITIVE), key, n_positives)
                    .drop("rank"), "negatives-positives")
    so_far = found.groupBy(F.col("anchor_id").alias("id"), "row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    cut = (F.when(F.coalesce("n", F.lit(0)) >= n_positives, F.col("worst"))
           .when(F.coalesce("n", F.lit(0)) >= F.col("wanted"), F.lit(MOST)).otherwise(F.lit(LEAST)))
    onward = written(members.drop("cut").join(so_far, ["id", "row"], "left").withColumn("cut", cut).drop("n", "worst")
                     .where(F.col("cut") < MOST), "negatives-onward")
    least = least_bounds(onward, F.col("cut"), m)
    if m > 1 and np.isfinite(least.min()) | (least.min() < 0):
        found = found.unionByName(leg(onward, rows, clusters, dim, False, least, positives, POSITIVE))
    best = first_of(found, key, n_positives).groupBy(F.col("anchor_id").alias("id"), "row").agg(
        F.sort_array(F.collect_list(F.struct("other", "score"))).alias("p"))  # n_positives entries
    members = written(members.drop("cut", "wanted").join(best, ["id", "row"]).select(
        "id", "row", "label", "v", "cell", "norm", F.col("p.other").alias("positives"), F.col("p.score").alias("scores"),
        F.transform("p", lambda _: F.lit(LEAST)).alias("cuts")), "negatives-asking")

    def bottom(cuts: Column, scores: Column) -> Column:
        """The least score that still matters to a member."""
        def one(c: Column, s: Column) -> Column:
            least_score = F.ceil(s.cast("decimal(38,0)") * low / 100).cast("long")
            most_score = F.floor(s.cast("decimal(38,0)") * high / 100).cast("long")
            return F.when(least_score > most_score, F.lit(MOST)).otherwise(F.greatest(c, least_score))

        return F.array_min(F.zip_with(cuts, scores, one))

    least = least_bounds(members, bottom(F.col("cuts"), F.col("scores")), m)
    key = [*key, "positive_id"]
    found = leg(members, rows, clusters, dim, True, least, negatives, NEGATIVE)
    if m > 1:
        found = written(first_of(found, key, n_negatives).drop("rank"), "negatives-head")
        full = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") >= n_negatives)
        cuts = full.groupBy(F.col("anchor_id").alias("id"), "row").agg(F.map_from_entries(
            F.collect_list(F.struct("positive_id", "worst"))).alias("known"))  # n_positives entries
        onward = written(members.join(cuts, ["id", "row"], "left").withColumn("cuts", F.transform(
            "positives", lambda p: F.coalesce(F.element_at("known", p), F.lit(LEAST)))).drop("known"), "negatives-onward")
        least = least_bounds(onward, bottom(F.col("cuts"), F.col("scores")), m)
        found = found.unionByName(leg(onward, rows, clusters, dim, False, least, negatives, NEGATIVE))
    return first_of(found, key, n_negatives).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
