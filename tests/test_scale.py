"""Plans whose shuffles, files and tasks grow with their input alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from talentmatch.operators import blockmatch as B
from talentmatch.operators import encoder as E
from talentmatch.operators import prunedtext as P
from talentmatch.operators import tfidf
from talentmatch.operators.match import match_dense, match_tfidf


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, seed, n, start=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(start + i, rng.normal(size=4).round(2).tolist()) for i in range(n)], "id long, vec array<double>")


def test_no_row_is_copied_for_the_blocks_it_meets(spark):
    left, right = vectors(spark, 1, 30), vectors(spark, 2, 90, 1000)
    for pivots in (0, 4):
        plan = plan_of(match_dense(left, right, 3, resume_id="id", job_id="id", pivots=pivots) if not pivots else
                       match_dense(left.withColumnRenamed("id", "l"), right.withColumnRenamed("id", "r"), 3, resume_id="l", job_id="r", pivots=pivots))
        assert "CartesianProduct" in plan and "Generate" not in plan


def test_equal_vectors_are_scored_once_and_all_answered(spark):
    vec = [1.0, 0.0]
    left = spark.createDataFrame([(i, vec) for i in range(50)] + [(60, [0.0, 1.0]), (60, [1.0, 1.0]), (None, [0.0, 2.0])], "l long, vec array<double>")
    right = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 1.0])], "r long, vec array<double>")
    got = {}
    for x in B.topk_cosine(left, right, 2, left_id="l", right_id="r", block_rows=4).orderBy("l", "rank").collect():
        got.setdefault(x.l, []).append(x.r)
    assert all(got[i] == [1, 3] for i in range(50))
    assert got[60] == [3, 2] and got[None] == [2, 3]  # a repeated id keeps its k best of all its vectors
    assert B.one_of_equals(left.withColumnRenamed("l", "left_id"), ["vec"]).count() == 4


def test_vocabulary_is_joined_without_shuffling_terms(spark):
    texts = spark.createDataFrame([(i, f"spark job{i} engineer") for i in range(20)], "id long, text string")
    found = match_tfidf(texts.withColumnRenamed("id", "resume_id"), texts.withColumnRenamed("id", "job_id"), 3)
    plan = plan_of(found)
    assert "hashpartitioning(key" not in plan and plan.count("CartesianProduct") >= 3
    assert plan.count("hashpartitioning(block") == 1  # a right row is dealt to its block once, as counts
    assert {(r.resume_id, r.job_id) for r in found.where("rank = 1").collect()} == {(i, i) for i in range(20)}


def test_blocks_travel_compressed():
    rows = pa.table({"id": list(range(2000)), "weights": [[0.1, 0.7, 0.3]] * 2000})
    data = B.to_bytes(rows)
    assert len(data) < rows.nbytes / 4 and B.from_bytes(pa.scalar(data)).equals(rows)


def test_rounds_of_the_encoder_shuffle_no_text(spark):
    texts = spark.createDataFrame([(i, f"spark job{i % 3} engineer") for i in range(20)] + [(3, "spark"), (30, None)], "id long, text string")
    enc = E.fit_encoder(texts, 2, id_col="id")
    assert "CartesianProduct" in plan_of(enc.encode(texts))
    blocks = B.packed(tfidf.vectors(tfidf.term_counts(texts, "id", "text"), tfidf.fit_idf(texts)), 4, "t").localCheckpoint()
    plan = plan_of(E._round(blocks, enc.model.select("term", "v"), 2))
    assert "CartesianProduct" in plan and "hashpartitioning(id" not in plan
    vec = {r.id: r.vec for r in enc.encode(texts).collect()}
    assert len(vec) == 21 and vec[30] == [0.0, 0.0] and vec[3] != vec[0]  # texts of one id are summed


def test_blocks_keep_their_key_and_size(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("cell")).repartition(4, "cell")
    tables = [B.from_bytes(pa.scalar(bytes(r.r_rows), pa.binary())) for r in B.packed(df, 10, "r", by=("cell",)).collect()]
    assert sorted(i for t in tables for i in t["id"].to_pylist()) == list(range(100))
    assert all(len(t) <= 10 and len(set(t["cell"].to_pylist())) == 1 for t in tables) and len(tables) == 12


def test_left_rows_meet_only_blocks_that_reach_what_they_are_sure_of():
    left = pa.table({"id": [1, 2, 3, 4], "codes": [[7], [7], [8], [7]], "weights": [[1.0], [1.0], [1.0], [0.5]],
                     "sure": [0.5, 0.95, 0.0, 0.1], "block": [0, 0, 0, 5]})
    right = pa.table({"id": [10, 11], "codes": [[7], [9]], "weights": [[0.9], [1.0]], "block": [5, 5]})
    asked = P.may_score(left, right, B.SparseBlock.prepared(right), B.Best(left, 1))
    assert asked.tolist() == [True, False, False, False]


def test_views_of_one_split_are_dealt_out(spark, small_sf):
    from talentmatch.sources import fixtures as FX
    for name in FX.VIEWS:
        assert FX.view(spark, small_sf, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_filters_stay_after_the_dealing(spark, small_sf):
    from talentmatch.sources import fixtures as FX
    from talentmatch.sources.html_cards import extract_cards
    for df in (extract_cards(FX.pages_jobs(spark, small_sf)), FX.resumes_raw(spark, small_sf).where(F.length("text") > 3)):
        before = plan_of(df).split("RoundRobinPartitioning")[-1]
        assert "rlike" not in before.lower() and "length(" not in before and "concat(" not in before


def test_card_fields_of_odd_markup(spark):
    from talentmatch.sources.html_cards import extract_cards
    card = ('<h3 class="base-search-card__title"></h3><h3 CLASS=\'x job-card-search__title\'>second</h3><h3 class="base-search-card__title">third</h3>'
            "<h4 class='base-search-card__subtitle'> a &lt;b&gt; <i>c</i>\u00a0</h4>base-card__full-link job-search-card__location")
    html = f'<div class="base-card">{card}</div><p><div class="base-card"><a class="base-card__full-link">x</a></div><div class="base-card">cut'
    rows = extract_cards(spark.createDataFrame([(1, html), (2, None), (3, "none")], "page_id long, html string")).orderBy("card_no").collect()
    assert [(r.page_id, r.card_no, r.title, r.company, r.location, r.link) for r in rows] == [
        (1, 0, "", "a <b> c", "Remote", "#"), (1, 2, "N/A", "N/A", "Remote", "#")]


def test_many_files_are_few_folders_and_tasks(spark, tmp_path):
    from talentmatch.sources import resume_files as RF
    texts = spark.createDataFrame([(i, f"text {i}\nline") for i in range(300)] + [(7, "zz"), (500, None)], "resume_id long, text string")
    path = str(tmp_path / "landed")
    RF.land_texts(texts, "resume_id", path)
    files = RF.read_resume_files(spark, path)
    got = {r.file: r.text for r in files.collect()}
    assert len(got) == 301 and got["resume_id=3.txt"] == "text 3\nline\n" and got["resume_id=500.txt"] == "\n"
    assert got["resume_id=7.txt"] == "text 7\nline\nzz\n"
    assert len(list((tmp_path / "landed").iterdir())) <= 8
    assert files.rdd.getNumPartitions() <= 2 * 4 * max(8, spark.sparkContext.defaultParallelism)


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no list of a folder's files; rows are those of Spark's own reader."""
    import pytest
    from pyspark.errors import AnalysisException

    from talentmatch.sources import resume_files as RF
    names = ["a b.txt", "p%20q.txt", "é.TXT", "c.exe", "_k=v.txt", "s/deep/er/z.txt", "s/q.txt.gz", "s/h#a?b.txt", "s/[1].txt", "s/nl\nx.txt",
             "_metadata_dir/x.txt", *(f"many/{i}.txt" for i in range(40))]
    passed_over = ["_hid.txt", ".dot.txt", "x.txt._COPYING_", "_metadata.txt", "_h/x.txt", ".h/x.txt", "zz._COPYING_/x.txt"]
    for name in names + passed_over:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "s" / "empty.txt").touch()
    (tmp_path / "s" / "broken.txt").symlink_to(tmp_path / "none")
    (tmp_path / "s" / "loop").symlink_to(tmp_path / "s" / "loop")
    assert not RF.read_resume_files(spark, str(tmp_path)).inputFiles()
    monkeypatch.setattr(RF, "_BATCH_ROWS", 3)
    monkeypatch.setattr(RF, "_BATCH_BYTES", 20)
    got = {(r.path, r.file, r.length): r.text for r in RF.read_resume_files(spark, str(tmp_path)).collect()}
    assert got == {(f"file:{tmp_path}/{x}", x.split("/")[-1], len(x.encode())): x if x.lower().endswith(".txt") else None for x in names}
    spark_s = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length")
    assert {(p, n) for p, _, n in got} == {tuple(r) for r in spark_s.collect()}
    # what tasks do not list goes to Spark's reader
    for path, n in ((f"{tmp_path}/man*", 40), (f"{tmp_path}/a b.txt", 1)):
        assert len(RF.read_resume_files(spark, path).inputFiles()) == n == RF.read_resume_files(spark, path).count()
    assert {r.file for r in RF.read_resume_files(spark, str(tmp_path / "s"), recursive=False).collect()} == {"q.txt.gz", "h#a?b.txt", "[1].txt", "nl\nx.txt"}
    with pytest.raises(AnalysisException):
        RF.read_resume_files(spark, str(tmp_path / "none"))
    (tmp_path / "nothing").mkdir()
    assert RF.read_resume_files(spark, str(tmp_path / "nothing")).count() == 0


def test_a_landing_is_not_kept_in_memory(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from talentmatch.streaming import snapshot as S
    landing = str(tmp_path / "landing")
    rows = [(1, 0, "a", "b", "c", "d", "e", None), (1, 1, "a", "b", "c", "d", "e", None)]
    spark.createDataFrame(rows, S.CARD_SCHEMA).write.parquet(landing)
    kept = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: kept.append(1) or self)
    S.start_snapshot_stream(spark, landing, str(tmp_path / "snapshot"), str(tmp_path / "ckpt")).awaitTermination()
    assert not kept and not (tmp_path / "snapshot").exists()  # no date, nothing to write
