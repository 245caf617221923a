"""Edge rows (FIXTURES.md section 2, last paragraph)."""

from __future__ import annotations

import math

import pytest

from pyspark.sql import functions as F

from talentmatch.functions import present as P
from talentmatch.operators import clean as C
from talentmatch.operators import match as M
from talentmatch.operators.parse import parse_resumes
from talentmatch.sources import jobs_csv as J
from talentmatch.sources import resume_files as RF
from talentmatch.sources.html_cards import extract_cards
from talentmatch.sources.json_feed import flatten_job_feed
from talentmatch.functions import constants as K


def test_job_cleaning_edges(spark):
    jobs = spark.createDataFrame(
        [(1, "  Data ENGINEER\t", "Acme ", None, "https://x/y?a=1"),
         (2, "N/A", "B", " Remote", "https://x/z"),
         (3, "t", "c", "US (REMOTE ok)", "https://x/w?b=2?c")],
        "job_id long, title string, company string, location string, link string")
    rows = {r.job_id: r for r in C.clean_jobs(jobs)
            .withColumn("canon", C.canonical_link(F.col("link"))).collect()}
    assert rows[1].title == "data engineer" and rows[1].company == "acme"
    assert rows[1].location is None and rows[1].is_remote == 0
    assert rows[1].canon == "https://x/y"
    assert rows[2].location == "remote" and rows[2].is_remote == 1
    assert rows[2].canon == "https://x/z"
    assert rows[3].is_remote == 1 and rows[3].canon == "https://x/w"


def test_job_text_skips_nulls(spark):
    df = spark.createDataFrame([("a", None, "c")], "t string, c string, l string")
    assert df.select(C.job_text(F.col("t"), F.col("c"), F.col("l"))).first()[0] == "a c"


def test_csv_na_sentinels(spark, tmp_path):
    p = str(tmp_path / "jobs")
    rows = [("N/A", "Acme", "NA", "#", "LinkedIn", None), ("t", "", "x", "l", "s", None)]
    J.write_csv(spark.createDataFrame(rows, J.JOBS_SCHEMA), p)
    got = J.read_jobs_csv(spark, p).orderBy("link").collect()
    assert got[0].title is None and got[0].location is None
    assert got[1].company is None


def test_empty_and_blank_text(spark):
    df = spark.createDataFrame([(1, ""), (2, " \n\t "), (3, None), (4, "Ada Lovelace")],
                               "resume_id long, text string")
    rows = {r.resume_id: r for r in parse_resumes(df).collect()}
    for i in (1, 2, 3):
        assert rows[i].error == K.EMPTY_TEXT_ERROR and rows[i].name is None
    assert rows[4].error is None and rows[4].name == "Ada Lovelace"


def test_invalid_utf8_and_crlf(spark):
    df = spark.createDataFrame([(bytearray(b"Hi\xff!"),), (bytearray(b"a\r\nb\rc"),)],
                               "content binary")
    got = [r[0] for r in df.select(RF.decode_text(F.col("content"))).collect()]
    assert got == ["Hi!", "a\nb\nc"]


def test_non_ascii_name_uses_second_pattern(spark):
    df = spark.createDataFrame([(1, "Résumé Ada Lovelace\nmail")], "resume_id long, text string")
    assert parse_resumes(df).first().name == "Ada Lovelace"


def test_cpp_and_csharp(spark):
    df = spark.createDataFrame(
        [(1, "I write c++11 daily"), (2, "I write c++ daily"), (3, "skills: c++ and c#"),
         (4, "I know c# well")], "resume_id long, text string")
    got = {r.resume_id: r.skills for r in parse_resumes(df).collect()}
    assert "C++" in got[1]          # a word character follows: \b matches
    assert "C++" not in got[2]      # nothing after the ++: no \b, no skills tail
    assert "C++" in got[3]          # substring after the word "skills"
    assert got[4] == []             # '#' is removed by cleaning: never found


def test_javascript_before_and_after_skills(spark):
    df = spark.createDataFrame([(1, "javascript. skills: none"), (2, "skills: javascript")],
                               "resume_id long, text string")
    got = {r.resume_id: r.skills for r in parse_resumes(df).collect()}
    assert got[1] == ["Javascript"]
    assert got[2] == ["Java", "Javascript"]


def test_score_presentation(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (float("nan"),), (0.7,), (0.5,), (None,)],
                               "s double")
    rows = df.select(P.score_band(F.col("s")), P.score_pct(F.col("s"))).collect()
    assert rows[0] == ("low", "12%")
    assert rows[1][1] == "14%"
    assert rows[2] == ("low", "nan%")
    assert rows[3][0] == "high" and rows[4][0] == "medium"
    assert rows[5][1] is None


def test_zero_vector_and_ties(spark):
    res = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "resume_id long, vec array<double>")
    jobs = spark.createDataFrame([(10, [0.0, 1.0]), (11, [2.0, 0.0]), (12, [3.0, 0.0]),
                                  (13, [0.0, 0.0])], "job_id long, vec array<double>")
    got = M.match_dense(res, jobs, 2).orderBy("resume_id", "rank").collect()
    # a zero vector scores 0 everywhere: lowest job ids win the tie
    assert [(r.resume_id, r.job_id, r.match_score) for r in got] == [
        (1, 10, 0.0), (1, 11, 0.0), (2, 11, 1.0), (2, 12, 1.0)]


CARD = ('<div class="base-card x"><h3 class="base-search-card__title"> T &amp; co </h3>'
        '<h4 class="base-search-card__subtitle">B</h4>'
        '<a class="base-card__full-link" href="https://j/v/1?x=1">go</a></div>')


def cards_of(spark, *pages, **kw):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    return sorted(extract_cards(df, scrape_date="2025-08-17", **kw).collect())


def test_all_cards_and_missing_fields(spark):
    no_href = '<div class="base-card"><a class="base-card__full-link">go</a></div>'
    out = cards_of(spark, "<html>" + CARD * 20 + "</html>", no_href + CARD, None, "")
    p0 = [r for r in out if r.page_id == 0]
    assert [r.card_no for r in p0] == list(range(20))
    assert p0[0].title == "T & co" and p0[0].location == K.MISSING_LOCATION
    assert p0[0].link == "https://j/v/1"
    assert [(r.page_id, r.card_no) for r in out if r.page_id] == [(1, 1)]
    cut = cards_of(spark, CARD * 20, no_href * 3 + CARD * 20, max_cards=K.MAX_CARDS_PER_PAGE)
    assert [sum(r.page_id == p for r in cut) for p in (0, 1)] == [15, 12]


def test_card_markup(spark):
    assert cards_of(spark, CARD.replace("class=\"base-card x", "data-class=\"base-card x")) == []
    (single,) = cards_of(spark, CARD.replace('"', "'").replace("class='base", "CLASS = 'base"))
    assert (single.title, single.link) == ("T & co", "https://j/v/1")
    bare = '<div class="base-card"><div>x</div></div>'
    footer = '<div><h3 class="base-search-card__title">Footer</h3></div>'
    assert [r.title for r in cards_of(spark, CARD + bare + footer)] == ["T & co", K.MISSING_TITLE]
    nested = CARD.replace("<h3", "<div><div></div></div><h3")
    assert [r.title for r in cards_of(spark, "<div>" + nested * 2 + "</div>" + footer)] == ["T & co"] * 2
    assert [r.title for r in cards_of(spark, CARD.removesuffix("</div>"))] == ["T & co"]  # never closed


def test_feed_defaults(spark):
    feeds = spark.createDataFrame(
        [(1, '[{"legal": "x"}, {"position": "P", "company": null, "url": "u"}]'),
         (2, '{"error": 1}')], "feed_id long, body string")
    rows = flatten_job_feed(feeds, scrape_date="2025-08-17").collect()
    got = sorted((r.title, r.company, r.location, r.link) for r in rows)
    assert got == [("N/A", "N/A", "Remote", "#"), ("P", None, "Remote", "u")]
    assert {r.source for r in rows} == {K.SOURCE_FEED}


def test_default_jobs_bootstrap(spark):
    empty = J.empty_jobs(spark).select("title", "company", "location", "link")
    assert J.jobs_or_default(empty).count() == len(K.DEFAULT_JOBS)
    one = spark.createDataFrame([("a", "b", "c", "d")], "title string, company string, "
                                "location string, link string")
    assert J.jobs_or_default(one).count() == 1


def test_nan_score_not_high(spark):
    assert not (float("nan") >= 0.7)  # the application's comparison
    assert math.isnan(float("nan"))


def test_read_resume_files(spark, tmp_path):
    d = tmp_path / "uploads"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_bytes(b"Ada Lovelace\r\nskills: python\r\n")
    (d / "sub" / "b.PDF").write_bytes(b"Grace Hopper \xff resume")
    (d / "c.exe").write_bytes(b"MZ")
    (d / "noext").write_bytes(b"x")
    rows = {r.file: r for r in RF.read_resume_files(spark, str(d)).collect()}
    assert set(rows) == {"a.txt", "b.PDF", "c.exe", "noext"}
    assert rows["a.txt"].admitted and rows["a.txt"].text == "Ada Lovelace\nskills: python\n"
    assert rows["b.PDF"].admitted and rows["b.PDF"].text == "Grace Hopper  resume"
    assert not rows["c.exe"].admitted and rows["c.exe"].text is None
    assert not rows["noext"].admitted
    assert not any(r.too_large for r in rows.values())
    parsed = parse_resumes(RF.read_resume_files(spark, str(d)).where("admitted"),
                           path_col="path").collect()
    by_file = {r.file: r for r in parsed}
    assert by_file["a.txt"].skills == ["Python"] and by_file["a.txt"].name == "Ada Lovelace"


def test_first_nonempty_source_fallback(spark):
    from talentmatch.operators.ingest import first_nonempty
    a = spark.createDataFrame([("a1",), ("a2",)], "title string")
    b = spark.createDataFrame([("b1",)], "title string")
    empty = a.where("false")
    assert sorted(r.title for r in first_nonempty(a, b).collect()) == ["a1", "a2"]
    assert [r.title for r in first_nonempty(empty, b).collect()] == ["b1"]
    assert first_nonempty(empty, empty).count() == 0


def test_bucketed_match_sink(spark, tmp_path):
    import os
    p = str(tmp_path / "matches")
    m = spark.createDataFrame([(i % 7, i, 0.5) for i in range(50)],
                              "resume_id long, job_id long, match_score double")
    J.write_csv(m, p, bucket_by="resume_id", buckets=4)
    folders = sorted(d for d in os.listdir(p) if d.startswith("bucket="))
    assert 1 < len(folders) <= 4
    back = spark.read.options(header="true").schema(
        "resume_id long, job_id long, match_score double").csv(p)
    assert back.drop("bucket").exceptAll(m).count() == 0 and back.count() == 50
    per_resume = back.groupBy("resume_id").agg(F.countDistinct("bucket").alias("n"))
    assert per_resume.where("n > 1").count() == 0


def test_large_files_are_listed_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MAX_UPLOAD_BYTES", 10)
    (tmp_path / "big.txt").write_bytes(b"x" * 11)
    (tmp_path / "small.txt").write_bytes(b"x" * 10)
    (tmp_path / "big.exe").write_bytes(b"x" * 11)
    df = RF.read_resume_files(spark, str(tmp_path))
    assert {r.file: (r.admitted, r.too_large, r.text) for r in df.collect()} == {
        "big.txt": (False, True, None), "small.txt": (True, False, "x" * 10), "big.exe": (False, True, None)}


def test_profile_resolution(spark):
    """Too large rejects the request; a wrong type leaves the form; a file
    that cannot be parsed rejects; without a file the form counts."""
    from talentmatch.operators.profiles import resolve_profiles
    files = spark.createDataFrame(
        [(1, False, True, None, None, None, None, None, None), (2, False, False, "X", "e", ["A"], "", "", None),
         (3, True, False, None, None, None, None, None, K.EMPTY_TEXT_ERROR), (4, True, False, "Y", "e", ["B"], "", "", None),
         (6, False, True, "Z", "e", ["C"], "", "", None)],
        "request_id long, admitted boolean, too_large boolean, name string, email string, skills array<string>, "
        "experience string, education string, error string")
    forms = spark.createDataFrame([(i, "Python" if i != 7 else " ", "", "") for i in (1, 2, 3, 4, 5, 7)],
                                  "request_id long, skills string, experience string, education string")
    got = {r.request_id: (r.profile_source, r.rejection) for r in resolve_profiles(files, forms).collect()}
    assert got == {1: (None, K.TOO_LARGE_ERROR), 2: ("form", None), 3: (None, "Resume parsing error: " + K.EMPTY_TEXT_ERROR),
                   4: ("file", None), 5: ("form", None), 6: (None, K.TOO_LARGE_ERROR),
                   7: (None, "Please either upload a resume or enter your skills")}


def test_csv_keeps_line_feeds(spark, tmp_path):
    rows = [('Data\nEngineer, "x"', "A", "B", "l", "s", None), ("T", None, "", "l", "s", None)]
    J.write_csv(spark.createDataFrame(rows, J.JOBS_SCHEMA), str(tmp_path / "c"))
    back = J.read_jobs_csv(spark, str(tmp_path / "c")).collect()
    assert sorted((r.title, r.company, r.location) for r in back) == [('Data\nEngineer, "x"', "A", "B"), ("T", None, None)]


def test_first_source_with_rows(spark):
    from talentmatch.operators.ingest import first_nonempty
    a, none = spark.range(2), spark.range(0)
    assert first_nonempty(none, a, spark.range(5)).count() == 2
    assert first_nonempty(none, none).count() == 0


def test_whole_sections_and_their_display(spark):
    from talentmatch.operators.parse import displayed
    text = "Ada Lovelace experience: " + "x" * 700
    p = parse_resumes(spark.createDataFrame([(1, text)], "resume_id long, text string"))
    (whole,), (shown,) = p.collect(), displayed(p).collect()
    assert whole.experience == "x" * 700 and whole.raw_text == text.replace(":", " ")
    assert shown.experience == "x" * 200 + "..." and len(shown.raw_text) == 503


def test_shared_folder_off_local_mode(monkeypatch):
    from talentmatch import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_replacement_character_of_the_file_stays(spark):
    rows = [(1, "a\ufffdb".encode() + b"\xff\r\n\xc3"), (2, "a\ufffdb\r".encode()), (3, b"\x48\x69\xff\x21"), (4, b"")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, content binary")
    got = {r.id: r.t for r in df.select("id", RF.decode_text(F.col("content")).alias("t")).collect()}
    assert got == {1: "a\ufffdb\n", 2: "a\ufffdb\n", 3: "Hi!", 4: ""}
