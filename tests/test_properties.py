"""Properties of the column functions, checked over generated rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions import present as P
from talentmatch.functions import resume as R
from talentmatch.operators import clean as C
from talentmatch.operators.parse import parse_resumes

ALPHABET = list("abcXYZ  \t\n  é_-.+@()#|,:;") + ["python", "skills", "SQL", "c++",
                                                         "machine learning", "data", "java"]


def _texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_clean_jobs_idempotent(spark):
    rows = [(i, t, t[::-1], t.upper(), "l") for i, t in enumerate(_texts(300))]
    jobs = spark.createDataFrame(rows, "job_id long, title string, company string, "
                                 "location string, link string")
    once = C.clean_jobs(jobs)
    twice = C.clean_jobs(once.drop("is_remote"))
    assert once.exceptAll(twice).count() == 0


def test_clean_text_matches_python(spark):
    import re
    texts = _texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = dict(df.select("i", R.clean_text(F.col("t"))).collect())
    for i, t in enumerate(texts):
        want = re.sub(r"[^\w\s@.\-+()]", " ", re.sub(r"\s+", " ", t)).strip()
        assert got[i] == want, (t, got[i], want)


def test_skills_subset_of_lexicon(spark):
    df = spark.createDataFrame(list(enumerate(_texts(400))), "resume_id long, text string")
    allowed = {s.title() for s in K.SKILL_LEXICON}
    for r in parse_resumes(df).where("error is null").collect():
        assert set(r.skills) <= allowed
        assert r.skills == sorted(set(r.skills))


def test_band_monotone_in_score(spark):
    rnd = random.Random(5)
    scores = sorted(rnd.uniform(-1, 1) for _ in range(500)) + [0.5, 0.7, 0.4999999, 0.6999999]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    order = {"low": 0, "medium": 1, "high": 2}
    got = [(r.s, order[r.b]) for r in df.select("s", P.score_band(F.col("s")).alias("b")).collect()]
    got.sort()
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))


def test_spread_only_where_asked(spark):
    from talentmatch.session import spread
    df = spark.range(10)
    n = spark.conf.get("spark.talentmatch.spread")
    assert spread(df).rdd.getNumPartitions() == int(n)
    spark.conf.unset("spark.talentmatch.spread")
    try:
        assert spread(df) is df
    finally:
        spark.conf.set("spark.talentmatch.spread", n)
