"""The text encoder against numpy's singular vectors."""

from __future__ import annotations

import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from talentmatch.operators import encoder as E
from talentmatch.operators import tfidf
from talentmatch.operators.match import match_tfidf
from talentmatch.operators.parse import parse_resumes
from talentmatch.plans.queries import job_texts as jobs_of
from talentmatch.plans.queries import resume_texts
from talentmatch.plans.trained import TRAINED
from talentmatch.sources import fixtures as FX

TOPICS = (("python", "pandas", "numpy", "spark"), ("react", "css", "html", "node"), ("welding", "steel", "lathe", "drill"))


def job_texts(n=90, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = list(rng.choice(TOPICS[i % 3], size=5)) + list(rng.choice(["engineer", "remote", "senior"], size=2))
        out.append((i, " ".join(words)))
    return out


def matrix(spark, docs):
    """The jobs' TF-IDF rows and their terms."""
    idf = tfidf.fit_idf(docs)
    rows = tfidf.weights(tfidf.vectors(tfidf.term_counts(docs, "job_id", "text"), idf)).collect()
    terms = sorted({r.term for r in rows})
    ids = sorted({r.id for r in rows})
    a = np.zeros((len(ids), len(terms)))
    for r in rows:
        a[ids.index(r.id), terms.index(r.term)] = r.weight
    return a, terms


def model_rows(enc, terms):
    rows = {r.term: r.v for r in enc.model.collect()}
    assert sorted(rows) == terms
    return np.array([rows[t] for t in terms])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(job_texts(), "job_id long, text string")


def test_spans_the_leading_singular_vectors(spark, docs):
    a, terms = matrix(spark, docs)
    v = model_rows(E.fit_encoder(docs, dim=4, rounds=4), terms)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    best = np.linalg.svd(a)[2][:4].T
    assert np.linalg.svd(best.T @ v)[1].min() > 0.999  # cosines of the principal angles
    assert ((a @ v) ** 2).sum() > 0.9999 * ((a @ best) ** 2).sum()


def test_whole_rank_gives_the_order_of_tfidf(spark, docs):
    a, terms = matrix(spark, docs)
    rank = np.linalg.matrix_rank(a)
    enc = E.fit_encoder(docs, dim=int(rank), rounds=2)
    v = model_rows(enc, terms)
    assert np.allclose(a @ v @ v.T, a, atol=1e-5)
    resumes = docs.where("job_id % 9 = 0").withColumnRenamed("job_id", "resume_id")
    got = {(r.resume_id, r["rank"]): r.match_score for r in E.match_semantic(resumes, docs, 6, encoder=enc).collect()}
    want = {(r.resume_id, r["rank"]): r.match_score for r in match_tfidf(resumes, docs, 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_related_words_meet(spark, docs):
    resumes = spark.createDataFrame([(1, "numpy"), (2, "lathe drill"), (3, "nothing known"), (4, None), (5, "")], "resume_id long, text string")
    enc = E.fit_encoder(docs, dim=3)
    vec = {r.resume_id: np.array(r.vec) for r in enc.encode(resumes, "resume_id").collect()}
    assert not vec[3].any() and not vec[4].any() and not vec[5].any() and sorted(vec) == [1, 2, 3, 4, 5]
    found = E.match_semantic(resumes, docs, 20, encoder=enc).collect()
    assert all(r.job_id % 3 == 0 for r in found if r.resume_id == 1) and all(r.job_id % 3 == 2 for r in found if r.resume_id == 2)
    texts = dict(job_texts())
    assert any("numpy" not in texts[r.job_id] for r in found if r.resume_id == 1)  # the topic counts, not the word
    # without a direction every job scores 0 and the lowest ids come first
    assert [(r.job_id, r.match_score) for r in sorted(found, key=lambda r: r["rank"]) if r.resume_id == 3] == [(i, 0.0) for i in range(20)]


def test_layout_and_saving(spark, docs, tmp_path):
    one, two = E.fit_encoder(docs.coalesce(1), dim=5), E.fit_encoder(docs.repartition(7), dim=5)
    a, b = ({r.job_id: r.vec for r in e.encode(docs, "job_id").collect()} for e in (one, two))
    assert all(np.allclose(a[i], b[i], atol=1e-9) for i in a)
    one.save(str(tmp_path / "m"))
    again = E.TextEncoder.load(spark, str(tmp_path / "m"))
    assert again.dim == 5 and {r.job_id: r.vec for r in again.encode(docs, "job_id").collect()} == a


def test_no_jobs_and_few_terms(spark, docs):
    resumes = docs.limit(2).withColumnRenamed("job_id", "resume_id")
    assert E.match_semantic(resumes, docs.limit(0)).count() == 0
    tiny = spark.createDataFrame([(1, "one two"), (2, "two"), (3, " "), (4, None)], "job_id long, text string")
    found = E.match_semantic(tiny.withColumnRenamed("job_id", "resume_id"), tiny, 3, dim=8).collect()
    assert {(r.resume_id, r.job_id) for r in found} == {(i, j) for i in (1, 2, 3, 4) for j in (1, 2)}
    assert all(abs(r.match_score - 1) < 1e-6 for r in found if r.resume_id == r.job_id)


def test_query_against_numpy(spark, small_sf):
    """The same rounds on whole matrices, from the same start."""
    jobs = jobs_of(spark, small_sf)
    a, terms = matrix(spark, jobs)
    width = E.DIM + E.OVERSAMPLE
    start = spark.createDataFrame([(t,) for t in terms], "term string").select(
        "term", *[(F.xxhash64("term", F.lit(i)) / F.lit(2.0 ** 63)).alias(f"v{i}") for i in range(width)]).collect()
    rows = {r.term: list(r)[1:] for r in start}
    q = np.array([rows[t] for t in terms])
    for k in range(E.ROUNDS):
        z = a.T @ (a @ q)
        value, vector = np.linalg.eigh(z.T @ z)
        keep = np.argsort(-value)[:E.DIM if k == E.ROUNDS - 1 else width]
        keep = keep[value[keep] > value.max() * E.LEAST_SHARE]
        q = z @ (vector[:, keep] / np.sqrt(value[keep]))
    idf = {r.term: r.idf for r in tfidf.fit_idf(jobs).collect()}
    resumes = resume_texts(parse_resumes(FX.resumes_raw(spark, small_sf))).collect()
    ids = sorted(r.job_id for r in jobs.collect())
    y = a @ q
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    got = {}
    for r in TRAINED["match_topk_semantic"](spark, small_sf).collect():
        got.setdefault(r.resume_id, {})[r["rank"]] = (r.job_id, r.match_score)
    assert len(got) == len(resumes)

    for r in resumes:
        x = np.zeros(len(terms))
        for w in re.findall(r"\w{2,}", r.text.lower()):
            if w in idf:
                x[terms.index(w)] += idf[w]
        x = x @ q
        score = y @ (x / np.linalg.norm(x)) if np.linalg.norm(x) > 1e-12 else np.zeros(len(ids))
        best = np.sort(score)[::-1]
        for rank, (job, s) in got[r.resume_id].items():
            assert abs(s - score[ids.index(job)]) < 2e-5 and abs(s - best[rank - 1]) < 2e-5
