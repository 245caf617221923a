"""résumé x job matching on dense or TF-IDF features."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions.text import is_blank
from talentmatch.operators import tfidf
from talentmatch.operators.blockmatch import by_block, topk_cosine
from talentmatch.operators.prunedmatch import pruned_topk_cosine
from talentmatch.operators.prunedtext import pruned_topk_sparse


def _direction(v: Column) -> Column:
    """The vector as doubles, or null if it has no direction to speak of: a
    null, NaN or infinite component."""
    v = v.cast("array<double>")
    inf = F.lit(float("inf"))
    return F.when(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)), v)


def cosine(a: Column, b: Column) -> Column:
    """D4 on two dense array columns: dot / (|a| |b|), 0 if either is null,
    zero or not finite; missing components count as 0."""
    a, b = _direction(a), _direction(b)
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) * F.coalesce(y, zero)), zero, lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, zero, lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, zero, lambda s, v: s + v * v))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(zero)


def match_dense(resumes: DataFrame, jobs: DataFrame, top_n: int = K.DEFAULT_TOP_N, *,
                resume_id: str = "resume_id", job_id: str = "job_id", vec: str = "vec",
                pivots: int = 0, **kw) -> DataFrame:
    """Top-n jobs per résumé by cosine of dense vectors:
    ``(resume_id, job_id, match_score, rank)``.  With ``pivots``, jobs are
    grouped around so many of them and a résumé meets only the groups that
    can hold one of its best (worth it for clustered vectors)."""
    match = partial(pruned_topk_cosine, n_pivots=pivots) if pivots else partial(topk_cosine, kind="dense")
    out = match(resumes.select(F.col(resume_id).alias("l"), F.col(vec).alias("vec")),
                jobs.select(F.col(job_id).alias("r"), F.col(vec).alias("vec")),
                top_n, left_id="l", right_id="r", **kw)
    return out.select(F.col("l").alias(resume_id), F.col("r").alias(job_id),
                      F.col("score").alias("match_score"), "rank")


def with_text(jobs: DataFrame, text: str = "text") -> DataFrame:
    """Jobs that have any text; the others take no part in matching."""
    return jobs.where(~is_blank(F.col(text)))


def job_counts(jobs: DataFrame, text: str = "text") -> DataFrame:
    """One row: jobs that are matched against, and jobs without text."""
    blank = is_blank(F.col(text)).cast("int")
    return jobs.agg(F.coalesce(F.sum(1 - blank), F.lit(0)).cast("bigint").alias("n_jobs"),
                    F.coalesce(F.sum(blank), F.lit(0)).cast("bigint").alias("n_without_text"))


def match_tfidf(resumes: DataFrame, jobs: DataFrame, top_n: int = K.DEFAULT_TOP_N, *,
                resume_id: str = "resume_id", job_id: str = "job_id", text: str = "text",
                pruned: bool = False, **kw) -> DataFrame:
    """Top-n jobs per résumé by TF-IDF cosine, the vocabulary fitted on the
    jobs that have text.  Jobs sharing no term with a résumé score 0 and
    still compete (lowest job id first), as when every job is scored.

    With ``pruned`` a résumé meets only the blocks of jobs that can hold one
    of its best."""
    jobs = with_text(jobs, text)
    jc = tfidf.term_counts(jobs, job_id, text)
    idf = tfidf.fit_idf(jobs, text)
    rc = tfidf.term_counts(resumes, resume_id, text)
    if pruned:
        sides = [tfidf.coded(tfidf.vectors(c, idf)) for c in (rc, jc)]
    else:  # a job's terms are gathered where its block is packed
        sides = [tfidf.coded_vectors(c, idf) for c in (rc, by_block(jc, jobs, **kw))]
    match = pruned_topk_sparse if pruned else partial(topk_cosine, kind="sparse")
    out = match(sides[0].withColumnRenamed("id", "l"), sides[1].withColumnRenamed("id", "r"), top_n,
                left_id="l", right_id="r", **kw)
    return out.select(F.col("l").alias(resume_id), F.col("r").alias(job_id),
                      F.col("score").alias("match_score"), "rank")


def match_one(resume_vector: DataFrame, jobs: DataFrame, n: int = K.DEFAULT_TOP_N, *,
              resume_id: str = "resume_id", job_id: str = "job_id", vec: str = "vec") -> DataFrame:
    """One résumé's ranked list: ``resume_vector`` is one row, sent to
    every task; ``orderBy(desc).limit(n)`` keeps n rows per task."""
    one = F.broadcast(resume_vector.select(resume_id, F.col(vec).alias("own")).limit(1))
    scored = jobs.crossJoin(one).select(resume_id, job_id, F.round(cosine(F.col("own"), F.col(vec)), 6).alias("match_score"))
    return scored.orderBy(F.desc("match_score"), F.asc(job_id)).limit(n)


def match_stats(matches: DataFrame, resume_id: str = "resume_id") -> DataFrame:
    """Per résumé - number of matches and the top score."""
    return matches.groupBy(resume_id).agg(F.count(F.lit(1)).alias("n_matches"),
                                          F.max("match_score").alias("top_score"))


def with_match_status(resumes: DataFrame, matches: DataFrame,
                      resume_id: str = "resume_id") -> DataFrame:
    """Every résumé keeps a row; one without matches shows why
    (its parse error, or 'no matches')."""
    stats = match_stats(matches, resume_id)
    return (resumes.select(resume_id, "error").join(stats, resume_id, "left")
            .select(resume_id,
                    F.coalesce("n_matches", F.lit(0).cast("bigint")).alias("n_matches"),
                    "top_score",
                    F.when(F.col("n_matches").isNotNull(), F.lit("matched"))
                     .otherwise(F.coalesce("error", F.lit("no matches"))).alias("status")))
