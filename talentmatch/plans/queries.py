"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
given tables (or views derived from them).  Column names equal those of
the matching oracle in ``plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.functions import advice as A
from talentmatch.functions import constants as K
from talentmatch.functions import intended as I
from talentmatch.functions import present as P
from talentmatch.functions import resume as R
from talentmatch.operators import clean as C
from talentmatch.operators import match as M
from talentmatch.operators import tfidf as TF
from talentmatch.operators.ingest import first_nonempty
from talentmatch.operators.parse import displayed, parse_resumes, parse_resumes_intended
from talentmatch.operators.profiles import manual_profiles, resolve_profiles
from talentmatch.plans.pipeline import match_resumes_to_jobs
from talentmatch.plans.requests import answer_requests, with_job_lines
from talentmatch.session import scratch_path, spread, table
from talentmatch.sources import fixtures as FX
from talentmatch.sources import jobs_csv as J
from talentmatch.sources import resume_files as RF
from talentmatch.sources.formats import extracted_text
from talentmatch.sources.html_cards import extract_cards
from talentmatch.sources.json_feed import flatten_job_feed

SCRAPE_DATE = "2025-08-17"
SECTION_KEYWORD_DOCS = "that"


# -- shared inputs -----------------------------------------------------------

def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def clean_documents(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", R.clean_text(F.col("text")).alias("c"))


def parsed_resumes(spark, sf):
    return parse_resumes(FX.resumes_raw(spark, sf))


def skills_text(col="skills"):
    return F.array_join(F.col(col), ", ")


def resume_texts(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).select(
        "resume_id", C.resume_text(F.col("skills"), F.col("experience"), F.col("education"))
        .alias("text"))


def clean_job_table(spark, sf):
    return C.clean_jobs(FX.jobs_raw(spark, sf))


def job_texts(spark, sf):
    return clean_job_table(spark, sf).select(
        "job_id", C.job_text(F.col("title"), F.col("company"), F.col("location")).alias("text"))


def embedding_sides(spark, sf):
    """Résumé vectors are the rows labelled 0, job vectors all others."""
    e = table(spark, sf, "embeddings")
    res = e.where(F.col("label") == 0).select(F.col("vec_id").alias("resume_id"),
                                             F.col("embedding").alias("vec"))
    jobs = e.where(F.col("label") != 0).select(F.col("vec_id").alias("job_id"),
                                              F.col("embedding").alias("vec"))
    return res, jobs


def dense_matches(spark, sf, top_n=K.DEFAULT_TOP_N):
    res, jobs = embedding_sides(spark, sf)
    return M.match_dense(res, jobs, top_n)


def tfidf_matches(spark, sf, top_n=K.DEFAULT_TOP_N):
    return M.match_tfidf(resume_texts(parsed_resumes(spark, sf)), job_texts(spark, sf), top_n)


def parsed_uploads(spark, sf):
    up = FX.uploads(spark, sf)
    return parse_resumes(up.select("request_id", "filename", "size", "text"),
                         keep=("request_id", "filename", "size")) \
        .withColumns({"admitted": RF.admitted(F.col("filename"), F.col("size")),
                      "too_large": RF.too_large(F.col("size"))})


# -- C: parsing --------------------------------------------------------------

def q_clean_text(spark, sf):
    return clean_documents(spark, sf).withColumnRenamed("c", "clean_text")


def q_extract_name(spark, sf):
    return clean_documents(spark, sf).select("doc_id", R.extract_name(F.col("c")).alias("name"))


def q_extract_email(spark, sf):
    return clean_documents(spark, sf).select("doc_id", R.extract_email(F.col("c")).alias("email"))


def q_extract_phone(spark, sf):
    return clean_documents(spark, sf).select("doc_id", R.extract_phone(F.col("c")).alias("phone"))


def q_extract_skills(spark, sf):
    d = clean_documents(spark, sf).select(
        "doc_id", F.lower("c").alias("lc"), R.skills_tail_lower(F.col("c")).alias("tail"))
    return d.select("doc_id", F.array_join(R.extract_skills("lc", "tail"), ", ")
                    .alias("skills"))


def q_extract_section(spark, sf):
    return clean_documents(spark, sf).select(
        "doc_id", R.extract_section(F.col("c"), SECTION_KEYWORD_DOCS).alias("section"))


def q_section_text(spark, sf):
    """C6 whole: everything after the keyword."""
    return clean_documents(spark, sf).select(
        "doc_id", R.section_text(F.col("c"), SECTION_KEYWORD_DOCS).alias("section"))


def q_truncate_text(spark, sf):
    return clean_documents(spark, sf).select("doc_id", R.raw_text(F.col("c")).alias("raw_text"))


def q_text_stats(spark, sf):
    d = documents(spark, sf)
    path = F.concat(F.lit("/landing/"), F.col("source"), F.lit("/doc_"),
                    F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", F.length("text").cast("bigint").alias("text_length"),
                    RF.basename(path).alias("file"))


def q_parse_errors(spark, sf):
    p = parsed_uploads(spark, sf)
    return p.where(F.col("error").isNotNull()).select("request_id", "error")


def q_parse_resumes(spark, sf):
    p = parsed_resumes(spark, sf)
    return p.select("resume_id", "name", "email", "phone", skills_text().alias("skills"),
                    "experience", "education", "raw_text", "text_length", "error")


def q_parse_resumes_intended(spark, sf):
    """C10 as meant: sections end at headings, skills are whole terms."""
    p = parse_resumes_intended(FX.resumes_raw(spark, sf))
    return p.select("resume_id", "name", "email", "phone", skills_text().alias("skills"),
                    "experience", "education", "raw_text", "text_length", "error")


def q_extract_skills_intended(spark, sf):
    """C5 as meant, over documents."""
    d = spread(documents(spark, sf)).select("doc_id", F.lower(I.lines(F.col("text"))).alias("low"))
    return d.select("doc_id", F.array_join(I.skills("low"), ", ").alias("skills"))


def q_extract_name_intended(spark, sf):
    """C2 to C4 as meant, over documents."""
    d = spread(documents(spark, sf)).select("doc_id", I.lines(F.col("text")).alias("t"))
    t = F.col("t")
    return d.select("doc_id", I.name(t).alias("name"), I.email(t).alias("email"), I.phone(t).alias("phone"))


def q_display_resumes(spark, sf):
    """The record as shown, sections and raw text shortened."""
    return displayed(parsed_resumes(spark, sf)).select("resume_id", "name", "experience", "education", "raw_text")


def q_parse_resume_files(spark, sf):
    """A4: résumés landed as files, one each, listed and read as binary files,
    admitted, decoded and parsed."""
    path = scratch_path(spark, "resume_files")
    RF.land_texts(FX.resumes_raw(spark, sf).select("resume_id", "text"), "resume_id", path)
    files = RF.read_resume_files(spark, path).where("admitted").withColumn(
        "resume_id", F.regexp_extract("path", r"resume_id=(\d+)", 1).cast("long"))
    p = parse_resumes(files, path_col="path", keep=("resume_id",))
    return p.select("resume_id", "name", "email", "phone", skills_text().alias("skills"), "experience",
                    "education", "text_length", "error")


def q_read_uploads(spark, sf):
    """A4 and A5 over uploaded bytes: text documents by their reader, broken
    ones and all others by the plain decode."""
    up = FX.upload_files(spark, sf)
    ext = F.coalesce(RF.extension(F.col("filename")), F.lit(""))
    read = up.select("request_id", extracted_text(ext, F.col("content")).alias("x"), RF.decode_text(F.col("content")).alias("d"))
    text = RF.with_fallback(F.col("x"), F.col("d"))
    return read.select("request_id", F.length(text).cast("bigint").alias("text_length"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"),
                       F.when(F.col("x").isNotNull(), "extracted").otherwise("decoded").alias("via"))


def q_read_pdf_files(spark, sf):
    """A4 and A5 over PDF files: the text by the built-in reader, plain bytes
    under such a name by the fallback."""
    files = FX.pdf_files(spark, sf)
    read = files.select("resume_id", extracted_text(RF.extension(F.col("file")), F.col("content")).alias("x"), RF.decode_text(F.col("content")).alias("d"))
    text = RF.with_fallback(F.col("x"), F.col("d"))
    return read.select("resume_id", F.length(text).cast("bigint").alias("text_length"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"),
                       F.when(F.col("x").isNotNull(), "extracted").otherwise("decoded").alias("via"))


def q_parse_uploads(spark, sf):
    """Uploaded files of all formats, admitted, read and parsed."""
    up = FX.upload_files(spark, sf).where(RF.admitted(F.col("filename"), F.col("size")))
    texts = up.select("request_id", "filename", RF.file_text(F.col("filename"), F.col("content")).alias("text"))
    p = parse_resumes(texts, path_col="filename", keep=("request_id",))
    return p.select("request_id", "file", "name", "email", "phone", skills_text().alias("skills"), "experience", "education", "text_length", "error")


# -- B: projections ----------------------------------------------------------

def q_clean_jobs(spark, sf):
    return clean_job_table(spark, sf).select("job_id", "title", "company", "location", "link",
                                             "is_remote")


def q_flag_remote(spark, sf):
    return FX.jobs_raw(spark, sf).select("job_id", C.remote_flag(F.col("location")).alias("is_remote"))


def q_canonical_link(spark, sf):
    return FX.jobs_raw(spark, sf).select("job_id", C.canonical_link(F.col("link")).alias("link"))


def q_canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.canonical_link(F.col("url")).alias("url"))


def q_job_counts(spark, sf):
    """Jobs that take part in matching, and jobs without any text."""
    jobs = FX.jobs_raw(spark, sf)
    some = [F.when(F.col("job_id") % 97 != 0, F.when(F.col("job_id") % m != 0, F.col(c)).otherwise(" ")).alias(c)
            for c, m in (("title", 2), ("company", 3), ("location", 5))]
    texts = C.clean_jobs(jobs.select("job_id", *some)).select(
        "job_id", C.job_text(F.col("title"), F.col("company"), F.col("location")).alias("text"))
    return M.job_counts(texts)


def q_job_text(spark, sf):
    return job_texts(spark, sf)


def q_resume_text(spark, sf):
    return resume_texts(parsed_resumes(spark, sf))


def q_default_fields(spark, sf):
    d = C.default_fields(dense_matches(spark, sf).select("resume_id", "job_id", "match_score"))
    return d.select("resume_id", "job_id", "title", "company", "location", "link", "match_score")


def q_manual_profiles(spark, sf):
    m = manual_profiles(FX.forms_raw(spark, sf))
    return m.select("request_id", "name", "email", skills_text().alias("skills"),
                    F.size("skills").cast("int").alias("n_skills"), "experience", "education")


def requests_raw(spark, sf):
    """Landed requests: an upload, a form, or both."""
    up = FX.uploads(spark, sf).where("request_id % 23 != 0")
    forms = FX.forms_raw(spark, sf).where("request_id % 5 != 0")
    return up.join(forms, "request_id", "full").select("request_id", "filename", "size", "text", "skills", "experience", "education")


def q_answer_requests(spark, sf):
    """The whole answer to every request: profile, jobs, advice or message."""
    return with_job_lines(answer_requests(requests_raw(spark, sf), FX.jobs_raw(spark, sf)))


def q_answer_requests_intended(spark, sf):
    """The same with advice rules that ignore case."""
    return with_job_lines(answer_requests(requests_raw(spark, sf), FX.jobs_raw(spark, sf), match_case=False))


def q_stream_requests(spark, sf):
    """The same requests landed as files and answered by the stream."""
    from talentmatch.streaming.requests import run_requests
    return with_job_lines(run_requests(spark, requests_raw(spark, sf), FX.jobs_raw(spark, sf)))


def _resolved(spark, sf):
    return resolve_profiles(parsed_uploads(spark, sf), FX.forms_raw(spark, sf))


def q_resolve_profiles(spark, sf):
    r = _resolved(spark, sf)
    return r.select("request_id", "profile_source", "name", "email",
                    skills_text().alias("skills"), "experience", "education", "rejection")


def q_score_band(spark, sf):
    return dense_matches(spark, sf).select("resume_id", "job_id",
                                           P.score_band(F.col("match_score")).alias("band"))


def q_score_pct(spark, sf):
    return dense_matches(spark, sf).select("resume_id", "job_id",
                                           P.score_pct(F.col("match_score")).alias("pct"))


def q_blend_bands(spark, sf):
    """B10 and B11 over scores that reach every band: each vector against
    itself blended with the next one."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    blend = F.zip_with("v", "w", lambda x, y: x + y * (F.col("vec_id") % 7) / 2.0)
    scored = e.join(nxt, "vec_id").select("vec_id", F.round(M.cosine(F.col("v"), blend), 6).alias("score"))
    return scored.select("vec_id", "score", P.score_band(F.col("score")).alias("band"), P.score_pct(F.col("score")).alias("pct"))


def q_profile_summary(spark, sf):
    p = parsed_resumes(spark, sf)
    return p.select("resume_id", P.skills_summary(F.col("skills")).alias("skills_summary"),
                    P.advice_html(A.career_advice(F.col("skills"), match_case=False))
                    .alias("advice_html"))


# -- E: advice -----------------------------------------------------------------

def q_career_advice(spark, sf):
    return parsed_resumes(spark, sf).select(
        "resume_id", A.career_advice(F.col("skills"), match_case=True).alias("advice"))


def q_career_advice_intended(spark, sf):
    return parsed_resumes(spark, sf).select(
        "resume_id", A.career_advice(F.col("skills"), match_case=False).alias("advice"))


def q_advice_prompt(spark, sf):
    return parsed_resumes(spark, sf).select(
        "resume_id", A.advice_prompt(F.col("skills"), F.col("experience"), F.col("education"))
        .alias("prompt"))


def q_gated_advice(spark, sf):
    r = _resolved(spark, sf)
    adv = A.career_advice(F.col("skills"), match_case=True)
    return r.where(F.col("rejection").isNull()).select(
        "request_id", A.gated(adv, F.col("profile_source") == "file", F.col("skills"))
        .alias("advice"))


# -- D: features and matching --------------------------------------------------

def q_tfidf_weights(spark, sf):
    jobs = job_texts(spark, sf)
    return TF.weights(TF.vectors(TF.term_counts(jobs, "job_id", "text"), TF.fit_idf(jobs))).select(
        F.col("id").alias("job_id"), "term", F.round("weight", 6).alias("weight"))


def q_cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_vec_id"),
                   F.col("embedding").alias("next_embedding"))
    return e.join(nxt, "vec_id").select(
        "vec_id", "next_vec_id",
        F.round(M.cosine(F.col("embedding"), F.col("next_embedding")), 6).alias("cosine"))


def q_match_topk_dense(spark, sf):
    return dense_matches(spark, sf).select("resume_id", "job_id", "rank", "match_score")


def q_match_topk_dense_pruned(spark, sf):
    """D5 with jobs grouped around pivots: the same rows."""
    res, jobs = embedding_sides(spark, sf)
    return M.match_dense(res, jobs, K.DEFAULT_TOP_N, pivots=32).select("resume_id", "job_id", "rank", "match_score")


def q_match_topk_tfidf(spark, sf):
    return tfidf_matches(spark, sf).select("resume_id", "job_id", "rank", "match_score")


def q_match_topk_tfidf_pruned(spark, sf):
    """D6 with jobs in blocks of bounded scores: the same rows."""
    m = M.match_tfidf(resume_texts(parsed_resumes(spark, sf)), job_texts(spark, sf), pruned=True)
    return m.select("resume_id", "job_id", "rank", "match_score")


def q_match_single(spark, sf):
    """The ranked list of one résumé, that of the smallest id."""
    res, jobs = embedding_sides(spark, sf)
    return M.match_one(res.orderBy("resume_id").limit(1), jobs, K.DEFAULT_TOP_N)


def q_match_results(spark, sf):
    """What is shown for every match."""
    return match_resumes_to_jobs(FX.resumes_raw(spark, sf), FX.jobs_raw(spark, sf))


def q_match_results_intended(spark, sf):
    """The same from records parsed as meant."""
    return match_resumes_to_jobs(FX.resumes_raw(spark, sf), FX.jobs_raw(spark, sf), parse=parse_resumes_intended)


def q_match_stats(spark, sf):
    return M.match_stats(tfidf_matches(spark, sf)).crossJoin(F.broadcast(  # one row
        M.job_counts(job_texts(spark, sf)).select("n_jobs")))


def q_unmatched_resumes(spark, sf):
    p = parsed_uploads(spark, sf).withColumnRenamed("request_id", "resume_id")
    m = M.match_tfidf(resume_texts(p), job_texts(spark, sf))
    return M.with_match_status(p, m)


# -- A: sources and sinks ------------------------------------------------------

def _jobs_landing(spark, sf):
    """Scraped job rows as landed: a missing title written as 'N/A'."""
    j = FX.jobs_raw(spark, sf)
    return j.select("job_id",
                    F.when(F.col("job_id") % 11 == 0, F.lit("N/A")).otherwise(F.col("title")).alias("title"),
                    "company", "location", "link", F.lit(K.SOURCE_HTML).alias("source"),
                    F.to_date(F.lit(SCRAPE_DATE)).alias("date_scraped"))


def q_scan_jobs_csv(spark, sf):
    path = scratch_path(spark, "jobs_csv")
    J.write_csv(_jobs_landing(spark, sf), path)
    schema = T.StructType([T.StructField("job_id", T.LongType())] + J.JOBS_SCHEMA.fields)
    return J.read_jobs_csv(spark, path, schema)


def q_roundtrip_jobs(spark, sf):
    path = scratch_path(spark, "jobs_clean_csv")
    J.write_csv(C.clean_jobs(_jobs_landing(spark, sf)), path)
    schema = T.StructType([T.StructField("job_id", T.LongType())] + J.CLEAN_JOBS_SCHEMA.fields)
    return J.read_jobs_csv(spark, path, schema)


def q_roundtrip_matches(spark, sf):
    jobs = clean_job_table(spark, sf).select("job_id", "title", "company", "location", "link")
    m = tfidf_matches(spark, sf).join(jobs, "job_id").select(
        "resume_id", "rank", "job_id", "title", "company", "location", "link", "match_score")
    path = scratch_path(spark, "matches_csv")
    J.write_csv(m, path, bucket_by="resume_id", buckets=8)
    schema = ("resume_id long, rank int, job_id long, title string, company string, "
              "location string, link string, match_score double")
    return J.normalise_missing(spark.read.options(header="true", quote='"', escape='"')
                               .schema(schema).csv(path)).drop("bucket")


def q_default_jobs(spark, sf):
    jobs = clean_job_table(spark, sf).select("title", "company", "location", "link")
    return J.jobs_or_default(jobs)


def q_default_jobs_empty(spark, sf):
    """A7 without any job: the default rows."""
    jobs = clean_job_table(spark, sf).where("job_id < 0").select("title", "company", "location", "link")
    return J.jobs_or_default(jobs)


def q_empty_jobs_csv(spark, sf):
    """A7 without any data: a table of nothing but its header."""
    path = scratch_path(spark, "empty_csv")
    J.write_csv(_jobs_landing(spark, sf).drop("job_id").where("title is null"), path)
    return J.read_jobs_csv(spark, path)


def q_scan_resume_text(spark, sf):
    """Documents landed as bytes with CRLF line ends, every second one with
    undecodable bytes."""
    d = documents(spark, sf)
    valid = F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "UTF-8")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("FF")), valid, F.unhex(F.lit("C3")))).otherwise(valid)
    t = RF.decode_text(content)
    return d.select("doc_id", F.length(t).cast("bigint").alias("n_chars"),
                    F.md5(F.encode(t, "UTF-8")).alias("text_md5"))


def q_resume_text_fallback(spark, sf):
    """PDF/DOCX uploads whose reader yielded text use it; the others fall
    back to the plain decode of the bytes."""
    up = FX.uploads(spark, sf)
    ext = RF.extension(F.col("filename"))
    extracted = F.when(ext.isin("pdf", "docx") & (F.col("request_id") % 3 != 0),
                       F.concat(F.col("text"), F.lit("\n")))
    decoded = RF.decode_text(F.encode(F.col("text"), "UTF-8"))
    text = RF.with_fallback(extracted, decoded)
    return up.select("request_id", F.length(text).cast("bigint").alias("text_length"),
                     F.when(extracted.isNotNull(), "extracted").otherwise("decoded").alias("via"))


def q_admit_uploads(spark, sf):
    up = FX.uploads(spark, sf)
    return up.select("request_id", "filename",
                     RF.admitted(F.col("filename"), F.col("size")).alias("admitted"))


def q_extract_cards(spark, sf):
    return extract_cards(FX.pages_jobs(spark, sf), scrape_date=SCRAPE_DATE)


def q_flatten_job_feed(spark, sf):
    return flatten_job_feed(FX.feeds_raw(spark, sf), scrape_date=SCRAPE_DATE)


def q_first_nonempty_source(spark, sf):
    cols = ("title", "company", "location", "link", "source", "date_scraped")
    cards = extract_cards(FX.pages_jobs(spark, sf), scrape_date=SCRAPE_DATE).select(*cols)
    feed = flatten_job_feed(FX.feeds_raw(spark, sf), scrape_date=SCRAPE_DATE).select(*cols)
    return first_nonempty(cards, feed)


def q_fallback_to_feed(spark, sf):
    """A8 where the first source has no rows: the pages without any card."""
    cols = ("title", "company", "location", "link", "source", "date_scraped")
    pages = FX.pages_jobs(spark, sf).where("page_id % 20 = 0")
    cards = extract_cards(pages, scrape_date=SCRAPE_DATE).select(*cols)
    feed = flatten_job_feed(FX.feeds_raw(spark, sf), scrape_date=SCRAPE_DATE).select(*cols)
    return first_nonempty(cards, feed)


def q_page_cards(spark, sf):
    """A9 and B3 on the pages table: every list item is a card, its link both
    title and target."""
    pages = table(spark, sf, "pages")
    cards = extract_cards(pages, scrape_date=SCRAPE_DATE, containers=(("li", None),), title=(("a", None),), link=(("a", None),))
    return cards.select("page_id", "card_no", "title", "location", C.canonical_link(F.col("link")).alias("link"))


def q_stream_job_snapshot(spark, sf):
    from talentmatch.streaming.snapshot import run_snapshot_over_pages
    return run_snapshot_over_pages(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
