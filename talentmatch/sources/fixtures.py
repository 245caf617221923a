"""Derived input views built from the given tables.

The test tables hold no résumés, job postings, card markup or feeds, so
these views derive them from ``customer`` and ``part``.  Each SQL text
runs unchanged on Spark and on DuckDB (the oracles inline it in a ``WITH``
clause), with ``{customer}`` / ``{part}`` standing for the base tables.
Their row counts grow with the tables, so every query over them scales.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmatch.functions.constants import SKILL_LEXICON
from talentmatch.session import dealt, table

LEXICON_TEXT = ",".join(SKILL_LEXICON)

RESUMES_RAW = """
select c_custkey resume_id, concat(
 case when c_custkey % 11 = 0 then 'Résumé ' else '' end,
 split_part('Ada,Alan,Grace,Edsger,Barbara', ',', cast(c_custkey % 5 + 1 as int)), ' ',
 split_part('Lovelace,Turing,Hopper,Dijkstra,Liskov,Codd,Gray', ',', cast(c_custkey % 7 + 1 as int)), chr(10), chr(10),
 lower(c_mktsegment), ' analyst | ', case when c_custkey % 13 = 0 then '' else concat('c', c_custkey, '@example.com | ') end,
 case when c_custkey % 6 = 0 then '' else concat('(', 200 + c_custkey % 700, ') ', 200 + c_custkey % 600, '-', lpad(cast(c_custkey as string), 4, '0')) end, chr(10), chr(10),
 case when c_custkey % 9 = 0 then 'Digital category lead.' else concat('SKILLS: ',
   split_part('LEXICON', ',', cast(c_custkey % 48 + 1 as int)), ', ', split_part('LEXICON', ',', cast((c_custkey * 7 + 3) % 48 + 1 as int))) end, chr(10), chr(10),
 'EXPERIENCE: ', c_custkey % 20, ' years as Data Analyst at ', c_name, chr(10), chr(10), 'EDUCATION: BSc Computer Science; nation ', c_nationkey) text from {customer}
""".replace("LEXICON", LEXICON_TEXT)

JOBS_RAW = """
select p_partkey job_id, concat('  ', upper(split_part('LEXICON', ',', cast(p_partkey % 48 + 1 as int))), ' ', p_type, ' Engineer') title, concat(p_brand, ' Inc ') company,
 case when p_partkey % 7 = 0 then ' Remote' when p_partkey % 7 = 1 then 'US (REMOTE ok)' else concat('City ', p_size, ', ST') end location,
 concat('https://jobs.example.com/view/', p_partkey, '?ref=', p_size) link from {part}
""".replace("LEXICON", LEXICON_TEXT)

PAGES_JOBS = """
select p_partkey page_id, concat('<html><body>', repeat(concat(
  case p_partkey % 3 when 0 then '<div class="base-card x">' when 1 then '<li class="jobs-search-results__list-item">' else '<div class="a job-search-card">' end,
  case when p_partkey % 5 = 0 then '' else concat('<h3 class="', case when p_partkey % 2 = 0 then 'base-search-card__title' else 'job-card-search__title' end, '"> ', p_name, ' &amp; co </h3>') end,
  '<h4 class="base-search-card__subtitle">', p_brand, '</h4>',
  case when p_partkey % 7 = 0 then '' else concat('<span class="job-search-card__location">City ', p_size, '</span>') end,
  case when p_partkey % 4 = 0 then '' else concat('<a class="base-card__full-link" href="https://jobs.example.com/view/', p_partkey, '?x=1">go</a>') end,
  case when p_partkey % 3 = 1 then '</li>' else '</div>' end), cast(p_partkey % 20 as int)), '</body></html>') html from {part}
"""

FEEDS_RAW = """
select p_partkey feed_id, case when p_partkey % 10 = 9 then '{{"error": 1}}' else concat('[{{"legal": "x"}}, {{"position": "', p_name, '", "company": ', case when p_partkey % 3 = 0 then 'null' else concat('"', p_brand, '"') end, ', "url": "https://jobs.example.com/', p_partkey, '"', case when p_partkey % 2 = 0 then ', "location": "City"' else '' end, '}}]') end body from {part}
"""

# Manual form rows: padded comma lists of skills, some blank (rejected) and
# some a bare comma (accepted with no skills).
FORMS_RAW = """
select c_custkey request_id,
 case when c_custkey % 10 = 0 then '   ' when c_custkey % 10 = 1 then ',' else concat(' ', split_part('LEXICON', ',', cast(c_custkey % 48 + 1 as int)), ' ,  ', upper(split_part('LEXICON', ',', cast((c_custkey * 5 + 1) % 48 + 1 as int))), ', ') end skills,
 concat(' ', cast(c_custkey % 20 as string), ' years at ', c_name, ' ') experience,
 case when c_custkey % 4 = 0 then '' else ' BSc Computer Science ' end education
from {customer}
""".replace("LEXICON", LEXICON_TEXT)

# Uploaded résumé files: a name with assorted extensions, a size (some over
# the cap) and the text (some blank, which fails to parse).
UPLOADS_SQL = """
select resume_id request_id,
 concat('cv_', cast(resume_id as string), case cast(resume_id % 7 as int) when 0 then '.pdf' when 1 then '.PDF' when 2 then '.docx' when 3 then '.txt' when 4 then '.exe' when 5 then '' else '.tar.txt' end) filename,
 case when resume_id % 19 = 0 then cast(20000000 as bigint) else cast(length(text) as bigint) end size,
 case when resume_id % 17 = 0 then '  ' else text end text
from {resumes}
"""

VIEWS = {
    "resumes_raw": (RESUMES_RAW, "customer"),
    "jobs_raw": (JOBS_RAW, "part"),
    "pages_jobs": (PAGES_JOBS, "part"),
    "feeds_raw": (FEEDS_RAW, "part"),
    "forms_raw": (FORMS_RAW, "customer"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over its base table, whose rows are dealt out over all tasks
    before texts, pages and files are made of them."""
    sql, base = VIEWS[name]
    rows = table(spark, sf_dir, base)
    return spark.sql(sql, **{base: dealt(rows.select(*[c for c in rows.columns if c in sql]))})


def view_sql(name: str) -> str:
    """The same view for DuckDB, where the base tables are registered."""
    if name == "uploads":
        return UPLOADS_SQL.format(resumes="resumes_raw")
    sql, base = VIEWS[name]
    return sql.format(**{base: base})


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(UPLOADS_SQL, resumes=resumes_raw(spark, sf_dir))


def forms_raw(spark, sf_dir):
    return view(spark, sf_dir, "forms_raw")


def resumes_raw(spark, sf_dir):
    return view(spark, sf_dir, "resumes_raw")


def jobs_raw(spark, sf_dir):
    return view(spark, sf_dir, "jobs_raw")


def pages_jobs(spark, sf_dir):
    return view(spark, sf_dir, "pages_jobs")


def feeds_raw(spark, sf_dir):
    return view(spark, sf_dir, "feeds_raw")


def docx_of(text: str) -> bytes:
    """A text document with a paragraph for each line; every second paragraph
    is a link, tabs are elements."""
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"

    def paragraph(n: int, line: str) -> str:
        run = "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in line.split("\t"))
        run = f"<w:r><w:rPr><w:b/></w:rPr>{run}</w:r>"
        return f"<w:p><w:pPr/>{f'<w:hyperlink>{run}</w:hyperlink>' if n % 2 else run}</w:p>"

    body = "".join(paragraph(n, line) for n, line in enumerate(text.split("\n")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                  f'<Relationship Id="r1" Type="{office}" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{word}"><w:body>{body}<w:sectPr/></w:body></w:document>')
    return out.getvalue()


def pdf_of(text: str, per_page: int = 50) -> bytes:
    """A PDF with ``per_page`` lines of the text a page.  Codes number the
    characters and only the font's map tells what they are.  Lines are placed
    in turn by a matrix, by steps and by next-line operators, every second one
    as words with gaps instead of blanks; the last line of a page is drawn
    first; every second page is compressed."""
    codes = {c: n for n, c in enumerate(sorted(set(text)), 1)}

    def drawn(words: str) -> str:
        return "<" + "".join(f"{codes[c]:04x}" for c in words) + ">"

    def shown(n: int, line: str) -> str:
        words = line.split()
        show = f"[{' -500 '.join(map(drawn, words))}] TJ" if n % 2 else f"{drawn(line)} Tj"
        top = 800 - 14 * (n % per_page)
        if n % 3 == 0:
            return f"BT 14 TL /F1 10 Tf 1 0 0 1 40 {top} Tm {show} ET"
        return f"BT /F1 10 Tf 40 {top + 14} Td " + (f"0 -14 Td {show} ET" if n % 3 == 1 else f"14 TL T* {show} ET")

    lines = [shown(n, line) for n, line in enumerate(text.split("\n"))]
    pages = [lines[i:i + per_page] for i in range(0, len(lines), per_page)]
    listed = [f"<{n:04x}> <{c.encode('utf-16-be').hex()}>" for c, n in codes.items()]
    known = "\n".join(f"{len(part)} beginbfchar {' '.join(part)} endbfchar"
                      for part in (listed[i:i + 100] for i in range(0, len(listed), 100)))
    kids = " ".join(f"{6 + 2 * i} 0 R" for i in range(len(pages)))
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>",
               2: f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /Resources << /Font << /F1 3 0 R >> >> >>",
               3: "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
               4: "<< /Type /Font /Subtype /CIDFontType2 /DW 500 >>"}
    streams = {5: known} | {7 + 2 * i: "\n".join(page[-1:] + page[:-1]) for i, page in enumerate(pages)}
    objects |= {6 + 2 * i: f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * i} 0 R >>" for i in range(len(pages))}
    out = bytearray(b"%PDF-1.5\n")
    for n in sorted(objects | streams):
        if n in objects:
            body = objects[n].encode()
        else:
            packed = n % 4 == 1
            data = zlib.compress(streams[n].encode()) if packed else streams[n].encode()
            body = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" * packed, data)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return bytes(out + b"trailer << /Root 1 0 R >>\n%%EOF\n")


def pdf_content(text: Column) -> Column:
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(pdf_of)

    return packed(text)


def docx_content(text: Column) -> Column:
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(docx_of)

    return packed(text)


def upload_files(spark, sf_dir) -> DataFrame:
    """The uploads as files: ``.docx`` ones are packed, but every fifth of
    them is plain bytes under that name."""
    up = uploads(spark, sf_dir)
    is_docx = F.col("filename").endswith(".docx") & (F.col("request_id") % 5 != 0)
    return up.select("request_id", "filename", "size", F.when(is_docx, docx_content(F.col("text")))
                     .otherwise(F.encode("text", "UTF-8")).alias("content"))


def pdf_files(spark, sf_dir) -> DataFrame:
    """Every résumé as a PDF; every seventh is plain bytes under that name."""
    r = resumes_raw(spark, sf_dir)
    content = F.when(F.col("resume_id") % 7 == 0, F.encode("text", "UTF-8")).otherwise(pdf_content(F.col("text")))
    return r.select("resume_id", F.concat(F.lit("cv_"), F.col("resume_id").cast("string"), F.lit(".PDF")).alias("file"), content.alias("content"))
