"""Hand-derived goldens (FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentmatch.functions import advice as A
from talentmatch.operators import clean as C
from talentmatch.operators.parse import parse_resumes
from talentmatch.operators.profiles import manual_profiles
from talentmatch.sources import jobs_csv as J
from talentmatch.sources import resume_files as RF
from talentmatch.functions import resume as R

# Fixed inputs: the sample résumé and the text of the dummy file.
SAMPLE = """
    John Doe

    Data Scientist | john.doe@example.com | (123) 456-7890

    SKILLS: Python, Machine Learning, SQL

    EXPERIENCE: Data Scientist at ABC Corp (2020-Present)

    EDUCATION: BSc Computer Science, XYZ University
    """

DUMMY = "This is just a dummy file. Add real resumes to test."


def _parse(spark, text):
    df = spark.createDataFrame([(1, text)], "resume_id long, text string")
    return parse_resumes(df).collect()[0]


def test_sample_resume(spark):
    r = _parse(spark, SAMPLE)
    assert r.name == "John Doe"
    assert r.email == "john.doe@example.com"
    assert r.phone == "123) 456-7890"
    assert r.skills == ["Machine Learning", "Python", "Sql"]
    assert r.experience == ("Data Scientist at ABC Corp (2020-Present) EDUCATION  "
                            "BSc Computer Science  XYZ University")
    assert r.education == "BSc Computer Science  XYZ University"
    assert r.text_length == len(SAMPLE)
    assert r.error is None


def test_sample_clean_text(spark):
    df = spark.createDataFrame([(SAMPLE,)], "t string")
    got = df.select(R.clean_text(F.col("t"))).first()[0]
    assert got == ("John Doe Data Scientist   john.doe@example.com   (123) 456-7890 SKILLS  "
                   "Python  Machine Learning  SQL EXPERIENCE  Data Scientist at ABC Corp "
                   "(2020-Present) EDUCATION  BSc Computer Science  XYZ University")


def test_sample_advice(spark):
    df = spark.createDataFrame([(["Machine Learning", "Python", "Sql"],)], "skills array<string>")
    exact, lowered = df.select(A.career_advice(F.col("skills"), match_case=True),
                               A.career_advice(F.col("skills"), match_case=False)).first()
    from talentmatch.functions import constants as K
    assert exact == K.ADVICE_SEPARATOR.join(K.ADVICE_DEFAULT)
    assert lowered == K.ADVICE_SEPARATOR.join(K.ADVICE_RULES[0][1])


def test_dummy_pdf_text_fallback(spark):
    """A non-PDF '.pdf' reaches the parser through the text decode."""
    df = spark.createDataFrame([("sample.pdf", bytearray(DUMMY.encode()))],
                               "filename string, content binary")
    text = RF.with_fallback(F.lit(None).cast("string"), RF.decode_text(F.col("content")))
    r = parse_resumes(df.select(text.alias("text"))).first()
    assert r.text_length == 52
    assert r.name == "This is"
    assert (r.email, r.phone, r.experience, r.education) == ("", "", "", "")
    assert r.skills == []


def test_form_rows(spark):
    forms = spark.createDataFrame(
        [(1, "Python, SQL, ", "x", "y"), (2, ",", "", ""), (3, "   ", "", "")],
        "request_id long, skills string, experience string, education string")
    got = {r.request_id: r.skills for r in manual_profiles(forms).collect()}
    assert got == {1: ["Python", "SQL"], 2: []}


def test_raw_to_clean_golden(spark, tmp_path):
    """A landed CSV with quoted commas, mixed case and padding, read back
    with a fixed schema and cleaned; the title never sets is_remote."""
    path = tmp_path / "jobs.csv"
    path.write_text(
        "title,company,location,link,source,date_scraped\n"
        'Tram Driver,Harbour Lines,"Porto, Portugal",https://jobs.example.com/a7,FirstFeed,2024-02-29\n'
        '"Cheese Maker, Night Shift",Alp & Sons,"Chur, GR",https://jobs.example.com/b2,FirstFeed,2024-02-29\n'
        "Remote Sensing Lead,Kite Survey,Nairobi,https://jobs.example.com/c9,FirstFeed,2024-02-29\n"
        "  Archivist ,PAPER TRAIL  ,REMOTE (any zone),https://jobs.example.com/d1,SecondFeed,2024-02-29\n")
    got = C.clean_jobs(J.read_jobs_csv(spark, str(path))).orderBy("link").collect()
    assert [(r.title, r.company, r.location, r.is_remote) for r in got] == [
        ("tram driver", "harbour lines", "porto, portugal", 0),
        ("cheese maker, night shift", "alp & sons", "chur, gr", 0),
        ("remote sensing lead", "kite survey", "nairobi", 0),
        ("archivist", "paper trail", "remote (any zone)", 1)]
    assert str(got[0].date_scraped) == "2024-02-29"
