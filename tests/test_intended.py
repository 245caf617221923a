"""Résumé fields as meant."""

from __future__ import annotations

import pytest

from talentmatch.functions import constants as K
from talentmatch.operators.parse import RECORD_COLUMNS, parse_resumes, parse_resumes_intended
from test_goldens import SAMPLE

MORE = """curriculum vitae of the year
Name: Zoë Müller-Ångström
mail: <zoe.m+cv@mail.example.org>, call +49 (030) 555-1234.

Experienced in many things; skills: none here
Technical skills
Skills
C++, C#, JavaScript, Machine   Learning
and excellent email manners, R&D

Experience
Lead at Acme: two years
Spark & SQL in 2020
Education: none\r\nHobbies: go, chess
"""


def parsed(spark, text):
    df = spark.createDataFrame([(1, text)], "resume_id long, text string")
    return parse_resumes_intended(df).first()


def test_sample(spark):
    r = parsed(spark, SAMPLE)
    assert (r.name, r.email, r.phone) == ("John Doe", "john.doe@example.com", "(123) 456-7890")
    assert r.skills == ["Machine Learning", "Python", "Sql"]
    assert r.experience == "Data Scientist at ABC Corp (2020-Present)" and r.education == "BSc Computer Science, XYZ University"
    assert r.text_length == len(SAMPLE) and r.error is None


def test_names_phones_sections_and_whole_terms(spark):
    r = parsed(spark, MORE)
    assert r.name == "Zoë Müller-Ångström" and r.email == "zoe.m+cv@mail.example.org" and r.phone == "+49 (030) 555-1234"
    # whole terms: no Java in JavaScript, no Excel in excellent, no Ai in email
    assert r.skills == ["C#", "C++", "Go", "Javascript", "Machine Learning", "Spark", "Sql"]
    assert r.experience == "Lead at Acme: two years\nSpark & SQL in 2020"
    assert r.education == "none"


CASES = [("Experience\n\nLead at Acme\nmore", "Lead at Acme\nmore"), ("EXPERIENCE : a\nb\n\nc", "a\nb"), ("Experience: a\nSkills: b", "a"),
         ("experienced in x", ""), ("my experience: x", ""), ("Experience", ""), ("x\nExperience:\n", ""), ("Experience:\r\n a  b \r\n\r\nz", "a b")]


@pytest.mark.parametrize("text,section", CASES)
def test_sections(spark, text, section):
    assert parsed(spark, text).experience == section


def test_blank_and_columns(spark):
    df = spark.createDataFrame([(1, None), (2, " \n\t"), (3, "ada")], "resume_id long, text string")
    out = parse_resumes_intended(df)
    assert out.columns == parse_resumes(df).columns == ["resume_id", *RECORD_COLUMNS]
    got = {r.resume_id: r for r in out.collect()}
    assert got[1].error == got[2].error == K.EMPTY_TEXT_ERROR and got[1].name is None
    assert (got[3].name, got[3].email, got[3].skills, got[3].error) == (K.UNKNOWN_NAME, "", [], None)
    assert parse_resumes_intended(df.limit(0)).count() == 0
