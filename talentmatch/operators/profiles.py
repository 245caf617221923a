"""Manual form profiles and per-request profile resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.functions.text import py_strip

NO_PROFILE_ERROR = "Please either upload a resume or enter your skills"


def _form_columns(skills, experience, education):
    raw = py_strip(F.coalesce(skills, F.lit("")))
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: py_strip(x)), lambda x: x != "")
    return raw != "", {
        "name": F.lit(K.MANUAL_PROFILE_NAME),
        "email": F.lit(""),
        "skills": parts,
        "experience": py_strip(F.coalesce(experience, F.lit(""))),
        "education": py_strip(F.coalesce(education, F.lit(""))),
    }


def manual_profiles(forms: DataFrame, *, request_id: str = "request_id",
                    skills: str = "skills", experience: str = "experience",
                    education: str = "education") -> DataFrame:
    """Form rows -> profiles.  A blank skills field rejects the row; the
    field is split on commas, each part stripped, empty parts dropped (so
    "," is accepted and yields no skills)."""
    ok, cols = _form_columns(F.col(skills), F.col(experience), F.col(education))
    return forms.where(ok).select(F.col(request_id).alias("request_id"),
                                  *[c.alias(n) for n, c in cols.items()])


def resolve_profiles(files: DataFrame, forms: DataFrame) -> DataFrame:
    """One profile (or a rejection) per request.

    ``files``: request_id, admitted, too_large, and the parse record (name,
    email, skills, experience, education, error).  ``forms``: raw form rows
    (request_id, skills, experience, education).  A file over the size limit
    rejects the request before its form is read; an admitted file that
    parsed wins; an admitted file that failed to parse rejects the request;
    otherwise (no file, or one of another type) the form is used if its
    skills field is not blank.
    """
    f = files.select("request_id", F.col("admitted").alias("f_admitted"),
                     F.col("too_large").alias("f_too_large"),
                     *[F.col(c).alias("f_" + c) for c in
                       ("name", "email", "skills", "experience", "education", "error")])
    m = forms.select("request_id", *[F.col(c).alias("m_" + c)
                                     for c in ("skills", "experience", "education")])
    j = f.join(m, "request_id", "full")
    form_valid, form_cols = _form_columns(F.col("m_skills"), F.col("m_experience"),
                                          F.col("m_education"))
    refused = F.coalesce(F.col("f_too_large"), F.lit(False))
    use_file = ~refused & F.coalesce(F.col("f_admitted"), F.lit(False))
    file_ok = use_file & F.col("f_error").isNull()
    file_bad = use_file & F.col("f_error").isNotNull()
    form_ok = ~refused & ~use_file & F.col("m_skills").isNotNull() & form_valid

    def pick(c: str):
        return F.when(file_ok, F.col("f_" + c)).when(form_ok, form_cols[c])

    return j.select(
        "request_id",
        F.when(file_ok, "file").when(form_ok, "form").alias("profile_source"),
        pick("name").alias("name"), pick("email").alias("email"),
        pick("skills").alias("skills"), pick("experience").alias("experience"),
        pick("education").alias("education"),
        F.when(refused, F.lit(K.TOO_LARGE_ERROR))
         .when(file_bad, F.concat(F.lit("Resume parsing error: "), F.col("f_error")))
         .when(~file_ok & ~form_ok, F.lit(NO_PROFILE_ERROR)).alias("rejection"))
