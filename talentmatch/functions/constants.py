"""Fixed values that must equal the matched application's for equal results.

Everything in this module is data, not logic: word lists, message texts,
markup class names and thresholds.  They are written out plainly, in the
order the application uses them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the application's behaviour exactly)
# ---------------------------------------------------------------------------

# Skill lexicon, lower case, in the application's order (48 entries).
SKILL_LEXICON: tuple[str, ...] = (
    "python", "java", "javascript", "typescript", "html", "css",
    "react", "angular", "vue", "node", "express", "django", "flask",
    "sql", "mysql", "postgresql", "mongodb", "aws", "azure", "gcp",
    "docker", "kubernetes", "machine learning", "data analysis",
    "tensorflow", "pytorch", "pandas", "numpy", "git", "linux",
    "c++", "c#", "php", "ruby", "swift", "kotlin", "go", "rust",
    "data science", "ai", "artificial intelligence", "deep learning",
    "big data", "hadoop", "spark", "tableau", "power bi", "excel",
)

# Section keywords used by the résumé record.
SECTION_EXPERIENCE = "experience"
SECTION_EDUCATION = "education"
SECTION_SKILLS = "skills"

# Truncation limits and the ellipsis appended beyond them.
SECTION_MAX_CHARS = 200
RAW_TEXT_MAX_CHARS = 500
ELLIPSIS = "..."

# Name fallback and error messages.
UNKNOWN_NAME = "Unknown"
EMPTY_TEXT_ERROR = "Empty file or no text could be extracted"
MANUAL_PROFILE_NAME = "Candidate"

# Upload admission.
ALLOWED_EXTENSIONS: tuple[str, ...] = ("pdf", "docx", "txt")
MAX_UPLOAD_BYTES = 16 * 1024 * 1024
TOO_LARGE_ERROR = "File too large. Please upload a file smaller than 16MB."

# Matching.
DEFAULT_TOP_N = 5

# Score bands (lower bounds, checked high first) and their labels.
BAND_HIGH = 0.7
BAND_MEDIUM = 0.5
BAND_LABELS = ("high", "medium", "low")

# Job-card extraction: cards per page and per-field selectors, each a list
# of (tag, class) alternatives tried in order, with the value used when none
# is present.
MAX_CARDS_PER_PAGE = 15
CARD_CONTAINERS = (
    ("div", "base-card"),
    ("li", "jobs-search-results__list-item"),
    ("div", "job-search-card"),
)
CARD_TITLE = (("h3", "base-search-card__title"), ("h3", "job-card-search__title"))
CARD_COMPANY = (("h4", "base-search-card__subtitle"), ("a", "hidden-nested-link"))
CARD_LOCATION = (("span", "job-search-card__location"), ("span", "job-card-search__location"))
CARD_LINK = (("a", "base-card__full-link"), ("a", "job-card-search__link-wrapper"))
MISSING_TITLE = "N/A"
MISSING_COMPANY = "N/A"
MISSING_LOCATION = "Remote"
MISSING_LINK = "#"
SOURCE_HTML = "LinkedIn"
SOURCE_FEED = "RemoteOK"

# JSON feed keys: output column <- feed key, default when the key is absent.
FEED_FIELDS = (
    ("title", "position", "N/A"),
    ("company", "company", "N/A"),
    ("location", "location", "Remote"),
    ("link", "url", "#"),
)

# Strings a pandas CSV read turns into missing values.
CSV_NA_VALUES: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Three jobs used when no job table exists.
DEFAULT_JOBS = (
    ("Software Developer", "Tech Company", "Remote", "#"),
    ("Data Analyst", "Data Corp", "New York, NY", "#"),
    ("Web Developer", "Web Solutions", "San Francisco, CA", "#"),
)

# Rule-based advice: trigger skills and the four lines each rule adds.
ADVICE_RULES = (
    (
        ("python", "machine learning", "data"),
        (
            "🎯 **Career Path**: Data Scientist / ML Engineer",
            "📚 **Skills to Learn**: TensorFlow, PyTorch, AWS",
            "💡 **Certifications**: Google Data Analytics, AWS ML Specialty",
            "🚀 **Next Steps**: Build portfolio projects with real datasets",
        ),
    ),
    (
        ("javascript", "react", "node"),
        (
            "🎯 **Career Path**: Full-Stack Developer",
            "📚 **Skills to Learn**: React Native, GraphQL, Docker",
            "💡 **Certifications**: Google Cloud Associate, React Certification",
            "🚀 **Next Steps**: Contribute to open-source projects",
        ),
    ),
)
ADVICE_DEFAULT = (
    "🎯 **Career Path**: Based on your skills, consider technology roles",
    "📚 **Skills to Learn**: Python, Cloud Computing, Data Analysis",
    "💡 **Certifications**: Entry-level tech certifications",
    "🚀 **Next Steps**: Gain practical experience through projects",
)
ADVICE_SEPARATOR = "\n\n"
ADVICE_NOT_SPECIFIED = "Not specified"

# Advice prompt template; {skills}, {experience}, {education} are filled in.
ADVICE_PROMPT_TEMPLATE = """
        As a career advisor, analyze this resume and provide specific advice:

        Skills: {skills}
        Experience: {experience}
        Education: {education}

        Provide:
        1. 2-3 suitable career paths with explanations
        2. 2-3 skills to learn with resources
        3. Recommended certifications
        4. Actionable next steps

        Format with clear sections and emojis.
        """
