"""Skill names: canonical form, category, keys for near-duplicates, titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.strings import capital_first, col, single_spaced, strip

# Acronyms that stay in capitals.
ACRONYMS = (
    "SQL NLP AI API REST ETL AWS GCP TCP CSS HTML CRUD JSON XML CI/CD GUI UI UX OS PHP "
    "CSV PDF URL HTTP HTTPS VPN RPC RAG LLM GAN CNN RNN GPU CPU SVM PCA KNN"
).split()

# Names that stand for another one, in lower case.
ALIASES = {
    "ml": "Machine Learning", "dl": "Deep Learning", "nlp": "Natural Language Processing", "ai": "Artificial Intelligence",
    "py": "Python", "python programming": "Python", "javascript": "JavaScript", "js": "JavaScript", "ts": "TypeScript",
    "k8s": "Kubernetes", "tf": "TensorFlow", "tensorflow": "TensorFlow", "pytorch": "PyTorch",
    "scikit-learn": "scikit-learn", "sklearn": "scikit-learn", "powerbi": "Power BI", "power bi": "Power BI",
}

# Keywords of the categories; the first category with a match holds.
CATEGORIES = {
    "Programming Languages": ["python", "java", "javascript", "typescript", "c++", "c#", "go", "rust", "ruby", "php", "scala", "kotlin", "swift", "r", "matlab", "sas"],
    "ML & AI": ["machine learning", "deep learning", "artificial intelligence", "neural", "tensorflow", "pytorch", "scikit-learn", "computer vision", "nlp", "natural language", "reinforcement learning", "generative", "llm", "transformer", "bert", "gpt", "cnn", "rnn", "gan"],
    "Data Systems": ["sql", "nosql", "mongodb", "postgresql", "mysql", "spark", "hadoop", "kafka", "etl", "data warehouse", "snowflake", "bigquery", "redshift", "airflow", "dbt", "data pipeline", "data engineering"],
    "Math & Stats": ["statistics", "statistical", "probability", "regression", "linear algebra", "calculus", "optimization", "bayesian", "hypothesis testing", "anova", "time series", "econometrics"],
    "Tools & Platforms": ["git", "docker", "kubernetes", "aws", "gcp", "azure", "jenkins", "ci/cd", "tableau", "power bi", "excel", "jupyter", "vscode", "linux"],
    "Domain Knowledge": ["marketing", "finance", "accounting", "supply chain", "healthcare", "law", "education", "biology", "chemistry", "physics", "economics"],
}
OTHER = "Other"


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def normalize_skill(raw: Column | str) -> Column:
    """Canonical form of one skill: aliases first, then acronyms, then capitals word by word.
    Fewer than two signs (or null) give an empty string."""
    s = strip(F.coalesce(col(raw), F.lit("")))
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    word = lambda w: F.when(F.array_contains(_literals(ACRONYMS), F.upper(w)), F.upper(w)).otherwise(capital_first(w))
    words = F.transform(F.split(single_spaced(s), " "), word)
    whole = F.array_contains(_literals(ACRONYMS), F.upper(s))
    return F.when(F.length(s) < 2, "").otherwise(F.coalesce(F.try_element_at(alias, F.lower(s)), F.when(whole, F.upper(s)).otherwise(F.array_join(words, " "))))


def keyword_match(text: Column, keyword: str) -> Column:
    """Short keywords must stand at word boundaries, longer ones may stand anywhere."""
    if len(keyword) <= 2:
        edge = r"\b" if keyword[-1].isalnum() else ""
        return text.rlike(rf"\b{re.escape(keyword)}{edge}")
    return text.contains(keyword)


def categorize(skill: Column | str) -> Column:
    """Category of a skill, a chain of CASE branches in the declared order."""
    low = F.lower(col(skill))
    out = None
    for name, keywords in CATEGORIES.items():
        hit = keyword_match(low, keywords[0])
        for k in keywords[1:]:
            hit = hit | keyword_match(low, k)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER)


def name_key(s: Column | str) -> Column:
    """Lower case; signs but letters, digits, + and # become blanks; single-spaced."""
    return single_spaced(F.regexp_replace(F.lower(strip(s)), r"[^a-z0-9+#\s]", " "))


def has_key(s: Column | str) -> Column:
    """Whether the key of a name (`name_key`) has a sign, without making the key."""
    return F.lower(col(s)).rlike("[a-z0-9+#]")


def shingles(s: Column | str, k: int = 3) -> Column:
    """Distinct runs of k signs; a shorter text is its own shingle, an empty one has none.
    The text is a variable, so that it is worked out once, not again for every run."""

    def cut(t: Column) -> Column:
        n = F.length(t)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(k)))
        return F.when(n >= k, F.array_distinct(runs)).when(n > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(strip(s)), cut)[0]


def clean_title(t: Column | str) -> Column:
    """Whether a career title is fit to be shown."""
    t = col(t)
    fair = F.length(t).between(3, 60) & ~t.rlike(r"\*{2,}|\|{2}|~~") & ~t.contains("$")
    return fair & F.when(t.startswith("."), t.rlike(r"^\.[A-Za-z]")).otherwise(~t.rlike(r"^[*$(\d]"))


def year_level(code: Column | str) -> Column:
    """First digit of a course code; 0 and none count as 99."""
    digit = F.regexp_extract(col(code), "[0-9]", 0)
    return F.when(digit.isin("", "0"), 99).otherwise(digit.cast("int"))
