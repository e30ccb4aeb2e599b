"""The packed fields of the course tables as rows of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.strings import record_code
from pathloom.operators.packed import CODE_DELIMITERS, VALUE_DELIMITERS, unpack
from pathloom.runtime import bounded_rows
from pathloom.sources.tables import table

MAX_LISTED = 100_000  # entries of skills_canonical that may travel with the tasks


def listed_names(spark: SparkSession, folder: str) -> list[str]:
    names = table(spark, folder, "skills_canonical").select("canonical_name").where("canonical_name is not null").distinct()
    return sorted(r[0] for r in bounded_rows(names, MAX_LISTED, "skills_canonical"))


def packed_values(spark: SparkSession, folder: str, name: str, protected: list[str] | None = None, *, repeats: bool = False) -> DataFrame:
    """rec, pos, val of the packed field of one table; repeated rows count once.

    A record without a value has no row.  Rows of one record that differ in the packed field
    both count.  With `repeats` repeated rows stay, for uses that fold values later anyway: it saves
    a shuffle."""
    df = table(spark, folder, name)
    field, rec, delimiters = {
        "courses_skills": ("extracted_skills", record_code("code"), VALUE_DELIMITERS),
        "courses_canonical": ("canonical_skills", record_code("code"), VALUE_DELIMITERS),
        "jobs_canonical": ("canonical_skills", F.col("job_id"), VALUE_DELIMITERS),
        "students": ("completed_courses", F.col("student_id"), CODE_DELIMITERS),
        "students_clustered": ("completed_courses", F.col("student_id"), CODE_DELIMITERS),
        "skills_canonical": ("variants", F.col("canonical_skill_id").cast("string"), VALUE_DELIMITERS),
    }[name]
    if protected is None:
        protected = listed_names(spark, folder) if delimiters is VALUE_DELIMITERS else []
    rows = df.select(rec.alias("rec"), F.col(field).alias("packed")).where("packed is not null")
    return unpack(rows if repeats else rows.distinct(), "packed", delimiters=delimiters, protected=protected)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """tab, rec, pos, val of every packed field."""
    names = listed_names(spark, folder)
    out = None
    for name in ("courses_skills", "courses_canonical", "students", "skills_canonical"):
        part = packed_values(spark, folder, name, names).select(F.lit(name).alias("tab"), "rec", "pos", "val")
        out = part if out is None else out.unionByName(part)
    return out
