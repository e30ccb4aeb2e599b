"""Structure out of text: prerequisites, catalogue blocks, JSON replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.strings import col, single_spaced, strip

UNITS = r"\((\d+)\s*units?\)"


def prerequisites(text: Column | str) -> Column:
    """Course codes named in a text, capitals, each once, in order; AND and OR make no difference."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?i)\b([A-Z]{2,5}\s*[0-9]{3,4})\b"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"(?U)\s", ""))))


def course_blocks(df: DataFrame, text: str, ident: str) -> DataFrame:
    """ident, ord, block: the course entries of a catalogue text.

    A line that starts with a code begins an entry if a units marker follows before the next such
    line; other candidates belong to the entry before them, those before the first entry to none."""
    parts = df.select(ident, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?m)(?=^[A-Z]{2,6}\d{4}\s)")).alias("ord", "part"))
    real = F.col("part").rlike(r"^[A-Z]{2,6}\d{4}\s") & F.col("part").rlike(UNITS)
    w = Window.partitionBy(ident).orderBy("ord")
    runs = parts.withColumn("entry", F.sum(real.cast("int")).over(w)).where("entry > 0")
    gathered = runs.groupBy(ident, "entry").agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("p"))
    return gathered.select(ident, F.col("entry").cast("int").alias("ord"), F.array_join(F.col("p.part"), "").alias("block"))


def course_fields(block: Column | str) -> Column:
    """struct(code, name, units, prerequisites_text, description), null where a block has no code, no units, or no text."""
    b = col(block)
    code = F.regexp_extract(b, r"(?s)^\s*([A-Z]{2,6}\d{4})\s", 1)
    units = F.regexp_extract(b, UNITS, 1)
    name = single_spaced(F.regexp_extract(b, r"(?s)^\s*[A-Z]{2,6}\d{4}\s+(.*?)\(\d+\s*units?\)", 1))
    after = F.regexp_replace(b, rf"(?s)^.*?{UNITS}", "")  # what follows the first units marker
    prereq = single_spaced(F.regexp_extract(after, r"(?s)Pre-requisite\(s\)[:：](.*?)(?:Course Description[:：]|\z)", 1))
    description = single_spaced(F.regexp_extract(after, r"(?s)Course Description[:：](.*)\z", 1))
    made = F.struct(code.alias("code"), name.alias("name"), units.cast("int").alias("units"), prereq.alias("prerequisites_text"), description.alias("description"))
    return F.when((code != "") & (units != "") & ((prereq != "") | (description != "")), made)


def catalog(df: DataFrame, text: str, ident: str) -> DataFrame:
    """Courses of catalogue texts: the first entry of each code counts, failed entries are dropped."""
    rows = course_blocks(df, text, ident).select(ident, "ord", course_fields("block").alias("c")).where("c is not null")
    first = Window.partitionBy("c.code").orderBy(ident, "ord")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("c.*")


def _bracketed(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket."""
    return F.nullif(F.regexp_extract(text, rf"(?s)(\{opening}.*\{closing})", 1), F.lit(""))


def _strings(v: Column) -> Column:
    """Non-blank strings of a JSON array (a variant), stripped; other kinds are dropped."""
    items = F.try_variant_get(v, "$", "array<variant>")
    kept = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.filter(F.transform(kept, lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x != "")


def json_strings(reply: Column | str) -> Column:
    """Strings of the JSON array in a reply; anything that fails gives an empty array."""
    v = F.try_parse_json(_bracketed(F.coalesce(col(reply), F.lit("")), "[", "]"))
    return F.coalesce(_strings(v), F.array().cast("array<string>"))


INSIGHT_KEYS = ("headline", "strengths", "gaps", "strategy")


def json_insight(reply: Column | str) -> Column:
    """struct of four strings; a missing key or a failed parse gives empty strings."""
    v = F.from_json(_bracketed(F.coalesce(col(reply), F.lit("")), "{", "}"), ", ".join(f"{k} string" for k in INSIGHT_KEYS))
    return F.struct(*(strip(F.coalesce(v[k], F.lit(""))).alias(k) for k in INSIGHT_KEYS))


def json_transcript(reply: Column | str) -> Column:
    """struct(major, year, gpa, completed_courses, current_courses) of a JSON reply.

    gpa only if it is a number; lists keep non-blank strings; a year that is no number is 0."""
    v = F.try_parse_json(_bracketed(F.coalesce(col(reply), F.lit("")), "{", "}"))
    number = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("BIGINT|DECIMAL|DOUBLE|INT")
    empty = F.array().cast("array<string>")
    lists = lambda path: F.coalesce(_strings(F.try_variant_get(v, path, "variant")), empty)
    return F.struct(
        strip(F.coalesce(F.try_variant_get(v, "$.major", "string"), F.lit(""))).alias("major"),
        F.coalesce(F.try_variant_get(v, "$.year", "int"), F.lit(0)).alias("year"),
        F.when(number("$.gpa"), F.try_variant_get(v, "$.gpa", "double")).alias("gpa"),
        lists("$.completed_courses").alias("completed_courses"),
        lists("$.current_courses").alias("current_courses"),
    )
