"""Tables of the descriptive report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.skills import clean_title
from pathloom.functions.strings import strip
from pathloom.operators.taxonomy import dense_rank_ids

# Lower bounds of the frequency bins and their names.
BINS = [(1, "1x"), (2, "2x"), (3, "3-5x"), (6, "6-10x"), (11, "11-25x"), (26, "26-50x"), (51, "51-100x"), (101, "101-500x"), (501, "501-1000x"), (1001, "1001+")]


def frequency_bins(freq: DataFrame, column: str = "doc_frequency") -> DataFrame:
    """bin, n of every bin, empty ones too; frequencies below 1 are in none."""
    spark = freq.sparkSession
    name = None
    for low, label in reversed(BINS):
        hit = F.col(column) >= low
        name = F.when(hit, label) if name is None else name.when(hit, label)
    counts = freq.groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(label,) for _, label in BINS], "bin string")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def coverage_curve(freq: DataFrame, *, skill: str = "skill", column: str = "doc_frequency") -> DataFrame:
    """rank (from 1), skill, cum_pct: running share of all mentions, most frequent first, ties by skill.

    Made of ranges: rows are sorted and numbered in parts, running sums are made within a part and
    moved on by the sums of the parts before it."""
    n_parts = 1024
    ranked = dense_rank_ids(freq.select(F.col(skill).alias("skill"), F.coalesce(F.col(column), F.lit(0)).cast("bigint").alias("df")), [F.desc("df"), "skill"], "r")
    ranked = ranked.withColumn("part", F.floor(F.col("r") / n_parts))
    inner = Window.partitionBy("part").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranked.groupBy("part").agg(F.sum("df").alias("s"))
    before = sums.withColumn("b", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per 1024
    total = freq.agg(F.sum(column).alias("t"))
    rows = ranked.withColumn("run", F.sum("df").over(inner)).join(before.select("part", "b"), "part").crossJoin(F.broadcast(total))
    return rows.select((F.col("r") + 1).alias("rank"), "skill", F.round(100 * (F.col("run") + F.col("b")) / F.col("t"), 6).alias("cum_pct"))


def skills_per_doc(docs: DataFrame, raw: str) -> DataFrame:
    """n_skills, n_docs: how many documents have so many entries (blank: 0, else the plain split)."""
    n = F.when(strip(F.coalesce(F.col(raw), F.lit(""))) == "", 0).otherwise(F.size(F.split(F.col(raw), ",")))
    return docs.groupBy(n.alias("n_skills")).agg(F.count(F.lit(1)).alias("n_docs"))


def overlap(left: DataFrame, right: DataFrame, skill: str = "skill") -> DataFrame:
    """side (courses only, both, jobs only), n of the distinct skills of two tables."""
    a, b = left.select(skill).distinct(), right.select(skill).distinct()
    one = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return one(a.join(b, skill, "left_anti"), "courses only").unionAll(one(a.join(b, skill, "left_semi"), "both")).unionAll(one(b.join(a, skill, "left_anti"), "jobs only"))


def with_source(freq: DataFrame, courses: DataFrame, jobs: DataFrame, skill: str = "skill") -> DataFrame:
    """freq with in_courses, in_jobs and source."""
    c = courses.select(skill).distinct().withColumn("_c", F.lit(True))
    j = jobs.select(skill).distinct().withColumn("_j", F.lit(True))
    out = freq.join(c, skill, "left").join(j, skill, "left").withColumns({"in_courses": F.coalesce("_c", F.lit(False)), "in_jobs": F.coalesce("_j", F.lit(False))}).drop("_c", "_j")
    return out.withColumn("source", F.when(F.col("in_courses") & F.col("in_jobs"), "both").when(F.col("in_courses"), "courses only").otherwise("jobs only"))


def shown_titles(titles: DataFrame, title: str = "title") -> DataFrame:
    """title: clean titles, one per case-insensitive spelling, the longest (then the first by text)."""
    t = titles.select(strip(title).alias("title")).where(clean_title("title")).distinct()
    return t.groupBy(F.lower("title").alias("k")).agg(F.min_by("title", F.struct(-F.length("title"), F.col("title"))).alias("title")).select("title")
