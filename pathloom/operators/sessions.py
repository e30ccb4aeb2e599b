"""Timetable sessions collapsed to offerings, and the course master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = ("title_session", "units", "requirements", "offering_unit", "offering_programme")
LISTS = {"schedule": "schedules", "classroom": "classrooms", "teacher": "teachers"}


def _ordered_distinct(c: str, order: str) -> Column:
    filled = F.collect_list(F.when((F.col(c) != "") & F.col(c).isNotNull(), F.struct(order, c)))
    return F.array_distinct(F.transform(F.array_sort(filled), lambda x: x[c]))


def collapse_sessions(sessions: DataFrame, *, code: str = "course_code", order: str = "ord", first: tuple = FIRST, lists: dict = LISTS) -> DataFrame:
    """One row per code: the first non-null value of some fields, the distinct non-empty strings of others in order."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return sessions.groupBy(code).agg(*firsts, *(_ordered_distinct(c, order).alias(n) for c, n in lists.items()))


def course_master(catalog: DataFrame, offerings: DataFrame) -> DataFrame:
    """Catalogue courses with what is known of their offering; `is_offered_current_sem` if there is a schedule."""
    o = offerings.select(F.col("course_code").alias("code"), "schedules", "classrooms", "teachers", "offering_unit", "offering_programme", "requirements")
    out = catalog.join(o, "code", "left")
    return out.withColumn("is_offered_current_sem", F.coalesce(F.size("schedules") > 0, F.lit(False)))
