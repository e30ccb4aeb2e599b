"""Skill counts over event time as Structured Streaming: the same plan runs on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skill_trend(postings: DataFrame, *, time: str, skills: str, window: str = "30 days", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """start, skill, n: mentions per window of event time; rows later than `late` behind the watermark are dropped by a stream."""
    rows = postings.withWatermark(time, late).select(F.col(time).alias("t"), F.explode(skills).alias("skill"))
    by = F.window("t", window, slide) if slide else F.window("t", window)
    return rows.groupBy(by.alias("w"), "skill").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "skill", "n")
