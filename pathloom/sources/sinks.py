"""Sinks.  Every write is a Spark job commit: readers see all of it or none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.graph import CareerGraph
from pathloom.operators.taxonomy import cache_upsert
from pathloom.sources.files import read_cache


def flatten_lists(df: DataFrame, sep: str = ";") -> DataFrame:
    """Array columns as text joined by `sep`; a null list is empty text."""
    arrays = {c for c, t in df.dtypes if t.startswith("array")}
    return df.select(*(F.coalesce(F.array_join(F.col(c).cast("array<string>"), sep), F.lit("")).alias(c) if c in arrays else F.col(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    flatten_lists(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_graph(graph: CareerGraph, folder: str) -> None:
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> CareerGraph:
    return CareerGraph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def flush_cache(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Add new keys to the cache: written beside it, then swapped in."""
    merged = cache_upsert(read_cache(spark, path), new)
    merged.write.mode("overwrite").parquet(f"{path}.new")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    if not fs.rename(fs_path(f"{path}.new"), fs_path(path)):
        raise OSError(f"{path} could not be replaced")


def case_markdown(cases: list[dict]) -> str:
    """Case studies (a handful of rows) as Markdown."""
    out = ["# Case studies", ""]
    for c in cases:
        out += [f"## {c['profile']}", "", f"- student: {c['student_id']}", f"- career goal: {c['career_goal']}", ""]
        out += [f"- {k}: {v}" for k, v in c.items() if k not in ("profile", "student_id", "career_goal")] + [""]
    return "\n".join(out)


def report_html(title: str, tables: dict[str, DataFrame], most: int | None = 100) -> str:
    """Report tables as one page; the first `most` rows of each are shown, all of them if it is None."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1>"]
    for name, df in tables.items():
        shown = df if most is None else df.limit(most)
        with pd.option_context("display.max_colwidth", None):  # else long cells are cut
            parts.append(f"<h2>{name}</h2>" + shown.toPandas().to_html(index=False, escape=True))
    return "\n".join(parts)
