"""Mapping of a column of free-entered values to a reference list (see mentions)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.mentions import OWN_SHARE, OWN_UNNAMED, Mentions, plain
from pathloom.runtime import bounded_rows, keep

MAX_ENTRIES = 100_000


def map_values(values: DataFrame, entries: DataFrame, *, value: str = "val", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """value, entry_id, how for every distinct value.

    `entries` has id, name and aliases (array of strings), one row per entry.  The list is compiled
    into one automaton per task, so it must be bounded: a list of more than `max_entries` rows is
    refused.  Every distinct value is mapped once, however often it occurs; -1 marks a value that
    names no entry.  Null values are left out."""
    listed = [(r["id"], r["name"], list(r["aliases"] or [])) for r in bounded_rows(entries.select("id", "name", "aliases"), max_entries, "the reference list")]
    schema = T.StructType([T.StructField(value, T.StringType()), T.StructField("entry_id", T.IntegerType()), T.StructField("how", T.StringType())])

    spark = values.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    distinct = values.select(value).where(F.col(value).isNotNull()).distinct()
    # matching is the work, so it is not left to few tasks; by a hash, as a repartition by the value
    # itself would be taken for the one of distinct() and coalesced like it
    distinct = keep(distinct.repartition(spread, F.xxhash64(value)))
    own = own_words(distinct, listed, value)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Mentions(listed, own)
            texts = batch.column(0)
            found = [matcher.find(v) for v in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([texts, pa.array([i for i, _ in found], pa.int32()), pa.array([h for _, h in found], pa.string())], names=[value, "entry_id", "how"])

    return distinct.mapInArrow(find, schema)


def own_words(distinct: DataFrame, listed: list, value: str) -> frozenset[str]:
    """Words of the values that look like misspellings of a listed word but are words of their own.

    Counted over all distinct values.  At most 1 / OWN_SHARE words per word of the list can pass, so
    what comes to the driver is bounded by the list."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [w for v in batch.column(0).to_pylist() for w in set(plain(v).split())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Mentions(listed)
            seen = [matcher.look_alike(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x and x[0] for x in seen], pa.string()), pa.array([x and x[1] for x in seen], pa.int32())], names=["word", "n", "target", "edits"])

    counts = distinct.mapInArrow(words, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = keep(counts.mapInArrow(look, "word string, n bigint, target string, edits int").where("target is not null"))
    totals = seen.groupBy("target").agg(F.sum("n").alias("all"))
    frequent = seen.where("edits >= 2").join(totals, "target").where(F.col("n") >= OWN_SHARE * F.col("all"))
    candidates = frozenset(r[0] for r in frequent.select("word").collect())
    seen.unpersist()
    if not candidates:
        return candidates

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            out, unnamed = [], []
            for v in batch.column(0).to_pylist():
                if held := candidates.intersection(plain(v).split()):
                    matcher = matcher or Mentions(listed)
                    out += held
                    unnamed += [int(matcher.find(v)[0] == -1)] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(unnamed, pa.int32())], names=["word", "unnamed"])

    shares = distinct.mapInArrow(read, "word string, unnamed int").groupBy("word").agg(F.avg("unnamed").alias("share"))
    return frozenset(r[0] for r in shares.where(F.col("share") >= OWN_UNNAMED).select("word").collect())


def mapped(rows: DataFrame, entries: DataFrame, *, value: str = "val", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The rows with entry_id and how (which replace columns of these names); rows with a null value
    are left out.  A value that very many rows share is joined skew-split or by broadcast (AQE)."""
    rows = rows.drop("entry_id", "how")
    return rows.join(map_values(rows, entries, value=value, max_entries=max_entries), value)
