"""Frequency of every distinct term over compressed record-identifier bitmaps.

Vertical layout: a term owns the set of records that hold it.  Records are numbered within their
partition, so numbers are dense and a term's records fall into few chunks of 65,536; a chunk is
kept as a sorted array of 16-bit numbers while it has at most 4,096 of them, else as a bitmap of
8 KB.  Every (term, chunk) carries counters beside its set: occurrences and summed weight.
Chunks are merged by union, counters by addition, and the document frequency is the cardinality.

Defined results: null records and null terms are left out, null weights count as 0; a record that
is repeated with the same term and weight counts once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARRAY_MAX = 4096
CHUNK_BITS = 16


def encode(members: np.ndarray) -> bytes:
    """Container of sorted distinct 16-bit numbers: an array up to ARRAY_MAX of them, a bitmap beyond."""
    members = np.asarray(members, np.uint16)
    if len(members) <= ARRAY_MAX:
        return b"a" + members.tobytes()
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[members] = 1
    return b"b" + np.packbits(bits).tobytes()


def decode(container: bytes) -> np.ndarray:
    if container[:1] == b"a":
        return np.frombuffer(container, np.uint16, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1))).astype(np.uint16)


def union(containers: list[bytes]) -> bytes:
    if len(containers) == 1:
        return containers[0]
    return encode(np.unique(np.concatenate([decode(c) for c in containers])))


def cardinality(container: bytes) -> int:
    if container[:1] == b"a":
        return (len(container) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(container, np.uint8, offset=1)).sum())


_POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("occurrences", T.LongType()), T.StructField("weight", T.DoubleType())])


def term_bitmaps(rows: DataFrame, *, record: str, term: str, weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """term, chunk, bits, occurrences, weight: the compressed bitmaps.

    Repeated rows are folded before the shuffle by record, so a record that makes up a third of
    the input is one row by then.  With `partitions` given, the same records have the same numbers
    in every run, so that bitmaps can be merged."""
    w = F.lit(0.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = rows.select(F.col(record).cast("string").alias("r"), F.col(term).alias("t"), w.alias("w"))
    rows = rows.where("r is not null and t is not null").distinct()
    rows = rows.repartition(partitions, "r") if partitions else rows.repartition("r")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, last, base = None, None, 0  # the number of a record: its partition, then the order of its first row
        open_: dict[tuple[str, int], list] = {}

        def drain(upto: int | None):
            keys = [k for k in open_ if upto is None or k[1] < upto]
            for a in range(0, len(keys), 4096):
                part = keys[a : a + 4096]
                got = [open_.pop(k) for k in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.int64()),
                    pa.array([encode(np.unique(np.array(g[0], np.uint16))) for g in got], pa.binary()),
                    pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()),
                ], names=[f.name for f in _POSTINGS])

        for batch in batches:  # sorted by record: a chunk is complete once the next one begins
            for r, t, x, p in zip(*(batch.column(k).to_pylist() for k in range(4))):
                high = p << 40 if high is None else high
                if last != r:
                    last = r
                    base += 1
                    if base & 0xFFFF == 1 and base > 1:
                        yield from drain((high + base - 1) >> CHUNK_BITS)
                n = high + base - 1
                slot = open_.setdefault((t, n >> CHUNK_BITS), [[], 0, 0.0])
                slot[0].append(n & 0xFFFF)
                slot[1] += 1
                slot[2] += x
        yield from drain(None)

    numbered = rows.sortWithinPartitions("r").withColumn("p", F.spark_partition_id().cast("bigint"))
    return numbered.mapInArrow(build, _POSTINGS)


def term_frequencies(rows: DataFrame, *, record: str, term: str, weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """term, doc_freq, occurrences, weight.

    A chunk lives in one partition only, so the union of a term's chunks is disjoint and its
    cardinality the sum of theirs; containers of the same chunk, which only a merge of separately
    built bitmaps can bring, go through `merge` first."""
    maps = term_bitmaps(rows, record=record, term=term, weight=weight, partitions=partitions)
    return count_bitmaps(maps)


def count_bitmaps(maps: DataFrame) -> DataFrame:
    """Document frequencies and counters of disjoint bitmaps; the cardinality is read off the containers in the JVM."""
    size = F.octet_length("bits") - 1
    in_array = F.substring("bits", 1, 1) == F.lit(b"a")
    dense = F.bitmap_count(F.substring("bits", 2, 8192))
    card = F.when(in_array, (size / 2).cast("bigint")).otherwise(dense)
    return maps.withColumn("_card", card).groupBy("term").agg(
        F.sum("_card").alias("doc_freq"), F.sum("occurrences").alias("occurrences"), F.sum("weight").alias("weight"),
    )


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two sets of bitmaps over the same record numbers, counters added.

    A group is the containers of one term and chunk, two at most."""

    def fold(table: pa.Table) -> pa.Table:
        bits = union([b for b in table.column("bits").to_pylist()])
        total = [sum(table.column(c).to_pylist()) for c in ("occurrences", "weight")]
        return pa.table([[table.column("term")[0].as_py()], [table.column("chunk")[0].as_py()], pa.array([bits], pa.binary()), *[[x] for x in total]], names=table.column_names)

    return left.unionByName(right).groupBy("term", "chunk").applyInArrow(fold, _POSTINGS)


def with_bands(freq: DataFrame, *, rare_below: float = 5, common_above: float = 0.01) -> DataFrame:
    """`band`: rare if the weight is below `rare_below`, common if it is above the given share of all
    weights, else usable.  The sum of all weights is one row."""
    total = freq.agg(F.sum("weight").alias("_all"))
    band = F.when(F.col("weight") < rare_below, "rare").when(F.col("weight") > common_above * F.col("_all"), "common").otherwise("usable")
    return freq.crossJoin(F.broadcast(total)).withColumn("band", band).drop("_all")
