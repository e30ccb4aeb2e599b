"""Pairs of sets that overlap above a threshold, exactly, by shared combinations of rare terms.

Terms are numbered once, rarest first, so sets are sorted arrays of integers.  Of two sets of Jaccard
similarity t or more, the m rarest shared terms are among the first |x| - ceil(t max(|x|, |y|)) + m
of x, and likewise of y.  Sets meet on hashes of such m terms, sizes and 256-bit masks of the sets
are compared before sets are (both tests are exact), and only candidates fetch their sets.

How many terms a key has depends on the larger size of a pair: as many as keep the combinations of
a set within bounds, and no more than `choose_key_terms` finds worth their rows.  Any number gives
the same pairs; it only trades key rows against candidates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.taxonomy import dense_rank_ids
from pathloom.runtime import cut, keep, small_or_joined

EPS = 1e-9
MASKS = ["m0", "m1", "m2", "m3"]  # a set as 256 bits, each term setting one of them
MOST_TERMS, MOST_KEYS = 3, 64  # of a key; of one set for one number of terms, about
SIZES = 1024  # pairs with a larger set take one term a key
ROWS_AT_ONCE = 250_000  # key rows in a batch
SAMPLE, SAMPLE_TERMS = 2048, 1024  # sets drawn to weigh keys against candidates, and their largest size
KEY_COST = 16  # a key row against a candidate pair: one is shuffled and sorted, the other compared


def term_ranks(*sides: DataFrame, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """val, r: every value of the sides' rows (column val) with the number of its term, rarest first,
    ties by the term.  The term is the value as `key` reads it, worked out once per distinct value."""
    rows = None
    for side in sides:
        part = side.select("val").where("val is not null")
        rows = part if rows is None else rows.unionAll(part)
    counts = rows.groupBy("val").agg(F.count(F.lit(1)).alias("n"))
    counts = keep(counts.withColumn("t", F.col("val") if key is None else key(F.col("val"))))
    ranked = dense_rank_ids(counts.groupBy("t").agg(F.sum("n").alias("n")), ["n", "t"], "r")
    # written, as numbers must not change should a part of them be lost
    return cut(counts.join(ranked, "t").select("val", F.col("r").cast("int").alias("r")))


def encoded(rows: DataFrame, ranks: DataFrame, record: str) -> DataFrame:
    """record, terms: the distinct terms of each record (rows of record and val) as ascending numbers.

    Numbers are looked up where the values are if their table is of a checked size, so that the one
    shuffle, by record, carries sets of numbers gathered beforehand."""
    coded = small_or_joined(rows.where(F.col(record).isNotNull()).select(record, "val"), ranks, ["val"])
    return coded.groupBy(record).agg(F.array_sort(F.collect_set("r")).alias("terms"))


def may_be_similar(threshold: float, left: str = "l_", right: str = "r_") -> Column:
    """Exact test on sizes and masks that no pair of the threshold fails.

    Bits that differ are at most the terms that differ, and two sets of similarity t differ in at most
    (1 - t) / (1 + t) * (|x| + |y|) terms."""
    x, y = F.col(f"{left}size"), F.col(f"{right}size")
    differ = sum((F.bit_count(F.col(left + m).bitwiseXOR(F.col(right + m))) for m in MASKS), F.lit(0))
    return (x >= threshold * y - EPS) & (y >= threshold * x - EPS) & (differ <= (x + y) * ((1 - threshold) / (1 + threshold)) + EPS)


def masks(flat: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The four words of each set's mask; no set is empty."""
    bit = flat.astype(np.uint64) & np.uint64(255)
    one = np.uint64(1) << (bit & np.uint64(63))
    return [np.bitwise_or.reduceat(np.where(bit >> np.uint64(6) == w, one, np.uint64(0)), begins).view(np.int64) for w in range(len(MASKS))]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hash of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4096)
def combinations(n: int, m: int) -> np.ndarray:
    """All ways to take m of n places, one a row."""
    if m == 1:
        return np.arange(n, dtype=np.int64)[:, None]
    return np.array(list(itertools.combinations(range(n), m)), np.int64).reshape(-1, m)


class KeyPlan:
    """How many terms make a key for a pair whose larger set has a given size, and the keys of a set."""

    def __init__(self, threshold: float, most_terms: int = MOST_TERMS):
        self.threshold = threshold
        self.by_size = [1]
        for size in range(1, SIZES + 1):
            spare = size - self.least(size)
            self.by_size.append(max([m for m in range(1, most_terms + 1) if m <= self.least(size) and math.comb(spare + m, m) <= MOST_KEYS], default=1))

    def least(self, size: int) -> int:
        """Terms that a set of this size shares at least with any set of the similarity."""
        return math.ceil(size * self.threshold - EPS)

    def numbers(self, size: int) -> dict[int, int]:
        """The numbers of terms a set of this size needs keys of, one for every size the larger set of
        a pair may have, and the least terms that such a pair shares."""
        larger = range(size, min(math.floor(size / self.threshold + EPS), SIZES + 1) + 1) if size <= SIZES else [size]
        out: dict[int, int] = {}
        for s in larger:
            out.setdefault(self.by_size[s] if s <= SIZES else 1, self.least(s))
        return out

    @lru_cache(maxsize=None)  # noqa: B019 - a plan lives as long as its task
    def ways(self, size: int) -> list[tuple[int, np.ndarray]]:
        """(m, places of the terms) of all keys of a set of this size."""
        return [(m, combinations(size - least + m, m)) for m, least in self.numbers(size).items()]

    def keys(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all sets, and for each key the place of its set."""
        sizes, out, parent = np.diff(offsets), [], []
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for m, places in self.ways(size):
                head = flat[offsets[at][:, None] + np.arange(places[-1, -1] + 1)].astype(np.uint64)
                h = np.full((len(at), len(places)), m, np.uint64)
                for j in range(m):
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + head[:, places[:, j]] + np.uint64(1))
                out.append(h.reshape(-1))
                parent.append(np.repeat(at, len(places)))
        return (np.concatenate(out), np.concatenate(parent)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def rare_keys(side: DataFrame, threshold: float, most_terms: int = MOST_TERMS) -> DataFrame:
    """cls, size, masks, key of the sets (cls, terms and, if there, cell): what a set meets others on.
    Keys of different cells differ.  A set without terms has none."""
    own = side.schema["cls"].dataType
    celled = "cell" in side.columns
    schema = T.StructType([T.StructField("cls", own), T.StructField("size", T.IntegerType()), *(T.StructField(m, T.LongType()) for m in MASKS), T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = KeyPlan(threshold, most_terms)
        for whole in batches:
            sizes = np.diff(whole.column("terms").offsets.to_numpy())
            made = np.array([sum(len(p) for _, p in plan.ways(int(s))) for s in np.unique(sizes)], np.int64)
            upto = np.cumsum(made[np.searchsorted(np.unique(sizes), sizes)]) if len(sizes) else sizes
            ends = [*(np.flatnonzero(np.diff(upto // ROWS_AT_ONCE)) + 1).tolist(), len(sizes)]
            for a, b in zip([0, *ends[:-1]], ends):
                if b == a:
                    continue
                batch = whole.slice(a, b - a)
                sets = batch.column("terms")
                flat, offsets = sets.flatten().to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
                offsets = offsets - offsets[0]
                keys, parent = plan.keys(flat, offsets)
                if celled:
                    keys = mixed(keys + mixed(batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[parent]))
                words = masks(flat, offsets[:-1])
                arrays = [batch.column("cls").take(pa.array(parent)), pa.array(np.diff(offsets)[parent].astype(np.int32)), *(pa.array(w[parent]) for w in words), pa.array(keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    rows = side.where(F.size("terms") > 0).select("cls", "terms", *(["cell"] if celled else []))
    return rows.mapInArrow(run, schema)


def drawn_sets(side: DataFrame, sample: int = SAMPLE) -> list[np.ndarray]:
    """At most `sample` sets of bounded size, drawn by hash, to weigh costs on."""
    rows = side.where(F.size("terms").between(1, SAMPLE_TERMS)).orderBy(F.xxhash64("terms"), "terms").limit(sample).select("terms").collect()
    return [np.array(r[0], np.int64) for r in rows]


def choose_key_terms(left: DataFrame, right: DataFrame, threshold: float) -> int:
    """The most terms of a key at which key rows and candidates together cost least, weighed on
    a bounded sample of either side.  It moves cost only, never a pair."""
    n = [max(side.count(), 1) for side in (left, right)]
    drawn = [drawn_sets(side) for side in (left, right)]
    if not all(drawn):
        return 1
    costs = []
    for m in range(1, MOST_TERMS + 1):
        plan, tables, cost = KeyPlan(threshold, m), [], 0.0
        for sets, whole in zip(drawn, n):
            keys, _ = plan.keys(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
            tables.append(np.unique(keys, return_counts=True))
            cost += KEY_COST * len(keys) * whole / len(sets)
        (lk, lc), (rk, rc) = tables
        _, i, j = np.intersect1d(lk, rk, assume_unique=True, return_indices=True)
        costs.append(cost + float(lc[i] @ rc[j]) * n[0] / len(drawn[0]) * n[1] / len(drawn[1]))
    return 1 + int(np.argmin(costs))


def prefix_pairs(left: DataFrame, right: DataFrame, threshold: float, *, below: bool = False, sets: tuple[DataFrame, DataFrame] | None = None, most_terms: int | None = None) -> DataFrame:
    """l_cls, r_cls, similarity of all pairs of at least `threshold` (above one half) that share their
    cell, if sides have one; a pair of classes may share one cell only.

    Sides have cls, terms (numbers, rarest first) and perhaps cell.  Keys travel with masks instead of
    the sets; candidates that pass them are made distinct, then fetch both sets and are verified.
    `below` keeps l_cls < r_cls only, for a join of a table with itself; `sets` are the sides with one
    row per class, where cells replicate them."""
    if threshold <= 0.5:
        raise ValueError("the threshold must be above one half")
    sets = sets or (left, right)
    most_terms = most_terms or choose_key_terms(*sets, threshold)
    own = ["cls", "size", *MASKS]
    if below:  # pairs are the work, however little room the sets take: not left to the few tasks that hold them
        spark = left.sparkSession
        spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        left = left.repartition(spread, F.xxhash64("cls"))
    l = rare_keys(left, threshold, most_terms).select("key", *(F.col(c).alias(f"l_{c}") for c in own))
    r = rare_keys(right, threshold, most_terms).select("key", *(F.col(c).alias(f"r_{c}") for c in own))
    near = may_be_similar(threshold)
    if below:
        near &= F.col("l_cls") < F.col("r_cls")
    met = l.join(r, "key").where(near).select("l_cls", "r_cls").distinct()
    return verified(met, *sets, threshold)


def shared_terms(l: pa.ListArray, r: pa.ListArray) -> np.ndarray:
    """How many numbers two ascending lists share, row by row: both columns are ascending as a whole
    once the row is put in front of each number."""
    one, other = (np.repeat(np.arange(len(x), dtype=np.int64), np.diff(x.offsets.to_numpy())) << 32 | x.flatten().to_numpy(zero_copy_only=False) for x in (l, r))
    if not len(other):
        return np.zeros(len(l), np.int64)
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    return np.bincount(one[other[at] == one] >> 32, minlength=len(l))


def verified(met: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """l_cls, r_cls, similarity of the candidates that reach the threshold, by their sets (ascending numbers)."""
    l, r = (side.select(F.col("cls").alias(f"{n}_cls"), F.col("terms").alias(f"{n}_terms")) for n, side in zip("lr", (left, right)))
    pairs = met.join(l, "l_cls").join(r, "r_cls").select("l_cls", "r_cls", "l_terms", "r_terms")
    schema = T.StructType([pairs.schema["l_cls"], pairs.schema["r_cls"], T.StructField("similarity", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("l_terms"), batch.column("r_terms")
            shared = shared_terms(x, y)
            similarity = shared / np.maximum(np.diff(x.offsets.to_numpy()) + np.diff(y.offsets.to_numpy()) - shared, 1)
            arrays = [batch.column("l_cls"), batch.column("r_cls"), pa.array(similarity)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names).filter(pa.array(similarity >= threshold - EPS))

    return pairs.mapInArrow(compare, schema)
