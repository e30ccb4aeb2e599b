"""All similar pairs between two tables of sets, exactly, by metric pivot partitioning.

The Jaccard distance is a metric.  Records of the right side are assigned to the nearest of a
bounded set of pivots if it lies within `ring`; a record y of the left side can be within
theta = 1 - threshold of a member of a cell only if d(y, pivot) <= radius of the cell + theta, so
y is replicated to just those cells.  As ring + theta < 1, a pivot that shares no term with y is
never visited, and distances are worked out over an inverted index of the pivots.  Right records
that no pivot is near to form the far cell; no triangle bound can keep any y out of it, so the far
cell is entered by shared rare terms alone (prefix filter), which is exact.

Within a cell, pairs meet on combinations of their rarest terms: of two sets of similarity t or
more, the m rarest shared terms are among the first |x| - ceil(t |x|) + m of either, in any common
order, here rarest first.  Sizes and 256-bit masks of the sets are compared before sets are; both
tests are exact.

Terms are numbered once for both sides, so all but the first shuffle carries integers.  Equal sets
are one class on each side.  `class_pairs` gives pairs of classes, `members` the class of each
record, `similar_pairs` the pairs of records.

Defined results: records without terms, null records and null terms take no part; a term counts
once per record; an empty side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.overlap import EPS, drawn_sets, encoded, prefix_pairs, term_ranks
from pathloom.runtime import cut, keep

PIVOTS = 1024
PIVOT_TERMS = 4096  # only sets of at most so many terms are made pivots
CHUNK = 256  # sets whose distances to all pivots are worked out at once


class Side:
    """A table of sets in numbers: `coded` has rec and terms, `classes` cls, terms and n (its records),
    one row per distinct set."""

    def __init__(self, rows: DataFrame, ranks: DataFrame):
        self.coded = keep(encoded(rows, ranks, "rec"))
        one = self.coded.groupBy("terms").agg(F.count(F.lit(1)).alias("n"))
        self.classes = cut(one.withColumn("cls", F.monotonically_increasing_id()))

    def members(self, wanted: DataFrame) -> DataFrame:
        """rec, cls of the records of the classes in `wanted` (cls, repeats allowed)."""
        some = self.classes.join(wanted.select("cls").distinct(), "cls", "left_semi").select("terms", "cls")
        return self.coded.join(some, "terms").select("rec", "cls")


def coded_sides(*rows: DataFrame, key: Callable[[Column], Column] | None = None) -> list[Side]:
    """Sides of one row per record and value (rec, val), terms numbered alike for all, rarest first;
    values are one term if `key` reads them alike."""
    ranks = term_ranks(*rows, key=key)
    return [Side(r, ranks) for r in rows]


class Pivots:
    """Pivots as an inverted index: distances of sets to all pivots that share a term with them."""

    def __init__(self, sets: list[list[int]]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        terms = np.array([t for s in sets for t in s], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes) if sets else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.owner, self.starts = owner[order], np.append(starts, len(terms))

    def distances(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distance of each set (rows) to each pivot (columns); 1 where they share no term."""
        n, k = len(offsets) - 1, len(self.sizes)
        sizes = np.diff(offsets)
        if not len(self.terms):
            return np.ones((n, k))
        row = np.repeat(np.arange(n), sizes)
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        hit = self.terms[at] == flat
        row, at = row[hit], at[hit]
        many = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(many)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(self.starts[at], many)
        shared = np.bincount(np.repeat(row, many) * k + self.owner[place], minlength=n * k).reshape(n, k)
        return 1 - shared / (self.sizes[None, :] + sizes[:, None] - shared)

    def chunks(self, lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, distances) of a batch of sets, some sets at a time."""
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        for a in range(0, len(lists), CHUNK):
            own = offsets[a : a + CHUNK + 1]
            yield a, self.distances(flat[own[0] : own[-1]], own - own[0])


def choose_pivots(right: DataFrame, most: int = PIVOTS) -> Pivots:
    """At most `most` of the right side's classes, drawn by hash; any choice gives the same pairs."""
    rows = right.where(F.size("terms") <= PIVOT_TERMS).orderBy(F.xxhash64("terms"), "terms").limit(most).select("terms").collect()
    return Pivots([r[0] for r in rows])


def nearest_cell(right: DataFrame, pivots: Pivots, ring: float) -> DataFrame:
    """The right side with cell (-1: far) and its distance from the cell's pivot."""
    schema = T.StructType([*right.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = np.full(batch.num_rows, -1, np.int32), np.ones(batch.num_rows)
            for a, d in pivots.chunks(batch.column("terms")) if len(pivots.sizes) else ():
                k = d.argmin(axis=1)
                least = d[np.arange(len(d)), k]
                cell[a : a + len(d)] = np.where(least <= ring, k, -1)
                dist[a : a + len(d)] = least
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist, mask=cell < 0)], names=[*batch.schema.names, "cell", "d"])

    return right.mapInArrow(assign, schema)


def visited_cells(left: DataFrame, pivots: Pivots, radius: dict[int, float], theta: float) -> DataFrame:
    """The left side once for every cell it may have a partner in, by the triangle inequality, and once for the far cell."""
    schema = T.StructType([*left.schema.fields, T.StructField("cell", T.IntegerType())])
    reach = np.array([radius.get(k, -2.0) + theta + EPS for k in range(len(pivots.sizes))])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, cell = [np.arange(batch.num_rows)], [np.full(batch.num_rows, -1)]
            for a, d in pivots.chunks(batch.column("terms")) if radius else ():
                row, k = np.nonzero(d <= reach)  # reach is below 1: pivots that share no term are not visited
                parent.append(row + a)
                cell.append(k)
            at = pa.array(np.concatenate(parent))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(np.concatenate(cell).astype(np.int32))], names=[*batch.schema.names, "cell"])

    return left.mapInArrow(visit, schema)


def fit_ring(left: DataFrame, pivots: Pivots, ring: float, theta: float) -> float:
    """The widest ring, up to the given one, at which a left record visits no more than one cell on
    average besides the far one, were all cells as wide as their ring; by a bounded sample.  Any ring
    gives the same pairs: a wide one leaves fewer records in the far cell, a narrow one copies fewer
    records of the left side."""
    drawn = drawn_sets(left)
    if not len(pivots.sizes) or not drawn:
        return ring
    d = np.sort(np.concatenate([d for _, d in pivots.chunks(pa.array(drawn, pa.list_(pa.int32())))]), axis=None)
    wide = float(d[len(drawn)]) - theta if len(drawn) < len(d) else ring  # beyond it, one visit a record is exceeded
    return max(0.0, min(ring, wide - EPS))


def class_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8, *, pivots: int = PIVOTS, ring: float = 0.5) -> DataFrame:
    """l_cls, r_cls, similarity of all pairs of classes (cls, terms in common numbers) of at least `threshold`."""
    theta = 1 - threshold
    if ring + theta >= 1:
        raise ValueError("ring + (1 - threshold) must stay below 1, or disjoint pivots could not be ruled out")
    left, right = left.select("cls", "terms"), right.select("cls", "terms")
    chosen = choose_pivots(right, pivots)
    assigned = keep(nearest_cell(right, chosen, fit_ring(left, chosen, ring, theta)))
    found = assigned.where("cell >= 0").groupBy("cell").agg(F.max("d").alias("radius")).collect()  # at most one row per pivot
    radius = {r["cell"]: r["radius"] for r in found}
    return prefix_pairs(visited_cells(left, chosen, radius, theta), assigned, threshold, sets=(left, right))


def record_pairs(left: Side, right: Side, threshold: float = 0.8, **options) -> DataFrame:
    """l_rec, r_rec, similarity of the records of two sides."""
    pairs = keep(class_pairs(left.classes, right.classes, threshold, **options))  # read for both sides' members and for the pairs
    l = left.members(pairs.select(F.col("l_cls").alias("cls"))).select(F.col("cls").alias("l_cls"), F.col("rec").alias("l_rec"))
    r = right.members(pairs.select(F.col("r_cls").alias("cls"))).select(F.col("cls").alias("r_cls"), F.col("rec").alias("r_rec"))
    return pairs.join(l, "l_cls").join(r, "r_cls").select("l_rec", "r_rec", "similarity")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """l_rec, r_rec, similarity of the records of two tables of sets (rec, terms)."""
    rows = (side.select("rec", F.explode("terms").alias("val")) for side in (left, right))
    return record_pairs(*coded_sides(*rows), threshold, **options)
