"""Filling fixed-capacity containers with items.

Lengths are counted in units of capacity / `window` (rounded up, so a container never overflows),
which bounds the histogram by the window whatever the number of items.  All combinations of at
most three lengths that fill the window exactly are enumerated; non-negative least squares, run until
it is shown to be settled, finds how often each should be used to use up the histogram; the counts are
rounded down to what is there, and what remains is packed greedily, largest lengths first, whole
patterns at a time.  All of this happens on the histogram.  Items then get their rank within their
length and look up the container that the plan gives to that rank, so no task holds a length's items
and none are collected.

Defined results: an item larger than the capacity is cut into pieces of the capacity and a rest;
no other item is cut; an item of no size takes one unit; an empty table gives no rows; items of
equal length are ranked by their identifier; a repeated row is an item of its own; other columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.runtime import split_group_rank

WINDOW = 4096
CLOSE = 1e-4  # how far least squares may stay above its minimum, as a share of what it has where nothing is used
PIECES = 64


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths a >= b >= c, zeros for none, that are present and sum to the window."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    have[0] = True
    lengths = np.flatnonzero(have)
    out = []
    for a in lengths[lengths * 3 >= window]:  # the longest of three fills a third at least
        b = lengths[(lengths <= a) & (lengths <= window - a) & (2 * lengths >= window - a)]
        c = window - a - b
        ok = have[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, 3), np.int32)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative x that brings sum(x * combination) close to the histogram: accelerated projected
    gradient, with a step for each combination.  Left-over long items cost more than short ones, as they
    are harder to place.  It ends where a lower bound of the minimum shows that x is within CLOSE of it,
    however many combinations there are and however many rounds that takes."""
    size = len(histogram)
    if not len(combos):
        return np.zeros(0)
    share = np.arange(size) / (size - 1)
    weight = (share + 0.05) ** 2
    weight[0] = 0.0
    columns = [np.ascontiguousarray(combos[:, k], dtype=np.intp) for k in range(3)]

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, x, minlength=size) for c in columns)

    def back(r: np.ndarray) -> np.ndarray:
        return r[columns[0]] + r[columns[1]] + r[columns[2]]

    target = histogram.astype(float)
    target[0] = 0
    unused = weight @ target**2 / 2
    step = 1 / back(weight * used(np.ones(len(combos))))  # row sums of a non-negative matrix bound it from above

    def settled(x: np.ndarray) -> bool:
        left = target - used(x)
        # any price with no combination above 0 bounds the minimum; the shares of a combination sum to 1
        price = weight * left
        price = price - max(back(price).max(), 0.0) * share
        bound = price @ target - (price[1:] ** 2 / weight[1:]).sum() / 2
        return weight @ left**2 / 2 - bound <= CLOSE * unused

    x = y = np.zeros(len(combos))
    t, done = 1.0, 0
    while done % 10 or not settled(x):  # looking costs a round, so every tenth
        slope = back(weight * (used(y) - target))
        nxt = np.maximum(y - step * slope, 0)
        if slope @ (nxt - x) > 0:  # uphill: begin the acceleration anew
            t = 1.0
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t, done = nxt, t_next, done + 1
    return x


def pack_plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how many) with their numbers of containers; together they use every item.

    histogram[u] is the number of items of u units, u from 1 to the window."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    window = len(left) - 1
    plan: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], most: int) -> int:
        n = min([most, *(int(left[u]) // m for u, m in pattern.items())])
        if n > 0:
            for u, m in pattern.items():
                left[u] -= n * m
            plan.append((pattern, n))
        return n

    combos = combinations(np.flatnonzero(left), window)
    x = repeat_counts(combos, left)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        lengths, many = np.unique(combos[k][combos[k] > 0], return_counts=True)
        take(dict(zip(lengths.tolist(), many.tolist())), int(np.floor(x[k] + 0.5)))
    while left.any():  # residuals: the longest first, then whatever longest still fits
        pattern: dict[int, int] = {}
        room = window
        while room > 0:
            fits = np.flatnonzero(left[: room + 1])
            fits = [u for u in fits[::-1][:64] if left[u] > pattern.get(int(u), 0)] or [u for u in fits[::-1] if left[u] > pattern.get(int(u), 0)]
            if not len(fits):
                break
            u = int(fits[0])
            many = min(room // u, int(left[u]) - pattern.get(u, 0))
            pattern[u] = pattern.get(u, 0) + many
            room -= many * u
        take(pattern, int(left.sum()))
    return plan


def pack_items(items: DataFrame, capacity: int, *, item: str = "item", size: str = "size", window: int = WINDOW, pieces: int = PIECES) -> DataFrame:
    """pack_id, item, piece (from 0), start, n: the container of each item or piece."""
    unit = max(1, -(-capacity // window))
    units = capacity // unit
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int")
    cut_up = items.select(F.col(item).alias("item"), n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    cut_up = cut_up.select("item", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("n"))
    # units are rounded up; a full piece takes the whole window even where units do not divide the capacity
    u = F.least(F.greatest(F.ceil(F.col("n") / unit), F.lit(1)), F.lit(units)).cast("int")
    cut_up = cut_up.withColumns({"u": u, "_part": F.pmod(F.xxhash64("item", "piece"), F.lit(pieces)).cast("int")})
    histogram = np.zeros(units + 1, np.int64)
    for r in cut_up.groupBy("u").count().collect():  # at most `window` rows
        histogram[r["u"]] = r["count"]
    plan = pack_plan(histogram)
    base, first = 0, {}
    slots: dict[int, list[tuple[int, int, int]]] = {}  # length -> (first rank, items a container, first container)
    for pattern, many in plan:
        for length, m in pattern.items():
            at = first.get(length, 0)
            slots.setdefault(length, []).append((at, m, base))
            first[length] = at + m * many
        base += many
    table = {k: np.array(v, np.int64) for k, v in slots.items()}
    ranked = split_group_rank(cut_up, ["u"], ["item", "piece"], "_part", pieces, "rank")
    schema = T.StructType([T.StructField("pack_id", T.LongType()), *(cut_up.schema[c] for c in ("item", "piece", "start", "n"))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("u").to_numpy()
            ranks = batch.column("rank").to_numpy()
            pack = np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                t = table[int(length)]
                k = np.searchsorted(t[:, 0], ranks[own], side="right") - 1
                pack[own] = t[k, 2] + (ranks[own] - t[k, 0]) // t[k, 1]
            yield pa.RecordBatch.from_arrays([pa.array(pack), *(batch.column(c) for c in ("item", "piece", "start", "n"))], names=schema.names)

    return ranked.select("item", "piece", "start", "n", "u", "rank").mapInArrow(place, schema)
