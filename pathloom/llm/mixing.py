"""Mixing sources to target weights.

A low-discrepancy schedule deals slots to sources: the k-th point of the golden-ratio sequence,
mapped through the cumulative weights, names the source of slot k, so every stretch of the mix has
the target shares.  Each source's records, shuffled by hash, are cut into blocks of equal tokens (a record
belongs to the block of its middle); the j-th slot of a source takes its block j modulo the number of blocks.  The size of the mix is
the largest at which no source needs a record more often than its cap allows.

Defined results: records whose source has no target (or none at all) are not used; a target whose
source has no tokens gets nothing and the other shares are scaled up in proportion; records of no
tokens go with the block they fall into; an empty table gives no rows; null shares and caps
count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.runtime import bounded_rows, cut, split_group_rank

GOLDEN = 0.6180339887498949
SLOTS = 65_536
PIECES = 256
MAX_SOURCES = 1000


def mix_sources(records: DataFrame, targets: DataFrame, *, item: str = "item", source: str = "source", size: str = "size", slots: int = SLOTS, seed: int = 1) -> DataFrame:
    """item, source, size, repeats, first_slot, reached_share, target_share of the records used.

    targets: source, target_share, max_repeats (at most MAX_SOURCES rows).  Neither records nor slots of
    a source are brought together: running sums and ranks are made in parts."""
    want = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in bounded_rows(targets.select("source", "target_share", "max_repeats"), MAX_SOURCES, "the targets") if r["source"] is not None}
    rows = records.select(F.col(item).alias("item"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    rows = cut(rows.where(F.col("source").isin([s for s, (w, m) in want.items() if w > 0 and m > 0])))
    have = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect() if r["n"]}  # one row per target
    spark = records.sparkSession
    if not have:
        return rows.select("item", "source", "size", F.lit(0).cast("bigint").alias("repeats"), F.lit(0).cast("bigint").alias("first_slot"), F.lit(0.0).alias("reached_share"), F.lit(0.0).alias("target_share")).where("false")
    scale = sum(want[s][0] for s in have)
    total = min(want[s][1] * n * scale / want[s][0] for s, n in have.items())
    block = max(1, int(total // slots))
    blocks = {s: -(-n // block) for s, n in have.items()}

    k = F.col("id")
    point = F.pmod((k + F.lit(0.5)) * F.lit(GOLDEN), F.lit(1.0))
    names, edge, pick = sorted(have), 0.0, None
    for s in names[:-1]:
        edge += want[s][0] / scale
        pick = F.when(point < edge, F.lit(s)) if pick is None else pick.when(point < edge, F.lit(s))
    pick = F.lit(names[-1]) if pick is None else pick.otherwise(F.lit(names[-1]))
    number = max(1, int(total // block))
    schedule = spark.range(number).select(k.alias("slot"), pick.alias("source"), F.floor(k * PIECES / number).cast("int").alias("_part"))
    schedule = split_group_rank(schedule, ["source"], ["slot"], "_part", PIECES, "rank")
    n_blocks = _lookup(blocks)
    schedule = schedule.withColumn("_n", n_blocks).where(F.col("rank") < F.col("_n") * _lookup({s: want[s][1] for s in have}))
    dealt = schedule.groupBy("source", F.pmod("rank", "_n").alias("block")).agg(F.count(F.lit(1)).alias("repeats"), F.min("slot").alias("first_slot"))

    key = F.xxhash64("item", F.lit(seed))
    shuffled = rows.withColumns({"_key": key, "_part": F.pmod(key, F.lit(PIECES)).cast("int")})
    placed = split_group_rank(shuffled, ["source"], ["_key", "item"], "_part", PIECES, "_at", weight=F.col("size"))
    placed = placed.withColumn("block", F.least(F.floor((F.col("_at") + F.col("size") / 2) / block), _lookup(blocks) - 1).cast("bigint"))
    used = cut(placed.join(dealt, ["source", "block"]).select("item", "source", "size", "repeats", "first_slot"))
    reached = {r["source"]: r["n"] for r in used.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("n")).collect()}
    whole = sum(reached.values()) or 1
    return used.withColumns({"reached_share": _lookup({s: n / whole for s, n in reached.items()}), "target_share": _lookup({s: want[s][0] for s in reached})})


def _lookup(values: dict):
    """The value of the row's source; a dictionary of at most MAX_SOURCES entries."""
    if not values:
        return F.lit(None).cast("double")
    return F.create_map(*(F.lit(x) for s, v in values.items() for x in (s, v)))[F.col("source")]


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, reached_share, n_records, tokens, most_repeats for every target."""
    by = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col("size") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    whole = by.agg(F.sum("tokens").alias("_all"))
    out = targets.select("source", "target_share").join(by, "source", "left").crossJoin(F.broadcast(whole))  # one row
    zero = F.lit(0).cast("bigint")
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"), F.coalesce("n_records", zero).alias("n_records"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("most_repeats", zero).alias("most_repeats"))
