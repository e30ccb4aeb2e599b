"""Session-level helpers: cutting lineage, size checks, distributed ranks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

BROADCAST_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only where none is set (tests), a local one."""
    jsc = spark.sparkContext._jsc.sc()
    now = jsc.getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = "file://" + os.path.join(tempfile.gettempdir(), "pathloom-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, so that no other run's files are met."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder and forget how it was made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Cache what two branches of one plan read; lost blocks are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that must stay small; a larger one is refused rather than collected."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise the bound or split it")
    return rows


def small_or_joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts the right side only if a count shows at most so many rows, else shuffles."""
    if right.limit(most + 1).count() <= most:
        right = F.broadcast(right)
    return left.join(right, on, how)


def split_group_rank(df: DataFrame, group: list[str], order: list, spread: str, pieces: int, name: str = "rank", weight=None) -> DataFrame:
    """Position (from 0) of each row in its group, or the running sum of `weight` before it, without
    bringing a group into one task: rows are ranked within `pieces` parts of the group (by the
    integer column `spread`, whose order must go with `order` if order matters across parts) and
    the parts' totals, a table of groups x pieces rows, give each part its offset."""
    part = F.col(spread)
    one = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    inner = Window.partitionBy(*group, spread).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_before", F.coalesce(F.sum(one).over(inner), F.lit(0)))
    totals = df.groupBy(*group, part.alias(spread)).agg(F.sum(one).alias("_n"))
    outer = Window.partitionBy(*group).orderBy(spread).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(outer), F.lit(0))).drop("_n")
    keys = [*group, spread]
    l, r = local.alias("l"), offsets.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return l.join(r, on).select("l.*", (F.col("l._before") + F.col("r._offset")).alias(name)).drop("_before")
