"""Grouping records into similarity clusters.

MinHash banding over distinct sets gives candidate pairs, exact Jaccard verifies them, connected
components form groups, and loose groups (whose members are not all similar to one of them) are
split around medoids, highest degree first.  Clusters are described by size and most typical members.

Equal sets are one class, so copies never meet in a bucket.  A bucket of at most `bucket_cap`
classes is joined with itself, behind an exact test on sizes and 256-bit masks of the sets; classes of a larger bucket take part in one exact prefix-filter
join instead, so no pair is lost to the cap and none is made quadratically.

Defined results: records without terms belong to no group; a record that is similar to no other
is a group of its own; ties of degree go to the smaller record; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.components import connected_groups
from pathloom.operators.overlap import EPS, MASKS, encoded, masks, may_be_similar, mixed, prefix_pairs, term_ranks, verified
from pathloom.runtime import cut, keep

BANDS, ROWS = 28, 8  # at a similarity of 0.8 a pair meets in some band with probability 0.994
BUCKET_CAP = 4096
STATIC_ROUNDS = 16


def numbered_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, terms, n, first) with cls a number per distinct set, n its records and first the smallest
    of them; and (rec, cls)."""
    one = sets.groupBy("terms").agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("first"))
    one = cut(one.withColumn("cls", F.monotonically_increasing_id()))
    return one, cut(sets.join(one.select("terms", "cls"), "terms").select("rec", "cls"))


def band_keys(one: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """cls, size, masks, key of every class, a key for every band; keys of different bands differ."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    mix = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
    fields = f"cls bigint, size int, {', '.join(f'{m} bigint' for m in MASKS)}, key bigint"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for big in batches:
            for a in range(0, big.num_rows, 1024):
                batch = big.slice(a, 1024)
                sets = batch.column("terms")
                offsets = sets.offsets.to_numpy()
                flat, n = sets.flatten().to_numpy(zero_copy_only=False), len(sets)
                begins = offsets[:-1] - offsets[0]
                words = masks(flat, begins)
                h = mixed(flat.astype(np.uint64) + np.uint64(1))
                low = np.empty((n, bands * rows), np.uint64)
                for k in range(bands * rows):
                    low[:, k] = np.minimum.reduceat((h * mult[k] + add[k]) >> np.uint64(16), begins)
                keys = mixed((low.reshape(n, bands, rows) * mix).sum(axis=2, dtype=np.uint64) + band).view(np.int64)
                at = np.repeat(np.arange(n), bands)
                size = np.diff(offsets).astype(np.int32)
                rows_ = [batch.column("cls").take(pa.array(at)), pa.array(size[at]), *(pa.array(m[at]) for m in words), pa.array(keys.reshape(-1))]
                yield pa.RecordBatch.from_arrays(rows_, names=["cls", "size", *MASKS, "key"])

    return one.select("cls", "terms").mapInArrow(sign, T.StructType.fromDDL(fields))


def similar_class_pairs(one: DataFrame, threshold: float = 0.8, *, bands: int = BANDS, rows: int = ROWS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """l, r, similarity: verified pairs of classes (cls, terms in numbers), l < r."""
    keyed = band_keys(one, bands, rows)
    # keys of crowded buckets: each holds over `bucket_cap` rows, so they are few beside the rows
    crowded = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > bucket_cap).select("key"))
    some = not crowded.isEmpty()
    fair = keyed.join(crowded, "key", "left_anti") if some else keyed
    own = ["cls", "size", *MASKS]
    l = fair.select("key", *(F.col(c).alias(f"l_{c}") for c in own))
    r = fair.select("key", *(F.col(c).alias(f"r_{c}") for c in own))
    met = l.join(r, "key").where("l_cls < r_cls").where(may_be_similar(threshold)).select("l_cls", "r_cls").distinct()
    sets = one.select("cls", "terms")
    pairs = verified(met, sets, sets, threshold).toDF("l", "r", "similarity")
    if not some:
        return pairs
    rest = cut(sets.join(keyed.join(crowded, "key", "left_semi").select("cls").distinct(), "cls", "left_semi"))
    exact = prefix_pairs(rest, rest, threshold, below=True).toDF("l", "r", "similarity")
    return pairs.unionAll(exact).groupBy("l", "r").agg(F.max("similarity").alias("similarity"))


def medoid_split(pairs: DataFrame) -> DataFrame:
    """v, medoid, similarity for every vertex that has a pair.

    Vertices rank by degree, then by the smaller number.  A vertex that outranks all its remaining
    neighbours is a medoid; its neighbours join the best medoid next to them; the rest go on.  This
    is what picking the best remaining vertex one at a time would give.  A long chain of ever
    better neighbours is broken after some rounds by ranking what is left by hash."""
    both = pairs.select(F.col("l").alias("v"), F.col("r").alias("w"), "similarity")
    both = both.unionAll(pairs.select(F.col("r").alias("v"), F.col("l").alias("w"), "similarity"))
    degree = both.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
    both = both.join(degree, "v").join(degree.select(F.col("v").alias("w"), F.col("deg").alias("wdeg")), "w")
    edges = cut(both.select("v", "w", "similarity", "deg", "wdeg"))
    out, rounds = None, 0
    while not edges.isEmpty():
        by_hash = rounds >= STATIC_ROUNDS
        own = F.struct((F.xxhash64("v") if by_hash else F.col("deg")).alias("p"), (-F.col("v")).alias("q"))
        other = F.struct((F.xxhash64("w") if by_hash else F.col("wdeg")).alias("p"), (-F.col("w")).alias("q"))
        top = edges.groupBy("v").agg(F.max(other).alias("best"), F.max(own).alias("own"))
        heads = cut(top.where("own > best").select("v", "own"))
        near = edges.join(heads.select(F.col("v").alias("w"), F.col("own").alias("head")), "w")
        joined = near.groupBy("v").agg(F.max(F.struct("head", F.col("w").alias("medoid"), "similarity")).alias("x"))
        done = joined.select("v", "x.medoid", "x.similarity").unionAll(heads.select("v", F.col("v").alias("medoid"), F.lit(1.0).alias("similarity")))
        done = cut(done)
        out = done if out is None else out.unionAll(done)
        left = edges.join(done.select("v"), "v", "left_anti")
        lone = left.select("v").distinct()  # remaining vertices; those whose neighbours have all gone stand alone
        edges_next = cut(left.join(done.select(F.col("v").alias("w")), "w", "left_anti"))
        alone = lone.join(edges_next.select("v").distinct(), "v", "left_anti")
        out = out.unionAll(cut(alone.select("v", F.col("v").alias("medoid"), F.lit(1.0).alias("similarity"))))
        edges, rounds = edges_next, rounds + 1
    if out is None:
        return edges.select("v", F.col("w").alias("medoid"), "similarity")
    return out


def value_groups(values: DataFrame, threshold: float = 0.8, *, key: Callable[[Column], Column] | None = None, **options) -> dict[str, DataFrame]:
    """Groups of the records of `values` (rec, val); values are one term if `key` reads them alike.

    `records`: rec, cls, group, component, medoid (a cls), similarity (to the group's medoid), n_terms;
    `classes`: cls, terms, n, first; `sets`: rec, terms; `ranks`: val, r, the numbers of the terms.

    `group` is the smallest record that has the medoid's set, `component` the number of the component
    before it was split (null for a set that is similar to no other)."""
    ranks = term_ranks(values, key=key)
    sets = keep(encoded(values, ranks, "rec"))
    one, records = numbered_classes(sets)
    pairs = cut(similar_class_pairs(one, threshold, **options))
    whole = connected_groups(pairs, "l", "r").select(F.col("vertex").cast("bigint").alias("v"), F.col("group").alias("component"))
    split = medoid_split(pairs)
    placed = one.select("cls", F.size("terms").alias("n_terms")).join(split.withColumnRenamed("v", "cls"), "cls", "left").join(whole.withColumnRenamed("v", "cls"), "cls", "left")
    placed = placed.select("cls", "n_terms", "component", F.coalesce("medoid", "cls").alias("medoid"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    named = cut(placed.join(one.select(F.col("cls").alias("medoid"), F.col("first").alias("group")), "medoid"))
    return {"records": records.join(named, "cls"), "classes": one, "sets": sets, "ranks": ranks}


def similar_groups(terms: DataFrame, record: str, term: str, threshold: float = 0.8, **options) -> dict[str, DataFrame]:
    """Groups of records given by one row per record and term (see value_groups)."""
    return value_groups(terms.select(F.col(record).alias("rec"), F.col(term).alias("val")), threshold, **options)


def describe_groups(records: DataFrame, typical: int = 3) -> DataFrame:
    """group, n_records, n_sets, components, typical: the members most similar to the medoid, joined by commas."""
    best = Window.partitionBy("group").orderBy(F.desc("similarity"), "rec")  # Spark limits each group before the shuffle
    top = records.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= typical)
    top = top.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "rec"))), lambda x: x["rec"]), ",").alias("typical"))
    size = records.groupBy("group").agg(F.count(F.lit(1)).alias("n_records"), F.avg("similarity").alias("mean_similarity"))
    return size.join(top, "group")


def typical_of_sets(labelled: DataFrame, sets: DataFrame, *, label: str, share: float = 0.1) -> DataFrame:
    """label, term: terms that at least `share` of the records labelled so hold.

    labelled: rec, label (one row per record); sets: rec, terms."""
    labelled, sets = labelled.select("rec", label), sets.select("rec", "terms")
    n = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    held = sets.join(labelled, "rec").select(label, F.explode("terms").alias("term")).groupBy(label, "term").agg(F.count(F.lit(1)).alias("_k"))
    return held.join(n, label).where(F.col("_k") >= share * F.col("_n") - EPS).select(label, "term")


def _held(classes: DataFrame, typical: DataFrame) -> DataFrame:
    """cls, held: how many typical terms of each label a set holds, labels without one left out."""
    rows = classes.select("cls", F.explode("terms").alias("r")).join(typical, "r")
    return rows.groupBy("cls", "_label").agg(F.count(F.lit(1)).alias("k")).groupBy("cls").agg(F.collect_list(F.struct("_label", "k")).alias("held"))  # one entry per label


def _margin(label: str):
    """By how many typical terms the best other label beats a record's own; 0 where it holds none."""
    held = F.coalesce("held", F.array().cast("array<struct<_label:string,k:bigint>>"))
    own = F.aggregate(held, F.lit(0).cast("bigint"), lambda s, x: F.when(x["_label"] == F.col(label).cast("string"), x["k"]).otherwise(s))
    other = F.aggregate(held, F.lit(0).cast("bigint"), lambda s, x: F.when(x["_label"] != F.col(label).cast("string"), F.greatest(s, x["k"])).otherwise(s))
    return other - own


def misplaced(groups: dict[str, DataFrame], labelled: DataFrame, typical: DataFrame, *, label: str) -> DataFrame:
    """Records of the clusters that hold more typical terms of another label than of their own; `typical`
    has label and term, in the groups' numbers.

    A cluster is judged by its medoid, once per label: a margin between two labels differs between
    two sets by no more than the terms in which they differ, |x| + |y| - 2 |x and y|, which size and similarity
    tell.  Members whose medoid's margin is wider than that are settled with it; the sets of the others
    are counted themselves.  Records without a label or a set are left out."""
    labelled = labelled.select("rec", label).where(F.col(label).isNotNull())
    typical = typical.select(F.col("term").alias("r"), F.col(label).cast("string").alias("_label"))
    typical = keep(typical)  # a term is typical of few labels, a label has few typical terms
    own = groups["records"].select("rec", "cls", "group", "medoid", "similarity", "n_terms")
    heads = own.select(F.col("medoid").alias("cls")).distinct()
    sizes = groups["classes"].select(F.col("cls").alias("medoid"), F.size("terms").alias("_size"))
    judged = _held(groups["classes"].join(heads, "cls", "left_semi"), typical).withColumnRenamed("cls", "medoid")
    rows = own.join(labelled, "rec").join(sizes, "medoid").join(judged, "medoid", "left")
    differ = F.round((F.col("n_terms") + F.col("_size")) * (1 - F.col("similarity")) / (1 + F.col("similarity"))).cast("bigint")
    rows = rows.select("rec", "cls", "group", label, _margin(label).alias("_margin"), differ.alias("_differ"))
    rows = keep(rows.where(F.col("_margin") + F.col("_differ") > 0))  # the others are where they belong
    sure = rows.where(F.col("_margin") > F.col("_differ")).select("rec", "group", label)
    doubt = rows.where(F.col("_margin") <= F.col("_differ")).select("rec", "cls", "group", label)
    counted = _held(groups["classes"].join(doubt.select("cls").distinct(), "cls", "left_semi"), typical)
    return sure.unionByName(doubt.join(counted, "cls").where(_margin(label) > 0).select("rec", "group", label))
