"""Skill taxonomy: document frequencies, identifiers, categories; canonical names over clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.skills import categorize, normalize_skill


def doc_skills(docs: DataFrame, doc: str, skills: str) -> DataFrame:
    """doc, skill: the distinct normalized skills of each document (`skills`: array of strings)."""
    return docs.select(doc, F.explode(skills).alias("_s")).select(doc, normalize_skill("_s").alias("skill")).where("skill <> ''").distinct()


def doc_frequency(pairs: DataFrame, skill: str = "skill") -> DataFrame:
    """skill, doc_frequency of distinct (document, skill) pairs."""
    return pairs.groupBy(skill).agg(F.count(F.lit(1)).alias("doc_frequency"))


def dense_rank_ids(df: DataFrame, order: list, name: str) -> DataFrame:
    """Running number from 0 in the given total order, without a one-task window: rows are range-sorted,
    numbered within their partition, and each partition is moved on by the sizes before it."""
    ranked = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()})
    ranked = ranked.withColumn("_at", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))).persist()
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_mono", "_at", "_before")


def taxonomy(docs: DataFrame, doc: str, skills: str) -> DataFrame:
    """skill_id, skill, doc_frequency; ids run from skill_0000 by falling frequency, then by name.
    No documents give an empty table with these columns."""
    freq = doc_frequency(doc_skills(docs, doc, skills))
    ranked = dense_rank_ids(freq, [F.desc("doc_frequency"), "skill"], "_rank")
    return ranked.select(F.format_string("skill_%04d", F.col("_rank")).alias("skill_id"), "skill", "doc_frequency")


def categorized(tax: DataFrame) -> DataFrame:
    return tax.withColumn("category", categorize("skill"))


def canonical_names(clusters: DataFrame, freqs: DataFrame) -> DataFrame:
    """cluster_id, canonical_name: the most frequent variant, then the shortest, then the first by name.

    clusters: cluster_id, variant; freqs: skill, doc_frequency (absent: 0)."""
    rows = _with_freq(clusters, freqs)
    return rows.groupBy("cluster_id").agg(_best().alias("canonical_name"))


def _best():
    return F.min_by("variant", F.struct(-F.col("freq"), F.length("variant"), F.col("variant")))


def _with_freq(clusters: DataFrame, freqs: DataFrame) -> DataFrame:
    f = freqs.select(F.col("skill").alias("variant"), F.col("doc_frequency").alias("freq"))
    return clusters.join(f, "variant", "left").fillna(0, ["freq"])


def canonical_taxonomy(clusters: DataFrame, freqs: DataFrame, *, min_doc_freq: int = 5) -> DataFrame:
    """canonical_skill_id, canonical_name, doc_frequency (summed), variants (sorted), of clusters frequent enough."""
    rows = _with_freq(clusters, freqs)
    out = rows.groupBy("cluster_id").agg(_best().alias("canonical_name"), F.sum("freq").alias("doc_frequency"), F.array_sort(F.collect_list("variant")).alias("variants"))
    return out.where(F.col("doc_frequency") >= min_doc_freq).select(F.col("cluster_id").alias("canonical_skill_id"), "canonical_name", "doc_frequency", "variants")


def remap(docs: DataFrame, doc: str, skills: str, mapping: DataFrame, valid: DataFrame) -> DataFrame:
    """doc, canonical_skills: raw skills looked up exactly (case matters), valid ones kept, each once, in order.

    mapping: variant, canonical_name; valid: canonical_name.  Both are broadcast by size (AQE)."""
    rows = docs.select(doc, F.posexplode(skills).alias("pos", "variant"))
    hit = rows.join(mapping.select("variant", "canonical_name"), "variant").join(valid.select("canonical_name").distinct(), "canonical_name", "left_semi")
    kept = hit.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "canonical_name"))).alias("_l"))
    out = docs.select(doc).distinct().join(kept, doc, "left")
    names = F.array_distinct(F.coalesce(F.col("_l.canonical_name"), F.array().cast("array<string>")))
    return out.select(doc, names.alias("canonical_skills"))


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """key, skills: the cache with new keys added; a key that is there keeps its value."""
    return cache.unionByName(new.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))
