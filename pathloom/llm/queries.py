"""The queries pN_... of the llm operators over the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.strings import match_key, record_code
from pathloom.llm import bitmaps, components, distinctive, groups, mapping, mixing, packing, screening, setjoin
from pathloom.llm.tokens import with_token_counts
from pathloom.plans.course_tables import listed_names, packed_values
from pathloom.runtime import bounded_rows, cut, keep
from pathloom.sources.tables import table


def _skills(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """rec, term: the distinct skills of each record, as compared."""
    values = packed_values(spark, folder, name).where("rec is not null")
    # one shuffle by record serves distinct(), term frequencies, lengths and sets alike
    return values.select("rec", match_key("val").alias("term")).repartition("rec").distinct()


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "courses_canonical").select(record_code("code").alias("rec")).where("rec is not null").distinct()


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.distinctive_terms(_skills(spark, folder, "courses_canonical"), _catalogue(spark, folder))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """term, canonical_name, stored_doc_freq: one row per listed skill."""
    rows = table(spark, folder, "skills_canonical").where("canonical_name is not null")
    return rows.groupBy(match_key("canonical_name").alias("term")).agg(F.min("canonical_name").alias("canonical_name"), F.max("doc_frequency").alias("stored_doc_freq"))


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """code, skill, doc_freq, stored_doc_freq, score of every skill of every course."""
    scored = _scored(spark, folder).join(_listed(spark, folder), "term", "left")
    return scored.select(F.col("rec").alias("code"), F.coalesce("canonical_name", "term").alias("skill"), "doc_freq", "stored_doc_freq", F.round("score", 6).alias("score"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    sole = distinctive.sole_markers(_scored(spark, folder)).join(_listed(spark, folder), "term", "left")
    return sole.select(F.col("rec").alias("code"), F.coalesce("canonical_name", "term").alias("skill"))


def _taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "skill_taxonomy").select("skill_id", match_key("skill").alias("skill"), "doc_frequency").where("skill <> ''")
    rows = rows.groupBy("skill_id", "skill").agg(F.max(F.coalesce("doc_frequency", F.lit(0))).alias("doc_frequency"))  # repeated rows
    return bitmaps.with_bands(bitmaps.term_frequencies(rows, record="skill_id", term="skill", weight="doc_frequency"))


def p2_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """skill, n_rows, total, band of every distinct skill."""
    return _taxonomy(spark, folder).select(F.col("term").alias("skill"), F.col("doc_freq").alias("n_rows"), F.col("weight").cast("bigint").alias("total"), "band")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _taxonomy(spark, folder).where("band <> 'usable'").select(F.col("term").alias("skill"), "band")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """id, name, aliases of the listed skills."""
    rows = table(spark, folder, "skills_canonical").where("canonical_skill_id is not null and canonical_name is not null")
    names = rows.groupBy(F.col("canonical_skill_id").alias("id")).agg(F.min("canonical_name").alias("name"))
    aliases = packed_values(spark, folder, "skills_canonical").groupBy(F.col("rec").cast("int").alias("id")).agg(F.collect_set("val").alias("aliases"))
    return names.join(aliases, "id", "left")


def p3_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """code, pos, raw_skill, canonical_skill_id (-1: none), how of every value."""
    names = listed_names(spark, folder)
    rows = mapping.mapped(packed_values(spark, folder, "courses_skills", names), _entries(spark, folder))
    return rows.select(F.col("rec").alias("code"), "pos", F.col("val").alias("raw_skill"), F.col("entry_id").alias("canonical_skill_id"), "how")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    values = packed_values(spark, folder, "courses_skills")
    known = table(spark, folder, "skills_canonical").select(F.col("canonical_name").alias("val")).distinct()
    other = values.select("rec", "val").distinct().join(known, "val", "left_anti")
    rows = mapping.mapped(other, _entries(spark, folder))
    return rows.select(F.col("rec").alias("code"), F.col("val").alias("raw_skill"), F.col("entry_id").alias("canonical_skill_id"))


def _sides(spark: SparkSession, folder: str) -> list[setjoin.Side]:
    """The postings and the courses that have skills, as sets."""
    names = listed_names(spark, folder)
    rows = (packed_values(spark, folder, name, names, repeats=True) for name in ("jobs_canonical", "courses_canonical"))
    return setjoin.coded_sides(*rows, key=match_key)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.record_pairs(*_sides(spark, folder), 0.8).select(F.col("l_rec").alias("job_id"), F.col("r_rec").alias("code"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Postings and courses that share at least 60 % of their skills, as classes of equal sets: job_id
    and code are the smallest of their class, with the sizes of both classes and the agreement.
    p4_members has all members of the classes."""
    jobs, courses = _sides(spark, folder)
    pairs = keep(setjoin.class_pairs(jobs.classes, courses.classes, 0.6))
    out = pairs
    for side, cls, rec, n in ((jobs, "l_cls", "job_id", "n_jobs"), (courses, "r_cls", "code", "n_courses")):
        rows = side.members(pairs.select(F.col(cls).alias("cls")))
        out = out.join(rows.groupBy(F.col("cls").alias(cls)).agg(F.min("rec").alias(rec), F.count(F.lit(1)).alias(n)), cls)
    return out.select("job_id", "code", "n_jobs", "n_courses", F.round("similarity", 6).alias("agreement"))


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """side (job or course), rec, first of every posting and course with skills: `first`, the smallest
    of the records with the same skills, stands for them in p4_pairs.  Joined to p4_pairs by `first`
    on both sides, the rows give every pair of records."""
    out = None
    for name, side in zip(("job", "course"), _sides(spark, folder), strict=True):
        first = side.coded.groupBy("terms").agg(F.min("rec").alias("first"))
        part = side.coded.join(first, "terms").select(F.lit(name).alias("side"), "rec", "first")
        out = part if out is None else out.unionByName(part)
    return out


def _students(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Stored clusters (rec, cluster_id) and similarity groups of the students that have a stored cluster."""
    stored = table(spark, folder, "students_clustered").where("student_id is not null and cluster_id is not null")
    stored = stored.groupBy(F.col("student_id").alias("rec")).agg(F.min("cluster_id").alias("cluster_id"))
    codes = packed_values(spark, folder, "students_clustered", repeats=True)
    return stored, groups.value_groups(codes, 0.8, key=record_code)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    stored, grouped = _students(spark, folder)
    typical = groups.typical_of_sets(stored, grouped["sets"], label="cluster_id")
    return groups.misplaced(grouped, stored, typical, label="cluster_id").select(F.col("rec").alias("student_id"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """group_id, n_students, mean_similarity, typical_students, stored_cluster (the most frequent one) and its share."""
    stored, grouped = _students(spark, folder)
    described = groups.describe_groups(grouped["records"])
    by = grouped["records"].join(stored, "rec").groupBy("group", "cluster_id").agg(F.count(F.lit(1)).alias("k"))
    top = by.groupBy("group").agg(F.max_by("cluster_id", F.struct("k", -F.col("cluster_id"))).alias("stored_cluster"), (F.max("k") / F.sum("k")).alias("share"))
    out = described.join(top, "group", "left")
    return out.select(F.col("group").alias("group_id"), F.col("n_records").alias("n_students"), F.round("mean_similarity", 6).alias("mean_similarity"), F.col("typical").alias("typical_students"), "stored_cluster", F.round("share", 6).alias("stored_share"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every linked skill.  Ids of skills_canonical link skills and may name a group, but are no skills."""
    links = table(spark, folder, "skill_matches").where(match_key("decision") == "match")
    grouped = components.connected_groups(links, "left_id", "right_id").select(F.col("group").alias("group_id"), F.col("vertex").alias("skill_id"))
    return grouped.join(table(spark, folder, "skill_taxonomy").select("skill_id").distinct(), "skill_id", "left_semi").select("group_id", "skill_id")


def _source_key(c: str):
    """A source as written in mix_targets: lower case, blanks and hyphens read as underscores."""
    return F.regexp_replace(match_key(c), r"[\s\-_]+", "_")


def _token_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """item, source, size of every document; a repeated doc_id counts once."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("item"), _source_key("source").alias("source"), "text")
    return cut(with_token_counts(docs, "text", "size").dropDuplicates(["item"]))


def p8_packs(spark: SparkSession, folder: str) -> DataFrame:
    """pack_name, pack_id, doc_id, piece, start, n_tokens: the pack of every document or piece, for every capacity."""
    sizes = _token_sizes(spark, folder)
    out = None
    for r in bounded_rows(table(spark, folder, "pack_sizes").where("capacity > 0").distinct(), 1000, "pack_sizes"):
        part = packing.pack_items(sizes, r["capacity"]).select(F.lit(r["pack_name"]).alias("pack_name"), "pack_id", F.col("item").alias("doc_id"), "piece", "start", F.col("n").alias("n_tokens"))
        out = part if out is None else out.unionByName(part)
    if out is None:  # no capacity, no packs
        return packing.pack_items(sizes.where("false"), 1).select(F.lit("").alias("pack_name"), "pack_id", F.col("item").alias("doc_id"), "piece", "start", F.col("n").alias("n_tokens"))
    return out


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """pack_name, capacity, n_packs, n_tokens, fill: how well the packs are filled."""
    by = p8_packs(spark, folder).groupBy("pack_name").agg(F.count_distinct("pack_id").alias("n_packs"), F.sum("n_tokens").alias("n_tokens"))
    out = by.join(table(spark, folder, "pack_sizes").select("pack_name", "capacity").distinct(), "pack_name")
    return out.select("pack_name", "capacity", "n_packs", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_packs") * F.col("capacity")), 6).alias("fill"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mix_targets").select(_source_key("source").alias("source"), "target_share", "max_repeats")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, n_tokens, repeats, first_slot, reached_share, target_share of the documents used."""
    mixed = mixing.mix_sources(_token_sizes(spark, folder), _targets(spark, folder))
    return mixed.select(F.col("item").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "repeats", "first_slot", F.round("reached_share", 6).alias("reached_share"), "target_share")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """source, target_share, reached_share, n_records, tokens, most_repeats for every target."""
    targets = _targets(spark, folder)
    return mixing.mix_shares(mixing.mix_sources(_token_sizes(spark, folder), targets), targets)


def _screened(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", _source_key("source").alias("source"), "text")
    return screening.with_abuse_scores(docs, "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _screened(spark, folder).where(F.col("score") >= screening.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, score, kind of every document."""
    return _screened(spark, folder).select("doc_id", "source", F.round("score", 6).alias("score"), "kind")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """source, n_docs, n_flagged, rate, mean_score."""
    return screening.rates(_screened(spark, folder), "source")


def p10_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """agreement, n_docs: the scores against the reviewers' sample."""
    return screening.against_labels(_screened(spark, folder), table(spark, folder, "review_labels"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_scores, p2_found, p2_frequencies, p3_found, p3_mapped, p4_found, p4_pairs, p4_members, p6_found, p6_groups, p7_found,
    p8_packs, p8_fill, p9_mix, p9_shares, p10_found, p10_scores, p10_rates, p10_agreement,
)}
