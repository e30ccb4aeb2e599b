"""How distinctive a term is per record: probabilistic relevance weighting (BM25).

Defined results: null records and null terms are left out; a term repeated in a record raises its
term frequency; records without terms count in the number of records and in the average length;
an empty table gives no rows; extra columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.runtime import keep

K1, B = 1.2, 0.75


def distinctive_terms(terms: DataFrame, records: DataFrame, *, record: str = "rec", term: str = "term", k1: float = K1, b: float = B) -> DataFrame:
    """record, term, tf, doc_len, n_terms, doc_freq, n_docs, score.

    `terms` has one row per occurrence, `records` one row per record (repeats allowed).  The score
    is idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len)) with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)).  One shuffle by record makes term frequencies and
    lengths; document frequencies are partly summed before their shuffle, so a term that a third
    of the records hold costs no more than any other; the join that brings them back is a
    broadcast or a skew-split one as the measured size tells (AQE)."""
    n = records.select(record).where(F.col(record).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    rows = terms.select(record, term).where(F.col(record).isNotNull() & F.col(term).isNotNull())
    tf = rows.groupBy(record, term).agg(F.count(F.lit(1)).alias("tf"))
    whole = Window.partitionBy(record)
    tf = keep(tf.withColumns({"doc_len": F.sum("tf").over(whole), "n_terms": F.count(F.lit(1)).over(whole)}))  # read three times
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("doc_freq"))
    length = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all_terms"))
    out = tf.join(df, term).crossJoin(F.broadcast(n.crossJoin(length)))  # one row
    idf = F.log1p((F.col("n_docs") - F.col("doc_freq") + 0.5) / (F.col("doc_freq") + 0.5))
    norm = 1 - b + b * F.col("doc_len") / (F.col("all_terms") / F.col("n_docs"))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    return out.select(record, term, "tf", "doc_len", "n_terms", "doc_freq", "n_docs", score.alias("score"))


def sole_markers(scored: DataFrame, *, record: str = "rec", term: str = "term", rare: float = 0.01, common: float = 0.05) -> DataFrame:
    """Records with at least two terms of which one is in under `rare` of all records and every
    other one in over `common` of them: record and that term, read off the scored rows."""
    is_rare = F.col("doc_freq") < rare * F.col("n_docs")
    is_common = F.col("doc_freq") > common * F.col("n_docs")
    by = scored.groupBy(record).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(is_rare).alias("_rare"), F.count_if(is_common).alias("_common"),
        F.max(F.when(is_rare, F.col(term))).alias(term),
    )
    return by.where("_all >= 2 and _rare = 1 and _common = _all - 1").select(record, term)
