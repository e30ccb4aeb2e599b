"""Scores of documents by the abuse grammar, over whole texts (see abuse)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.abuse import THRESHOLD, Grammar


def with_abuse_scores(docs: DataFrame, text: str, score: str = "score", kind: str = "kind") -> DataFrame:
    """The other columns of docs, the score of each text and the kind of its heaviest clause
    (insult, threat, group, sexual or empty); they replace columns of these names.  Narrow: no
    shuffle, one pass over the texts."""
    others = [c for c in docs.columns if c not in (text, score, kind)]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(score, T.DoubleType()), T.StructField(kind, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar()
        for batch in batches:
            got = [grammar.score(x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([s for s, _ in got], pa.float64()), pa.array([k for _, k in got], pa.string())], names=[*others, score, kind])

    return docs.select(*others, text).mapInArrow(run, schema)


def rates(scored: DataFrame, by: str, threshold: float = THRESHOLD) -> DataFrame:
    """by, n_docs, n_flagged, rate, mean_score; documents without a source form a row of their own."""
    out = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_flagged"), F.avg("score").alias("mean_score"))
    return out.select(by, "n_docs", "n_flagged", (F.col("n_flagged") / F.col("n_docs")).alias("rate"), "mean_score")


def against_labels(scored: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """kind of agreement and its number: scores held against a hand-made sample.  A document labelled
    several times counts by the majority of its labels; ties and null labels are left out."""
    vote = labels.where("flagged is not null").groupBy("doc_id").agg(F.avg("flagged").alias("v")).where("v <> 0.5")
    both = scored.join(vote, "doc_id")
    hit, said = F.col("score") >= threshold, F.col("v") > 0.5
    name = F.when(hit & said, "flagged by both").when(hit, "flagged by the grammar").when(said, "flagged by the reviewers").otherwise("flagged by neither")
    return both.groupBy(name.alias("agreement")).agg(F.count(F.lit(1)).alias("n_docs"))
