"""Personalized PageRank and what is read off the graph with it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.operators.graph import CareerGraph
from pathloom.runtime import cut

ALPHA = 0.85
CUT_EVERY = 5


def personalization(spark: SparkSession, graph: CareerGraph, student: str, career: str | None = None) -> DataFrame:
    """seed, id, p: all on the student, or half on the career; an unknown node is refused."""
    wanted = [student] + ([career] if career else [])
    known = {r[0] for r in graph.nodes.where(F.col("id").isin(wanted)).select("id").collect()}  # at most two rows
    for w in wanted:
        if w not in known:
            raise ValueError(f"{w} is not in the graph")
    p = 1.0 / len(wanted)
    return spark.createDataFrame([(student, w, p) for w in dict.fromkeys(wanted)], "seed string, id string, p double")


def transition(edges: DataFrame) -> DataFrame:
    """src, dst, t: weights over the sum of the source's weights; sources of no weight are dangling.

    The sums are partial aggregates joined back, so the edges of a hub are in no one task."""
    live = edges.where("weight <> 0")
    total = live.groupBy("src").agg(F.sum("weight").alias("total")).where("total <> 0")
    return live.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("t"))


def pagerank(edges: DataFrame, seeds: DataFrame, *, alpha: float = ALPHA, max_iter: int = 100, tol: float | None = 1e-6, n_nodes: int | None = None) -> DataFrame:
    """seed, id, score of all nodes with score, for all seeds at once.

    r <- alpha * (r P + dangling mass * p) + (1 - alpha) * p from r = p.  With `tol`, iteration ends when
    no seed moved by n_nodes * tol in sum (checked at checkpoints); without it, after max_iter
    rounds.  A round is one join on the source and one partial aggregation on (seed, target);
    transitions stay cached and partitioned by source."""
    p = cut(transition(edges)).repartition("src").persist()
    seeds = cut(seeds.select("seed", "id", "p"))
    bound = None if tol is None else tol * (n_nodes or max(1, edges.select("src").union(edges.select("dst")).distinct().count()))
    back = seeds.groupBy("seed").agg(F.collect_list(F.struct("id", "p")).alias("home"))  # the few nodes a seed teleports to
    jump = seeds.select("seed", "id", (F.lit(1 - alpha) * F.col("p")).alias("m"))
    r = seeds.select("seed", "id", F.col("p").alias("score"))
    since, last = 0, r
    for k in range(1, max_iter + 1):
        # one use of r a round: a node without targets sends its score home
        out = r.join(p, r["id"] == p["src"], "left").select("seed", "score", "dst", "t").join(back, "seed")
        home = F.transform("home", lambda x: F.struct(x["id"].alias("id"), (F.col("score") * x["p"]).alias("m")))
        sent = F.when(F.col("dst").isNull(), home).otherwise(F.array(F.struct(F.col("dst").alias("id"), (F.col("score") * F.col("t")).alias("m"))))
        moved = out.select("seed", F.explode(sent).alias("x")).select("seed", "x.id", (F.lit(alpha) * F.col("x.m")).alias("m"))
        r = moved.unionAll(jump).groupBy("seed", "id").agg(F.sum("m").alias("score"))
        since += 1
        if since == CUT_EVERY or k == max_iter:
            r, since = cut(r), 0
            if bound is not None:
                step = r.select("seed", "id", "score", F.lit(0.0).alias("old")).unionAll(last.select("seed", "id", F.lit(0.0), F.col("score").alias("old")))
                delta = step.groupBy("seed", "id").agg(F.abs(F.sum("score") - F.sum("old")).alias("x")).groupBy("seed").agg(F.sum("x").alias("x")).agg(F.max("x")).first()[0]
                if delta is not None and delta < bound:
                    break
            last = r
    p.unpersist()
    return r


def pagerank_dense(edges: DataFrame, seeds: DataFrame, *, alpha: float = ALPHA, max_iter: int = 100, most_edges: int = 500_000) -> DataFrame:
    """The same as `pagerank` with a fixed number of rounds, for a graph of at most `most_edges` edges:
    each seed is one group that iterates over the graph in numpy.  A larger graph takes the joins."""
    t = cut(transition(edges))
    if t.limit(most_edges + 1).count() > most_edges:
        return pagerank(edges, seeds, alpha=alpha, max_iter=max_iter, tol=None)
    table = t.toPandas()
    ids = pd.Index(pd.unique(pd.concat([table["src"], table["dst"]], ignore_index=True)))
    src, dst, w = ids.get_indexer(table["src"]), ids.get_indexer(table["dst"]), table["t"].to_numpy()
    names = ids.to_numpy()
    shared = seeds.sparkSession.sparkContext.broadcast((names, src, dst, w))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        names, src, dst, w = shared.value
        at = pd.Index(names).get_indexer(group["id"])
        extra = group["id"][at < 0]
        n = len(names) + len(extra)
        p = np.zeros(n)
        at = np.where(at < 0, 0, at)
        at[(pd.Index(names).get_indexer(group["id"]) < 0)] = np.arange(len(names), n)
        p[at] = group["p"]
        live = np.zeros(n, bool)
        live[src] = True
        r = p.copy()
        for _ in range(max_iter):
            r = alpha * (np.bincount(dst, r[src] * w, minlength=n) + r[~live].sum() * p) + (1 - alpha) * p
        keep = r > 0
        return pd.DataFrame({"seed": group["seed"].iloc[0], "id": np.concatenate([names, extra.to_numpy()])[keep], "score": r[keep]})

    return seeds.groupBy("seed").applyInPandas(solve, "seed string, id string, score double")


def recommend(scores: DataFrame, edges: DataFrame, *, top_k: int = 10, exclude_completed: bool = True) -> DataFrame:
    """seed, course, score, rank: the best courses of each seed (a student node), completed ones left out.

    Scores are compared at ten decimals, then by id, so that rounding cannot change the order."""
    rows = scores.where(F.col("id").startswith("course:")).select("seed", F.col("id").alias("course"), F.round("score", 10).alias("score"))
    if exclude_completed:
        done = edges.where("edge_type = 'student-course'").select(F.col("src").alias("seed"), F.col("dst").alias("course"))
        rows = rows.join(done, ["seed", "course"], "left_anti")
    best = Window.partitionBy("seed").orderBy(F.desc("score"), "course")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def similar_careers(graph: CareerGraph, targets: DataFrame, *, top_k: int = 5, min_shared: int = 3, min_postings: int = 1) -> DataFrame:
    """target, title, similarity, shared_skill_count, shared_skills_sample, n_postings, rank.

    targets: id (career nodes).  Cosine of the careers' skill weights, rounded to four decimals before
    sorting; ties by title."""
    w = graph.edges_of("career-skill").select("src", "dst", "weight")
    norm = w.groupBy("src").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    mine = w.join(targets.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("target"), "dst", F.col("weight").alias("tw"))
    both = mine.join(w, "dst").where("target <> src").groupBy("target", "src").agg(F.sum(F.col("tw") * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("shared"), F.array_sort(F.collect_list(F.substring("dst", 7, 1_000_000))).alias("names"))
    posts = graph.of_type("career").select(F.col("id").alias("src"), "n_postings").where(F.col("n_postings") >= min_postings)
    both = both.where(F.col("shared") >= min_shared).join(posts, "src").join(norm, "src").join(norm.toDF("target", "tnorm"), "target").where("norm > 0")
    out = both.select("target", F.substring("src", 8, 1_000_000).alias("title"), F.round(F.col("dot") / (F.col("tnorm") * F.col("norm")), 4).alias("similarity"), F.col("shared").alias("shared_skill_count"), F.slice("names", 1, 6).alias("shared_skills_sample"), "n_postings")
    best = Window.partitionBy("target").orderBy(F.desc("similarity"), "title")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def student_skills(edges: DataFrame, *, top_k: int = 10) -> DataFrame:
    """student, skill, weight (four decimals), rank: the strongest inherited skills."""
    rows = edges.where("edge_type = 'student-skill'").select(F.col("src").alias("student"), F.substring("dst", 7, 1_000_000).alias("skill"), F.round("weight", 4).alias("weight"))
    best = Window.partitionBy("student").orderBy(F.desc("weight"), "skill")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def bridges(graph: CareerGraph, requests: DataFrame, *, top_n: int = 5) -> DataFrame:
    """student, career, course, skill, course_weight, career_weight, score, is_gap, rank.

    requests: student, career, course (node ids).  A bridge is a skill of both the course and the career,
    scored by the product of the weights (four decimals before sorting, ties by skill)."""
    cs = graph.edges_of("course-skill").select(F.col("src").alias("course"), "dst", F.col("weight").alias("cw"))
    ks = graph.edges_of("career-skill").select(F.col("src").alias("career"), "dst", F.col("weight").alias("kw"))
    ss = graph.edges_of("student-skill").select(F.col("src").alias("student"), "dst", F.lit(True).alias("has"))
    rows = requests.join(cs, "course").join(ks, ["career", "dst"]).join(ss, ["student", "dst"], "left")
    rows = rows.select("student", "career", "course", F.substring("dst", 7, 1_000_000).alias("skill"), F.round("cw", 4).alias("course_weight"), F.round("kw", 4).alias("career_weight"), F.round(F.col("cw") * F.col("kw"), 4).alias("score"), F.col("has").isNull().alias("is_gap"))
    best = Window.partitionBy("student", "career", "course").orderBy(F.desc("score"), "skill")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)


def explanations(found: DataFrame, requests: DataFrame, names: DataFrame) -> DataFrame:
    """student, career, course, text: one to three sentences; names: course, name."""
    keys = ["student", "career", "course"]
    top = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "skill", "is_gap"))).alias("b"))
    rows = requests.join(names, "course", "left").join(top, keys, "left")
    gaps = F.filter("b", lambda x: x["is_gap"])
    name = F.coalesce("name", F.lit(""))
    lead = F.concat(name, F.lit(" covers "), F.array_join(F.slice(F.col("b.skill"), 1, 3), ", "), F.lit(" — all relevant to your target career."))
    more = F.when(F.size(gaps) > 0, F.concat(F.lit(" In particular, you haven't built "), F.array_join(F.slice(F.transform(gaps, lambda x: x["skill"]), 1, 3), ", "), F.lit(" yet."))).otherwise("")
    text = F.when(F.col("b").isNull(), F.concat(name, F.lit(" has no overlapping skills with your career goal."))).otherwise(F.concat(lead, more))
    return rows.select(*keys, text.alias("text"))


def cosine_courses(courses: DataFrame, career_skills: DataFrame, *, top_k: int = 10) -> DataFrame:
    """title, code, score, rank: courses by cosine of their skill list (weight 1 each) with the career's weights.

    courses: code, skills; career_skills: title, skill, weight.  Courses without skills score 0; a career
    of no weight has no rows.  The course list is scored per career, so careers should be a handful."""
    norm = career_skills.groupBy("title").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).where("norm > 0")
    rows = courses.select("code", F.size("skills").alias("k"), F.explode("skills").alias("skill")).join(career_skills, "skill")
    hit = rows.groupBy("title", "code").agg((F.sum("weight") / F.sqrt(F.first("k"))).alias("dot"))
    every = courses.select("code").crossJoin(F.broadcast(norm))  # one row per requested career
    out = every.join(hit, ["title", "code"], "left").select("title", "code", F.round(F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)), 10).alias("score"))
    best = Window.partitionBy("title").orderBy(F.desc("score"), "code")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def coverage(recommended: DataFrame, course_skills: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, coverage: share of the needed skills that the recommended courses teach; 0 if none is needed.

    recommended: keys, code; course_skills: code, skill; needed: keys, skill."""
    need = needed.select(*keys, "skill").distinct()
    have = recommended.join(course_skills, "code").select(*keys, "skill").distinct().withColumn("hit", F.lit(1))
    by = need.join(have, [*keys, "skill"], "left").groupBy(*keys).agg((F.count("hit") / F.count(F.lit(1))).alias("c"))
    return recommended.select(*keys).distinct().join(by, keys, "left").select(*keys, F.coalesce("c", F.lit(0.0)).alias("coverage"))


def diversity(recommended: DataFrame, course_sets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, diversity: mean Jaccard distance of the pairs of a list (a top-k list); pairs without any skill are skipped.

    recommended: keys, code, rank; course_sets: code, skills (array of distinct skills)."""
    rows = recommended.join(course_sets, "code", "left").select(*keys, "rank", F.coalesce("skills", F.array().cast("array<string>")).alias("s"))
    other = rows.select(*keys, F.col("rank").alias("r2"), F.col("s").alias("s2"))
    union = F.size(F.array_union("s", "s2"))
    pairs = rows.join(other, keys).where("rank < r2").where(union > 0)
    by = pairs.groupBy(*keys).agg(F.avg(1 - F.size(F.array_intersect("s", "s2")) / union).alias("d"))
    return recommended.select(*keys).distinct().join(by, keys, "left").select(*keys, F.coalesce("d", F.lit(0.0)).alias("diversity"))
