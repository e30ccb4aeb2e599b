"""Heterogeneous graph of skills, courses, careers and students as two DataFrames.

nodes(id, type, name, doc_frequency, n_postings, career_goal, year) and
edges(src, dst, weight, edge_type); ids are "<type>:<key>".  An ordered pair of nodes has one edge.

Inputs: courses(code, name, prerequisites_text, skills array), jobs(title, skills array),
students(student_id, year, career_goal, completed array), skills(canonical_name, doc_frequency);
codes, ids and names are distinct."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.parsing import prerequisites

PREREQ_WEIGHT = 0.5


@dataclass(frozen=True)
class CareerGraph:
    nodes: DataFrame
    edges: DataFrame

    def of_type(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("type") == kind)

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("edge_type").isin(list(kinds)))


def node_id(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key) if isinstance(key, str) else key)


def idf(skills: DataFrame, n_docs: Column) -> DataFrame:
    """skill, idf = ln(n_docs / max(1, df)); zero or negative where a skill is counted more often than there are documents."""
    return skills.select(F.col("canonical_name").alias("skill"), F.log(n_docs / F.greatest(F.lit(1), F.col("doc_frequency"))).alias("idf"))


def n_documents(courses: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: the number of courses and jobs."""
    return courses.select(F.lit(1).alias("x")).unionAll(jobs.select(F.lit(1).alias("x"))).agg(F.count("x").alias("n_docs"))


def course_skill(courses: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """code, skill, weight = idf / sqrt(k), k the number of valid entries of the course's list (repeats count)."""
    weights = skills.crossJoin(F.broadcast(n_documents(courses, jobs)))  # one row
    weights = idf(weights, F.col("n_docs"))
    rows = courses.select("code", F.explode("skills").alias("skill")).join(weights, "skill")
    k = F.count(F.lit(1)).over(Window.partitionBy("code"))
    return rows.withColumn("weight", F.col("idf") / F.sqrt(k)).select("code", "skill", "weight").distinct()


def career_skill(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """title, skill, weight: share of the skill in all valid skill mentions of the title's postings."""
    valid = skills.select(F.col("canonical_name").alias("skill"))
    counts = jobs.select("title", F.explode("skills").alias("skill")).join(valid, "skill", "left_semi").groupBy("title", "skill").agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy("title"))
    return counts.withColumn("weight", F.col("c") / total).select("title", "skill", "c", "weight")


def student_course(students: DataFrame, courses: DataFrame) -> DataFrame:
    """student_id, code of every completed entry that is a course; repeats stay."""
    rows = students.select("student_id", F.explode("completed").alias("code"))
    return rows.join(courses.select("code"), "code", "left_semi").select("student_id", "code")


def student_skill(taken: DataFrame, course_skills: DataFrame) -> DataFrame:
    """student_id, skill, weight: summed course weights over the student's largest sum (as they are if none is positive)."""
    rows = taken.join(course_skills, "code").groupBy("student_id", "skill").agg(F.sum("weight").alias("w"))
    top = F.max("w").over(Window.partitionBy("student_id"))
    return rows.withColumn("weight", F.when(top > 0, F.col("w") / top).otherwise(F.col("w"))).select("student_id", "skill", "weight")


def prereq_edges(courses: DataFrame) -> DataFrame:
    """prereq, code: courses named in another one's prerequisites."""
    rows = courses.select("code", F.explode(prerequisites("prerequisites_text")).alias("prereq"))
    return rows.join(courses.select(F.col("code").alias("prereq")), "prereq", "left_semi").select("prereq", "code").distinct()


def careers(jobs: DataFrame) -> DataFrame:
    """title, n_postings of every title, with or without skills."""
    return jobs.groupBy("title").agg(F.count(F.lit(1)).alias("n_postings"))


def _edges(df: DataFrame, src: Column, dst: Column, weight: Column, kind: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), weight.cast("double").alias("weight"), F.lit(kind).alias("edge_type"))


def build_graph(courses: DataFrame, jobs: DataFrame, students: DataFrame, skills: DataFrame) -> CareerGraph:
    """All nodes and edges.  Every kind of edge is its own plan of equi-joins and partial aggregates."""
    cs = course_skill(courses, jobs, skills)  # documents without a title count, too
    jobs = jobs.where("title is not null")
    ks = career_skill(jobs, skills)
    taken = student_course(students, courses)
    ss = student_skill(taken, cs)
    w = F.col("weight")
    parts = [
        _edges(cs, node_id("course", "code"), node_id("skill", "skill"), w, "course-skill"),
        _edges(cs, node_id("skill", "skill"), node_id("course", "code"), w, "skill-course"),
        _edges(ks, node_id("career", "title"), node_id("skill", "skill"), w, "career-skill"),
        _edges(ks, node_id("skill", "skill"), node_id("career", "title"), w, "skill-career"),
        _edges(taken.distinct(), node_id("student", "student_id"), node_id("course", "code"), F.lit(1.0), "student-course"),
        _edges(ss, node_id("student", "student_id"), node_id("skill", "skill"), w, "student-skill"),
        _edges(prereq_edges(courses), node_id("course", "prereq"), node_id("course", "code"), F.lit(PREREQ_WEIGHT), "prereq"),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionAll(p)
    none = lambda kind: F.lit(None).cast(kind)

    def nodes(df, kind, key, name=None, df_=None, posts=None, goal=None, year=None):
        return df.select(
            node_id(kind, key).alias("id"), F.lit(kind).alias("type"), (F.col(name) if name else none("string")).alias("name"),
            (F.col(df_).cast("bigint") if df_ else none("bigint")).alias("doc_frequency"), (F.col(posts) if posts else none("bigint")).alias("n_postings"),
            (F.col(goal) if goal else none("string")).alias("career_goal"), (F.coalesce(F.col(year), F.lit(0)) if year else none("int")).alias("year"),
        )

    all_nodes = nodes(skills, "skill", "canonical_name", df_="doc_frequency").unionAll(nodes(courses, "course", "code", name="name"))
    all_nodes = all_nodes.unionAll(nodes(careers(jobs), "career", "title", posts="n_postings")).unionAll(nodes(students, "student", "student_id", goal="career_goal", year="year"))
    return CareerGraph(all_nodes, edges)


def graph_stats(graph: CareerGraph) -> DataFrame:
    """metric, value: nodes and edges, in all and by type, weakly connected components, and whether there is one only."""
    from pathloom.operators.resolve import components

    links = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    parts = components(graph.nodes, links, vertex="id").agg(F.count_distinct("root").alias("n"))
    n = F.count(F.lit(1))
    rows = [
        graph.nodes.agg(n.alias("value")).select(F.lit("n_nodes").alias("metric"), "value"),
        graph.edges.agg(n.alias("value")).select(F.lit("n_edges").alias("metric"), "value"),
        graph.nodes.groupBy("type").agg(n.alias("value")).select(F.concat(F.lit("nodes:"), "type").alias("metric"), "value"),
        graph.edges.groupBy("edge_type").agg(n.alias("value")).select(F.concat(F.lit("edges:"), "edge_type").alias("metric"), "value"),
        parts.select(F.lit("n_weakly_connected_components").alias("metric"), F.col("n").alias("value")),
        parts.select(F.lit("is_weakly_connected").alias("metric"), (F.col("n") == 1).cast("bigint").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def transient_student(spark: SparkSession, graph: CareerGraph, completed: list[str], *, student_id: str, career_goal: str = "", year: int = 0) -> CareerGraph:
    """The graph with a what-if student; the given graph is untouched.  Unknown courses are skipped, a
    known student is refused."""
    sid = f"student:{student_id}"
    if not graph.nodes.where(F.col("id") == sid).isEmpty():
        raise ValueError(f"{sid} is in the graph already")
    taken = spark.createDataFrame([(student_id, c) for c in completed], "student_id string, code string")
    known = graph.of_type("course").select(F.substring("id", 8, 1_000_000).alias("code"))
    taken = taken.join(known, "code", "left_semi").select("student_id", "code")
    cs = graph.edges_of("course-skill").select(F.substring("src", 8, 1_000_000).alias("code"), F.substring("dst", 7, 1_000_000).alias("skill"), "weight")
    new = _edges(taken.distinct(), F.lit(sid), node_id("course", "code"), F.lit(1.0), "student-course")
    new = new.unionAll(_edges(student_skill(taken, cs), F.lit(sid), node_id("skill", "skill"), F.col("weight"), "student-skill"))
    node = spark.createDataFrame([(sid, "student", career_goal, year)], "id string, type string, career_goal string, year int")
    return CareerGraph(graph.nodes.unionByName(node, allowMissingColumns=True), graph.edges.unionAll(new))
