"""Queries of the graph, join, ranking, metric, cohort, report and service operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators import cohort, graph, ranking, report, sessions
from pathloom.operators.extract import insight_prompt
from pathloom.functions.strings import record_code, strip
from pathloom.plans import inputs as I
from pathloom.plans.inputs import ITERATIONS, strip_sql, with_sql
from pathloom.plans.registry import QUERIES, SQL, query
from pathloom.runtime import bounded_rows, cut, fresh_folder
from pathloom.sources import files, sinks
from pathloom.sources.tables import table


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---- graph


@query(with_sql("SELECT skill, round(idf, 6) AS idf FROM idf"))
def g_idf(s, d):
    n = graph.n_documents(I.courses(s, d), I.jobs(s, d))
    rows = I.skills(s, d).crossJoin(F.broadcast(n))  # one row
    return graph.idf(rows, F.col("n_docs")).withColumn("idf", r6("idf"))


@query(with_sql("SELECT code, skill, round(weight, 6) AS weight FROM cs"))
def g_edges_course_skill(s, d):
    return I.course_skills(s, d).withColumn("weight", r6("weight"))


@query(with_sql("SELECT title, skill, round(weight, 6) AS weight FROM ks"))
def g_edges_career_skill(s, d):
    return I.career_skills(s, d).select("title", "skill", r6("weight").alias("weight"))


@query(with_sql("SELECT title, n_postings FROM careers WHERE title NOT IN (SELECT title FROM ks)"))
def g_orphan_careers(s, d):
    jobs = I.jobs(s, d).where("title is not null")
    return graph.careers(jobs).join(I.career_skills(s, d).select("title"), "title", "left_anti")


@query(with_sql("SELECT src, dst, round(weight, 6) AS weight, edge_type FROM edges WHERE edge_type IN ('student-course', 'student-skill')"))
def g_edges_student(s, d):
    return I.whole_graph(s, d).edges_of("student-course", "student-skill").withColumn("weight", r6("weight"))


@query(with_sql("SELECT prereq, code FROM pre"))
def g_edges_prereq(s, d):
    return graph.prereq_edges(I.courses(s, d))


@query(with_sql("SELECT src, dst, round(weight, 6) AS weight, edge_type FROM edges"))
def g_build(s, d):
    return I.whole_graph(s, d).edges.withColumn("weight", r6("weight"))


@query(with_sql("""SELECT 'n_nodes' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'n_edges', count(*) FROM edges
    UNION ALL SELECT 'nodes:' || type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'edges:' || edge_type, count(*) FROM edges GROUP BY edge_type"""))
def agg_type_counts(s, d):
    """Nodes and edges by type."""
    g = I.whole_graph(s, d)
    n = F.count(F.lit(1)).alias("value")
    out = g.nodes.agg(n).select(F.lit("n_nodes").alias("metric"), "value").unionAll(g.edges.agg(n).select(F.lit("n_edges").alias("metric"), "value"))
    out = out.unionAll(g.nodes.groupBy("type").agg(n).select(F.concat(F.lit("nodes:"), "type").alias("metric"), "value"))
    return out.unionAll(g.edges.groupBy("edge_type").agg(n).select(F.concat(F.lit("edges:"), "edge_type").alias("metric"), "value"))


@query()
def g_stats(s, d):
    """Counts, weakly connected components and whether there is one; the components loop has no SQL twin at this size."""
    g = I.whole_graph(s, d)
    return graph.graph_stats(graph.CareerGraph(cut(g.nodes), cut(g.edges)))


@query(with_sql("SELECT id, type FROM nodes"))
def flt_node_type(s, d):
    g = I.whole_graph(s, d)
    out = None
    for kind in ("skill", "course", "career", "student"):
        part = g.of_type(kind).select("id", "type")
        out = part if out is None else out.unionAll(part)
    return out


@query(with_sql("SELECT src, dst FROM edges WHERE edge_type = 'student-course'"))
def flt_edge_type(s, d):
    return I.whole_graph(s, d).edges_of("student-course").select("src", "dst")


@query(with_sql("SELECT profile, student_id, career_goal FROM asked"))
def flt_profile(s, d):
    """The first matching student of each case-study profile."""
    return I.requests(s, d)


def _what_if(s, d) -> tuple[graph.CareerGraph, list[str]]:
    """A what-if student with the catalogue's most required courses and one unknown code."""
    top = graph.prereq_edges(I.courses(s, d)).groupBy("prereq").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prereq").limit(5)
    done = [r[0] for r in top.collect()]  # five codes: the request's own list
    return I.request_graph(s, d), [*done, "NONE0000"]


@query(with_sql("""WITH pick AS (SELECT prereq AS code FROM pre GROUP BY 1 ORDER BY count(*) DESC, prereq LIMIT 5), w AS (SELECT skill, sum(weight) AS w FROM pick JOIN cs USING (code) GROUP BY 1)
    SELECT 'student:WHATIF' AS src, 'course:' || code AS dst, 1.0::DOUBLE AS weight, 'student-course' AS edge_type FROM pick
    UNION ALL SELECT 'student:WHATIF', 'skill:' || skill, round(w / max(w) OVER (), 6), 'student-skill' FROM w"""))
def g_transient(s, d):
    g, done = _what_if(s, d)
    return graph.transient_student(s, g, done, student_id="WHATIF").edges.where("src = 'student:WHATIF'").withColumn("weight", r6("weight"))


# ---- joins and aggregates


@query(with_sql("SELECT code, skill FROM cse WHERE skill IN (SELECT canonical_name FROM skills)"))
def jn_valid_semi(s, d):
    valid = I.skills(s, d).select(F.col("canonical_name").alias("skill"))
    return I.courses(s, d).select("code", F.explode("skills").alias("skill")).join(valid, "skill", "left_semi").select("code", "skill")


@query(with_sql("SELECT student_id, code FROM taken"))
def jn_student_course(s, d):
    return I.taken(s, d)


@query(with_sql("SELECT student_id, skill, round(weight, 6) AS weight FROM ss"))
def jn_student_skill(s, d):
    return I.student_skills(s, d).withColumn("weight", r6("weight"))


@query(with_sql("SELECT prereq, code FROM pre"))
def jn_prereq(s, d):
    return graph.prereq_edges(I.courses(s, d))


_GOALS = "SELECT DISTINCT student_id, career_goal FROM asked"


@query(with_sql("SELECT code, title, skill, round(cs.weight * ks.weight, 6) AS score FROM cs JOIN ks USING (skill) WHERE title IN (SELECT career_goal FROM asked)"))
def jn_bridge(s, d):
    """Bridge skills of every course to the requested careers."""
    goals = I.requests(s, d).select(F.col("career_goal").alias("title")).distinct()
    ks = I.career_skills(s, d).join(F.broadcast(goals), "title", "left_semi").withColumnRenamed("weight", "kw")  # one row per profile
    return I.course_skills(s, d).join(ks, "skill").select("code", "title", "skill", r6(F.col("weight") * F.col("kw")).alias("score"))


@query(with_sql(f"SELECT a.student_id, ks.skill, ss.skill IS NULL AS is_gap FROM ({_GOALS}) a JOIN ks ON ks.title = a.career_goal LEFT JOIN ss ON ss.student_id = a.student_id AND ss.skill = ks.skill"))
def jn_gap(s, d):
    """Skills of the goal, flagged where the student lacks them."""
    r = I.requests(s, d).select("student_id", F.col("career_goal").alias("title")).distinct()
    need = I.career_skills(s, d).join(F.broadcast(r), "title").select("student_id", "skill")  # one row per profile
    have = I.student_skills(s, d).select("student_id", "skill", F.lit(True).alias("has"))
    return need.join(have, ["student_id", "skill"], "left").select("student_id", "skill", F.col("has").isNull().alias("is_gap"))


@query(with_sql("SELECT student_id, code FROM (SELECT student_id, unnest(completed) AS code FROM studs) WHERE code NOT IN (SELECT code FROM courses)"))
def jn_exclude_completed(s, d):
    """Completed entries that are in no catalogue (anti join)."""
    rows = I.students(s, d).select("student_id", F.explode("completed").alias("code"))
    return rows.join(I.courses(s, d).select("code"), "code", "left_anti").select("student_id", "code")


_COS = """WITH nrm AS (SELECT title, sqrt(sum(weight * weight)) AS norm FROM ks GROUP BY 1),
    goal AS (SELECT DISTINCT career_goal AS title FROM asked),
    dot AS (SELECT g.title AS target, o.title, sum(t.weight * o.weight) AS dot, count(*) AS shared, list_sort(list(o.skill)) AS names FROM goal g JOIN ks t ON t.title = g.title JOIN ks o ON o.skill = t.skill AND o.title <> g.title GROUP BY 1, 2)"""


@query(with_sql(_COS + " SELECT target, dot.title, round(dot / (a.norm * b.norm), 6) AS similarity FROM dot JOIN nrm a ON a.title = target JOIN nrm b ON b.title = dot.title"))
def jn_career_cosine(s, d):
    """Cosine of the requested careers with all others."""
    ks = I.career_skills(s, d)
    goals = I.requests(s, d).select(F.col("career_goal").alias("title")).distinct()
    norm = ks.groupBy("title").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    t = ks.join(F.broadcast(goals), "title", "left_semi").select(F.col("title").alias("target"), "skill", F.col("weight").alias("tw"))  # one row per profile
    dots = t.join(ks, "skill").where("target <> title").groupBy("target", "title").agg(F.sum(F.col("tw") * F.col("weight")).alias("dot"))
    both = dots.join(norm, "title").join(norm.toDF("target", "tnorm"), "target")
    return both.select("target", "title", r6(F.col("dot") / (F.col("tnorm") * F.col("norm"))).alias("similarity"))


@query(with_sql(_COS + """ SELECT * FROM (SELECT target, title, similarity, shared_skill_count, sample, n_postings, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, title) AS rank FROM
    (SELECT 'career:' || target AS target, dot.title, round(dot / (a.norm * b.norm), 4) AS similarity, shared AS shared_skill_count, array_to_string(names[1:6], ';') AS sample, n_postings FROM dot JOIN nrm a ON a.title = target JOIN nrm b ON b.title = dot.title JOIN careers ON careers.title = dot.title WHERE shared >= 3)) WHERE rank <= 5"""))
def r_similar(s, d):
    g = I.request_graph(s, d)
    goals = I.requests(s, d).select(graph.node_id("career", "career_goal").alias("id")).distinct()
    out = ranking.similar_careers(g, goals)
    return out.select("target", "title", "similarity", "shared_skill_count", F.array_join("shared_skills_sample", ";").alias("sample"), "n_postings", "rank")


@query(with_sql("SELECT skill, in_courses, in_jobs FROM (SELECT canonical_name AS skill, canonical_name IN (SELECT skill FROM cse) AS in_courses, canonical_name IN (SELECT skill FROM kse) AS in_jobs FROM skills)"))
def jn_in_set_flag(s, d):
    return _sourced(s, d).select("skill", "in_courses", "in_jobs")


def _exploded(df: DataFrame) -> DataFrame:
    return df.select(F.explode("skills").alias("skill"))


def _sourced(s, d):
    freq = I.skills(s, d).select(F.col("canonical_name").alias("skill"), "doc_frequency")
    return report.with_source(freq, _exploded(I.courses(s, d)), _exploded(I.jobs(s, d).where("title is not null")))


def _sessions(s, d):
    """course_code, ord, schedule, classroom, teacher and offering fields: the sessions of every course."""
    raw = table(s, d, "courses_skills").where("code is not null")
    one = raw.select(record_code("code").alias("course_code"), "name", "units", "requirements", "offering_unit", "offering_programme", "schedules", "classrooms", "teachers")
    one = one.groupBy("course_code").agg(*(F.min(c).alias(c) for c in one.columns if c != "course_code"))
    zipped = F.arrays_zip(F.col("schedules").alias("schedule"), F.col("classrooms").alias("classroom"), F.col("teachers").alias("teacher"))
    rows = one.select("course_code", F.col("name").alias("title_session"), "units", "requirements", "offering_unit", "offering_programme", F.posexplode_outer(zipped).alias("ord", "z"))
    return rows.select("*", "z.*").drop("z").withColumn("ord", F.coalesce("ord", F.lit(0)))


_ONE = f"SELECT upper({strip_sql('code')}) AS course_code, min(name) AS title_session, min(units) AS units, min(requirements) AS requirements, min(offering_unit) AS offering_unit, min(offering_programme) AS offering_programme, min(schedules) AS a, min(classrooms) AS b, min(teachers) AS c FROM courses_skills WHERE code IS NOT NULL GROUP BY 1"
_DED = lambda c: f"array_to_string(list_filter(list_filter(coalesce({c}, []), lambda v: v IS NOT NULL AND v <> ''), lambda v, i: list_position(list_filter({c}, lambda w: w IS NOT NULL AND w <> ''), v) = i), ';')"


@query(f"SELECT course_code, title_session, units, requirements, offering_unit, offering_programme, {_DED('a')} AS schedules, {_DED('b')} AS classrooms, {_DED('c')} AS teachers FROM ({_ONE})")
def agg_collapse_sessions(s, d):
    return sinks.flatten_lists(sessions.collapse_sessions(_sessions(s, d)))


@query(with_sql(f"SELECT c.code, c.name, coalesce(len(list_filter(o.a, lambda v: v IS NOT NULL AND v <> '')) > 0, false) AS is_offered_current_sem, o.offering_unit FROM courses c LEFT JOIN ({_ONE}) o ON o.course_code = c.code"))
def jn_courses_offering(s, d):
    out = sessions.course_master(I.courses(s, d).select("code", "name"), sessions.collapse_sessions(_sessions(s, d)))
    return out.select("code", "name", "is_offered_current_sem", "offering_unit")


@query(f"SELECT course_code, count(*) AS n FROM (SELECT upper({strip_sql('code')}) AS course_code FROM courses_skills WHERE code IS NOT NULL) GROUP BY 1")
def src_timetable(s, d):
    """All offerings exported as timetable files (a title row, a header, CSV rows), read back and counted per code."""
    path = fresh_folder(s, "src_timetable")
    flat = [F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " ") for c in ("code", "name", "units", "offering_unit")]
    names = ("Course Code", "Course Title & Session", "Units", "Offering Unit")
    line = F.to_csv(F.struct(*(c.alias(n) for c, n in zip(flat, names))), {"escape": '"'})
    rows = table(s, d, "courses_skills").where("code is not null").select(F.pmod(F.xxhash64("code"), F.lit(64)).alias("part"), line.alias("line"))
    files_ = rows.groupBy("part").agg(F.concat_ws("\n", F.lit("Timetable"), F.lit(",".join(names)), F.array_join(F.collect_list("line"), "\n")).alias("text"))
    files_.write.partitionBy("part").text(path)
    return files.read_timetable(s, f"{path}/*/*.txt").groupBy(F.upper("course_code").alias("course_code")).agg(F.count(F.lit(1)).alias("n"))


_POSTINGS = "SELECT job_id, nullif(title, '') AS title, '' AS description, normalized_salary, nullif(location, '') AS location, nullif(formatted_experience_level, '') AS formatted_experience_level, listed_time FROM jobs_canonical WHERE job_id IS NOT NULL"


def _write_postings(s, d, path: str, header: bool) -> None:
    jobs = table(s, d, "jobs_canonical").select("job_id", "title", F.lit(None).cast("string").alias("description"), "normalized_salary", "location", "formatted_experience_level", "listed_time")
    jobs.write.mode("overwrite").option("header", header).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


@query(_POSTINGS)
def src_unzip(s, d):
    """All postings as one CSV in an archive in the shared folder, extracted once (the second call
    finds the member there) and read."""
    path = fresh_folder(s, "src_unzip")
    _write_postings(s, d, f"{path}/parts", header=False)
    files.zip_member(s, f"{path}/parts", f"{path}/archive.zip", head=",".join(f.name for f in files.POSTING_SCHEMA.fields) + "\n")
    first, again = (files.ensure_extracted(f"{path}/archive.zip", f"{path}/out", spark=s) for _ in range(2))
    assert first == again
    return files.read_postings(s, first)


@query(_POSTINGS)
def src_postings(s, d):
    """Postings written as CSV to the shared folder, read back by schema (empty fields are null), cleaned."""
    path = fresh_folder(s, "src_postings")
    _write_postings(s, d, path, header=True)
    raw = s.read.schema(files.POSTING_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return files.clean_postings(raw)


@query("SELECT count(*) AS n, count(DISTINCT skill) AS n_skills FROM skill_taxonomy")
def src_csv_p2(s, d):
    """Scan of a stage's output with two of its columns read."""
    return table(s, d, "skill_taxonomy").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("skill").alias("n_skills"))


@query(with_sql("SELECT edge_type, count(*) AS n FROM edges GROUP BY 1"))
def src_graph(s, d):
    """The graph written as two tables and read again."""
    path = fresh_folder(s, "src_graph")
    sinks.write_graph(I.whole_graph(s, d), path)
    return sinks.read_graph(s, path).edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("SELECT type, count(*) AS n FROM nodes GROUP BY 1"))
def snk_graph(s, d):
    path = fresh_folder(s, "snk_graph")
    sinks.write_graph(I.whole_graph(s, d), path)
    return sinks.read_graph(s, path).nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


query(SQL["snk_graph"], "snk_pickle")(QUERIES["snk_graph"])  # the graph's file is a pair of Parquet tables here


_KEYS = "SELECT sha1(text) AS key, min(lang) AS lang FROM documents WHERE text IS NOT NULL GROUP BY 1"


def _cached_texts(s, d):
    return table(s, d, "documents").where("text is not null").groupBy(F.sha1("text").alias("key")).agg(F.array(F.min("lang")).alias("skills"))


@query(_KEYS)
def src_cache(s, d):
    """A cache of every distinct text, read; one that is not there reads as an empty table."""
    path = fresh_folder(s, "src_cache")
    missing = files.read_cache(s, path)
    sinks.flush_cache(s, _cached_texts(s, d), path)
    return missing.unionByName(files.read_cache(s, path)).select("key", F.col("skills")[0].alias("lang"))


@query("SELECT count(DISTINCT text) AS n FROM documents")
def snk_cache(s, d):
    """Distinct texts flushed to the cache table twice; the second time adds nothing."""
    path = fresh_folder(s, "snk_cache")
    for _ in range(2):
        sinks.flush_cache(s, _cached_texts(s, d), path)
    return files.read_cache(s, path).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT course_code, {_DED('a')} AS schedules FROM ({_ONE})")
def snk_csv(s, d):
    """Offerings written as CSV with flattened lists and read back."""
    path = fresh_folder(s, "snk_csv")
    sinks.write_csv(sessions.collapse_sessions(_sessions(s, d)).select("course_code", "schedules"), path)
    return s.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).select("course_code", F.coalesce("schedules", F.lit("")).alias("schedules"))


@query(with_sql("SELECT code, array_to_string(skills, ';') AS skills FROM courses"))
def snk_flatten(s, d):
    return sinks.flatten_lists(I.courses(s, d).select("code", "skills"))


@query(with_sql("SELECT title, n_postings FROM careers"))
def snk_json(s, d):
    path = fresh_folder(s, "snk_json")
    sinks.write_json(graph.careers(I.jobs(s, d).where("title is not null")), path)
    return s.read.schema("title string, n_postings bigint").json(path)


@query("SELECT cluster_id, count(*) AS n FROM students_clustered GROUP BY 1")
def snk_csv_p2(s, d):
    """Stage outputs (students with their cluster) written as CSV and read back."""
    path = fresh_folder(s, "snk_csv_p2")
    sinks.write_csv(table(s, d, "students_clustered").select("student_id", "cluster_id"), path)
    return s.read.schema("student_id string, cluster_id int").option("header", True).csv(path).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def snk_html(s, d):
    """The report's tables as one page, one row."""
    tables = {"Skill frequencies": rpt_bins(s, d), "Top skills": rpt_top30(s, d), "Overlap": set_overlap(s, d), "Skills per document": rpt_per_doc(s, d)}
    return s.createDataFrame([(sinks.report_html("Skills", tables),)], "html string")


@query()
def snk_md(s, d):
    """Case studies as Markdown, one row."""
    rows = [r.asDict() for r in m_cases(s, d).collect()]  # one row per profile
    return s.createDataFrame([(sinks.case_markdown(rows),)], "markdown string")


@query("SELECT code, count(*) AS n FROM courses_skills GROUP BY 1")
def prj_drop(s, d):
    return table(s, d, "courses_skills").drop("description", "extracted_skills").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query()
def smp_fixed_n(s, d):
    """Exactly min(5000, n) postings, drawn by hash."""
    return I.jobs(s, d).select("job_id", "title").orderBy(F.xxhash64("job_id", F.lit(42)), "job_id").limit(5000)


@query(with_sql("SELECT title, skill, c FROM ks"))
def agg_career_counts(s, d):
    return I.career_skills(s, d).select("title", "skill", "c")


@query(with_sql("SELECT title, round(sum(weight), 6) AS total, count(*) AS n FROM ks GROUP BY 1"))
def agg_ratio(s, d):
    return I.career_skills(s, d).groupBy("title").agg(r6(F.sum("weight")).alias("total"), F.count(F.lit(1)).alias("n"))


@query(with_sql("SELECT title, n_postings FROM careers ORDER BY n_postings DESC, title LIMIT 80"))
def agg_value_counts(s, d):
    """The 80 most frequent titles."""
    return graph.careers(I.jobs(s, d).where("title is not null")).orderBy(F.desc("n_postings"), "title").limit(80)


@query(with_sql("SELECT title, round(sqrt(sum(weight * weight)), 6) AS norm FROM ks GROUP BY 1"))
def agg_norm(s, d):
    return I.career_skills(s, d).groupBy("title").agg(r6(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).alias("norm"))


@query("SELECT count_if(canonical_skills IS NULL OR trim(canonical_skills, E' \\t\\n\\r') = '')::BIGINT AS empty, count(*) AS n FROM courses_canonical")
def agg_count_where(s, d):
    return table(s, d, "courses_canonical").agg(F.count_if(F.coalesce(strip("canonical_skills"), F.lit("")) == "").alias("empty"), F.count(F.lit(1)).alias("n"))


# ---- cohort

_MAT = """WITH cnt AS MATERIALIZED (SELECT student_id, skill, count(*) AS n FROM (SELECT student_id, unnest(completed) AS code FROM studs) JOIN cse USING (code) WHERE skill IN (SELECT canonical_name FROM skills) GROUP BY 1, 2),
    mat AS MATERIALIZED (SELECT student_id, skill, n / sqrt(sum(n * n) OVER (PARTITION BY student_id)) AS w FROM cnt)"""
_CEN = _MAT + """, siz AS (SELECT cluster_id, count(*) AS size FROM labels GROUP BY 1), cen AS MATERIALIZED (SELECT cluster_id, skill, sum(w) / any_value(size) AS centroid, any_value(size) AS size FROM mat JOIN labels USING (student_id) JOIN siz USING (cluster_id) GROUP BY 1, 2)"""


def _matrix(s, d):
    vocabulary = I.skills(s, d).select(F.col("canonical_name").alias("skill"))
    return cohort.skill_matrix(I.students(s, d), I.courses(s, d), vocabulary)


@query(with_sql(_MAT + " SELECT student_id, skill, round(w, 6) AS w FROM mat"))
def c_matrix(s, d):
    return _matrix(s, d).withColumn("w", r6("w"))


@query(with_sql(_MAT + " SELECT skill, round(sum(w) / (SELECT count(*) FROM studs), 6) AS mean FROM mat GROUP BY 1"))
def agg_global_mean(s, d):
    n = I.students(s, d).agg(F.count(F.lit(1)).alias("n"))
    m = _matrix(s, d).groupBy("skill").agg(F.sum("w").alias("t"))
    return m.crossJoin(F.broadcast(n)).select("skill", r6(F.col("t") / F.col("n")).alias("mean"))  # one row


@query(with_sql(_CEN + " SELECT cluster_id, skill, round(centroid, 6) AS centroid FROM cen"))
def agg_centroid(s, d):
    return cohort.centroids(_matrix(s, d), I.labels(s, d)).select("cluster_id", "skill", r6("centroid").alias("centroid"))


_DIFF = _CEN + """, mea AS (SELECT skill, sum(w) / (SELECT count(*) FROM labels) AS mean FROM mat WHERE student_id IN (SELECT student_id FROM labels) GROUP BY 1),
    top AS (SELECT * FROM (SELECT cluster_id, skill, row_number() OVER (PARTITION BY cluster_id ORDER BY round(centroid - mean, 10) DESC, skill) AS k FROM cen JOIN mea USING (skill)) WHERE k <= 8)"""


@query(with_sql(_DIFF + " SELECT c.cluster_id, c.size, round(c.s, 6) AS centroid_strength, t.names AS top_distinguishing_skills FROM (SELECT cluster_id, any_value(size) AS size, sqrt(sum(centroid * centroid)) AS s FROM cen GROUP BY 1) c JOIN (SELECT cluster_id, string_agg(skill, ';' ORDER BY k) AS names FROM top GROUP BY 1) t USING (cluster_id)"))
def c_describe(s, d):
    """Profiles of the stored clusters."""
    return cohort.describe_clusters(_matrix(s, d), I.labels(s, d)).withColumn("centroid_strength", r6("centroid_strength"))


@query(with_sql(_DIFF + " SELECT cluster_id, skill, k AS rank FROM top"))
def topk_indices(s, d):
    rows = cohort.describe_clusters(_matrix(s, d), I.labels(s, d))
    return rows.select("cluster_id", F.posexplode(F.split("top_distinguishing_skills", ";")).alias("p", "skill")).select("cluster_id", "skill", (F.col("p") + 1).alias("rank"))


@query()
def c_kmeans(s, d):
    """K-means archetypes (k = 8, best of ten runs), with the size of each."""
    vocabulary = sorted(r[0] for r in bounded_rows(I.skills(s, d).select("canonical_name"), 100_000, "skills_canonical"))
    out = cohort.kmeans(_matrix(s, d), I.students(s, d), vocabulary)
    return out.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def _top_titles(s, d) -> list[str]:
    return [r["title"] for r in agg_value_counts(s, d).collect()]  # 80 titles at most


@query()
def gen_students(s, d):
    return cohort.generate_students(s, I.courses(s, d).select("code"), _top_titles(s, d))


@query()
def gen_courses(s, d):
    """Courses drawn for every student of the table."""
    st = I.students(s, d).select("student_id", "major_prefix", F.coalesce("year", F.lit(1)).alias("year"))
    return cohort.sample_courses(st, I.courses(s, d).select("code"))


@query()
def gen_goal(s, d):
    return I.students(s, d).select("student_id", cohort.pick_goal(F.col("student_id"), _top_titles(s, d)).alias("career_goal"))


# ---- ranking


@query(with_sql("SELECT seed, id, p FROM seeds"))
def r_pv(s, d):
    return _seeds(s, d)


def _seeds(s, d):
    r = I.requests(s, d).select("student_id", "career_goal").distinct()
    seed = graph.node_id("student", "student_id")
    return r.select(seed.alias("seed"), seed.alias("id"), F.lit(0.5).alias("p")).unionAll(r.select(seed, graph.node_id("career", "career_goal"), F.lit(0.5)))


def _scores(s, d, g):
    return ranking.pagerank(g.edges, _seeds(s, d), max_iter=ITERATIONS, tol=None)


@query(with_sql(f"SELECT seed, id, round(score, 8) AS score FROM r{ITERATIONS}"))
def r_ppr(s, d):
    """Personalized PageRank of the requests, a fixed number of rounds, all nodes."""
    return _scores(s, d, I.request_graph(s, d)).withColumn("score", F.round("score", 8))


@query(with_sql(f"SELECT seed, id, round(score, 8) AS score FROM r{ITERATIONS}"))
def r_ppr_dense(s, d):
    """The same on the small-graph path."""
    return ranking.pagerank_dense(I.request_graph(s, d).edges, _seeds(s, d), max_iter=ITERATIONS).withColumn("score", F.round("score", 8))


def _recommended(s, d):
    """The request graph and ten courses a request; a graph small enough is solved in one task per request."""
    g = I.request_graph(s, d)
    g = graph.CareerGraph(g.nodes, cut(g.edges))
    return g, cut(ranking.recommend(ranking.pagerank_dense(g.edges, _seeds(s, d), max_iter=ITERATIONS), g.edges))


@query(with_sql("SELECT seed, course, score, rank FROM recs"))
def r_recommend(s, d):
    return _recommended(s, d)[1]


@query()
def r_recommend_settled(s, d):
    """r_recommend with PageRank run until it settles (as the reference does) instead of a fixed number of rounds."""
    g = I.request_graph(s, d)
    g = graph.CareerGraph(g.nodes, cut(g.edges))
    return ranking.recommend(ranking.pagerank(g.edges, _seeds(s, d), n_nodes=g.nodes.count()), g.edges)


@query(with_sql("SELECT seed, course FROM recs WHERE rank <= 3"))
def topk(s, d):
    return _recommended(s, d)[1].where("rank <= 3").select("seed", "course")


@query(with_sql("SELECT * FROM (SELECT 'student:' || student_id AS student, skill, round(weight, 4) AS weight, row_number() OVER (PARTITION BY student_id ORDER BY round(weight, 4) DESC, skill) AS rank FROM ss) WHERE rank <= 10"))
def r_student_skills(s, d):
    return ranking.student_skills(I.whole_graph(s, d).edges)


_BR = f"""WITH rq AS (SELECT DISTINCT seed AS student, 'career:' || career_goal AS career, course FROM recs JOIN ({_GOALS}) g ON seed = 'student:' || g.student_id),
    br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student, career, course ORDER BY score DESC, skill) AS rank FROM
      (SELECT student, career, course, cs.skill, round(cs.weight, 4) AS course_weight, round(ks.weight, 4) AS career_weight, round(cs.weight * ks.weight, 4) AS score, ss.skill IS NULL AS is_gap
       FROM rq JOIN cs ON 'course:' || cs.code = course JOIN ks ON 'career:' || ks.title = career AND ks.skill = cs.skill LEFT JOIN ss ON 'student:' || ss.student_id = student AND ss.skill = cs.skill)) WHERE rank <= 5)"""


def _bridged(s, d):
    g, recs = _recommended(s, d)
    asked = I.requests(s, d).select(graph.node_id("student", "student_id").alias("seed"), graph.node_id("career", "career_goal").alias("career")).distinct()
    rq = recs.join(F.broadcast(asked), "seed").select(F.col("seed").alias("student"), "career", "course")  # ten courses a request
    return g, recs, rq, ranking.bridges(g, rq)


@query(with_sql(_BR + " SELECT student, career, course, skill, course_weight, career_weight, score, is_gap, rank FROM br"))
def r_explain(s, d):
    return _bridged(s, d)[3]


_TXT = """ SELECT r.student, r.career, r.course, CASE WHEN b.s IS NULL THEN coalesce(name, '') || ' has no overlapping skills with your career goal.' ELSE coalesce(name, '') || ' covers ' || array_to_string(b.s[1:3], ', ') || ' — all relevant to your target career.' ||
    CASE WHEN len(b.g) > 0 THEN ' In particular, you haven''t built ' || array_to_string(b.g[1:3], ', ') || ' yet.' ELSE '' END END AS text FROM rq r LEFT JOIN courses c ON r.course = 'course:' || c.code
    LEFT JOIN (SELECT student, career, course, list(skill ORDER BY rank) AS s, coalesce(list(skill ORDER BY rank) FILTER (WHERE is_gap), []) AS g FROM br GROUP BY 1, 2, 3) b USING (student, career, course)"""


@query(with_sql(_BR + _TXT))
def r_explain_text(s, d):
    g, _, rq, found = _bridged(s, d)
    return ranking.explanations(found, rq, g.of_type("course").select(F.col("id").alias("course"), "name"))


_CC = f"""WITH nn AS (SELECT title, sqrt(sum(weight * weight)) AS norm FROM ks WHERE title IN (SELECT career_goal FROM asked) GROUP BY 1),
    hit AS (SELECT title, code, sum(weight) / sqrt(any_value(len(skills))) AS dot FROM (SELECT code, skills, unnest(skills) AS skill FROM courses) JOIN ks USING (skill) WHERE title IN (SELECT title FROM nn) GROUP BY 1, 2),
    sco AS (SELECT title, code, round(coalesce(dot / norm, 0), 10) AS score FROM nn CROSS JOIN courses LEFT JOIN hit USING (title, code)),
    cos AS (SELECT * FROM (SELECT title, code, score, row_number() OVER (PARTITION BY title ORDER BY score DESC, code) AS rank FROM sco)) """


def _cosine(s, d, k=10):
    goals = I.requests(s, d).select(F.col("career_goal").alias("title")).distinct()
    ks = I.career_skills(s, d).select("title", "skill", "weight").join(F.broadcast(goals), "title", "left_semi")  # one row per profile
    return ranking.cosine_courses(I.courses(s, d), ks, top_k=k)


@query(with_sql(_CC + "SELECT title, code, score, rank FROM cos WHERE rank <= 10"))
def r_cosine(s, d):
    return _cosine(s, d)


_LISTS = f"""{_CC}, g AS (SELECT profile, student_id, career_goal FROM asked),
    lst AS MATERIALIZED (SELECT profile, 'ppr' AS method, substr(course, 8) AS code, rank FROM recs JOIN g ON seed = 'student:' || student_id
      UNION ALL SELECT profile, 'cosine', code, row_number() OVER (PARTITION BY profile ORDER BY rank) FROM cos JOIN g ON title = career_goal WHERE rank <= 50 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.student_id = g.student_id AND t.code = cos.code) QUALIFY row_number() OVER (PARTITION BY profile ORDER BY rank) <= 10),
    cov AS (SELECT l.profile, l.method, count(DISTINCT k.skill) FILTER (WHERE cse.skill IS NOT NULL) AS hit FROM (SELECT DISTINCT profile, method FROM lst) l JOIN g USING (profile) JOIN ks k ON k.title = g.career_goal
      LEFT JOIN lst x ON x.profile = l.profile AND x.method = l.method LEFT JOIN cse ON cse.code = x.code AND cse.skill = k.skill GROUP BY 1, 2),
    ned AS (SELECT profile, count(*) AS n FROM g JOIN ks ON title = career_goal GROUP BY 1),
    sets AS (SELECT code, list_distinct(skills) AS sk FROM courses),
    div AS (SELECT a.profile, a.method, avg(1 - len(list_intersect(x.sk, y.sk)) / len(list_distinct(list_concat(x.sk, y.sk)))) AS dv FROM lst a JOIN lst b ON a.profile = b.profile AND a.method = b.method AND a.rank < b.rank JOIN sets x ON x.code = a.code JOIN sets y ON y.code = b.code WHERE len(x.sk) + len(y.sk) > 0 GROUP BY 1, 2),
    met AS (SELECT l.profile, l.method, round(coalesce(hit / n, 0), 6) AS coverage, round(coalesce(dv, 0), 6) AS diversity FROM (SELECT DISTINCT profile, method FROM lst) l LEFT JOIN cov USING (profile, method) LEFT JOIN ned USING (profile) LEFT JOIN div USING (profile, method)) """


def _lists(s, d):
    """profile, method, code, rank: ten courses by PageRank and ten by cosine (of its best 50, completed ones left out)."""
    _, recs = _recommended(s, d)
    asked = cut(I.requests(s, d))
    ppr = recs.join(F.broadcast(asked.withColumn("seed", graph.node_id("student", "student_id"))), "seed").select("profile", F.lit("ppr").alias("method"), F.substring("course", 8, 1_000_000).alias("code"), "rank")
    cos = _cosine(s, d, 50).join(F.broadcast(asked.withColumnRenamed("career_goal", "title")), "title").join(I.taken(s, d), ["student_id", "code"], "left_anti")  # fifty courses a request
    best = Window.partitionBy("profile").orderBy("rank")
    cos = cos.withColumn("k", F.row_number().over(best)).where("k <= 10").select("profile", F.lit("cosine").alias("method"), "code", F.col("k").alias("rank"))
    return asked, cut(ppr.unionAll(cos))


def _metrics(s, d):
    asked, lists = _lists(s, d)
    keys = ["profile", "method"]
    need = lists.select(*keys).distinct().join(asked.select("profile", F.col("career_goal").alias("title")), "profile").join(I.career_skills(s, d), "title").select(*keys, "skill")
    pairs = I.courses(s, d).select("code", F.explode("skills").alias("skill"))
    sets = I.courses(s, d).select("code", F.array_distinct("skills").alias("skills"))
    return asked, lists, ranking.coverage(lists, pairs, need, keys).join(ranking.diversity(lists, sets, keys), keys)


@query(with_sql(_LISTS + "SELECT profile, method, coverage FROM met"))
def m_coverage(s, d):
    return _metrics(s, d)[2].select("profile", "method", r6("coverage").alias("coverage"))


@query(with_sql(_LISTS + "SELECT profile, method, diversity FROM met"))
def m_diversity(s, d):
    return _metrics(s, d)[2].select("profile", "method", r6("diversity").alias("diversity"))


@query(with_sql(_LISTS + "SELECT a.profile, a.method, count(*) AS n_pairs FROM lst a JOIN lst b ON a.profile = b.profile AND a.method = b.method AND a.rank < b.rank GROUP BY 1, 2"))
def jn_pairwise_list(s, d):
    """Pairs within a recommended list of ten."""
    _, lists = _lists(s, d)
    other = lists.select("profile", "method", F.col("rank").alias("r2"))
    return lists.join(other, ["profile", "method"]).where("rank < r2").groupBy("profile", "method").agg(F.count(F.lit(1)).alias("n_pairs"))


@query(with_sql(_LISTS + """SELECT g.profile, g.student_id, g.career_goal, p.coverage AS ppr_coverage, c.coverage AS cosine_coverage, p.diversity AS ppr_diversity, c.diversity AS cosine_diversity, x.courses AS ppr_courses, y.courses AS cosine_courses FROM g
    LEFT JOIN met p ON p.profile = g.profile AND p.method = 'ppr' LEFT JOIN met c ON c.profile = g.profile AND c.method = 'cosine'
    LEFT JOIN (SELECT profile, string_agg(code, ';' ORDER BY rank) AS courses FROM lst WHERE method = 'ppr' GROUP BY 1) x ON x.profile = g.profile LEFT JOIN (SELECT profile, string_agg(code, ';' ORDER BY rank) AS courses FROM lst WHERE method = 'cosine' GROUP BY 1) y ON y.profile = g.profile"""))
def m_cases(s, d):
    """Case studies: both methods with their metrics and courses."""
    asked, lists, met = _metrics(s, d)
    names = lists.groupBy("profile", "method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]), ";").alias("courses"))
    both = met.join(names, ["profile", "method"])
    out = asked
    for m in ("ppr", "cosine"):
        own = both.where(F.col("method") == m).select("profile", r6("coverage").alias(f"{m}_coverage"), r6("diversity").alias(f"{m}_diversity"), F.col("courses").alias(f"{m}_courses"))
        out = out.join(own, "profile", "left")
    return out


@query(with_sql(_LISTS + "SELECT method, round(avg(coverage), 6) AS coverage, round(avg(diversity), 6) AS diversity FROM met GROUP BY 1"))
def agg_avg_metrics(s, d):
    return _metrics(s, d)[2].select("method", r6("coverage").alias("c"), r6("diversity").alias("v")).groupBy("method").agg(r6(F.avg("c")).alias("coverage"), r6(F.avg("v")).alias("diversity"))


# ---- windows, sorts, report

_SK = "SELECT canonical_name AS skill, doc_frequency FROM skills"


def _freq(s, d):
    return I.skills(s, d).select(F.col("canonical_name").alias("skill"), "doc_frequency")


@query(with_sql(f"SELECT row_number() OVER w AS rank, skill, round(100 * sum(doc_frequency) OVER (w ROWS UNBOUNDED PRECEDING) / (SELECT sum(doc_frequency) FROM skills), 6) AS cum_pct FROM ({_SK}) WINDOW w AS (ORDER BY doc_frequency DESC, skill)"))
def w_cumsum(s, d):
    return report.coverage_curve(_freq(s, d))


@query(with_sql(f"SELECT row_number() OVER (ORDER BY doc_frequency DESC, skill) - 1 AS id, skill FROM ({_SK})"))
def w_row_id(s, d):
    from pathloom.operators.taxonomy import dense_rank_ids

    return dense_rank_ids(_freq(s, d), [F.desc("doc_frequency"), "skill"], "id").select("id", "skill")


@query(with_sql("SELECT student_id, skill, round(weight, 6) AS share FROM ss WHERE weight >= 0.5"))
def w_max_norm(s, d):
    return I.student_skills(s, d).where("weight >= 0.5").select("student_id", "skill", r6("weight").alias("share"))


@query("SELECT code, name FROM (SELECT code, name, row_number() OVER (PARTITION BY code ORDER BY name) AS k FROM courses_canonical WHERE code IS NOT NULL) WHERE k = 1")
def w_first_by_group(s, d):
    first = Window.partitionBy("code").orderBy(F.col("name").asc_nulls_last())
    return table(s, d, "courses_canonical").where("code is not null").withColumn("k", F.row_number().over(first)).where("k = 1").select("code", "name")


@query(with_sql(f"SELECT skill, doc_frequency FROM ({_SK}) ORDER BY doc_frequency DESC, skill"))
def srt_multi(s, d):
    return _freq(s, d).orderBy(F.desc("doc_frequency"), "skill")


_OV = """SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'courses only' ELSE 'jobs only' END AS side, count(*) AS n FROM (SELECT skill, bool_or(x) AS a, bool_or(NOT x) AS b FROM (SELECT skill, true AS x FROM cse UNION ALL SELECT skill, false FROM kse) GROUP BY 1) GROUP BY 1"""


@query(with_sql(_OV))
def set_overlap(s, d):
    return report.overlap(_exploded(I.courses(s, d)), _exploded(I.jobs(s, d).where("title is not null")))


@query(with_sql("SELECT skill, count(*) AS n FROM (SELECT skill FROM cse UNION ALL SELECT skill FROM kse) GROUP BY 1"))
def set_union_docs(s, d):
    rows = _exploded(I.courses(s, d)).unionByName(_exploded(I.jobs(s, d).where("title is not null")))
    return rows.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


_BINS = "(VALUES " + ", ".join(f"({low}, {report.BINS[i + 1][0] if i + 1 < len(report.BINS) else 2**62}, '{name}')" for i, (low, name) in enumerate(report.BINS)) + ") b(lo, hi, bin)"


@query(with_sql(f"SELECT bin, (SELECT count(*) FROM skills WHERE doc_frequency >= lo AND doc_frequency < hi) AS n FROM {_BINS}"))
def rpt_bins(s, d):
    return report.frequency_bins(_freq(s, d))


@query(rf"SELECT CASE WHEN {strip_sql('coalesce(extracted_skills, chr(32))')} = '' THEN 0 ELSE len(string_split(extracted_skills, ',')) END AS n_skills, count(*) AS n_docs FROM courses_skills GROUP BY 1")
def rpt_per_doc(s, d):
    return report.skills_per_doc(table(s, d, "courses_skills"), "extracted_skills")


@query(with_sql("SELECT canonical_name AS skill, doc_frequency, CASE WHEN canonical_name IN (SELECT skill FROM cse) AND canonical_name IN (SELECT skill FROM kse) THEN 'both' WHEN canonical_name IN (SELECT skill FROM cse) THEN 'courses only' ELSE 'jobs only' END AS source FROM skills ORDER BY doc_frequency DESC, canonical_name LIMIT 30"))
def rpt_top30(s, d):
    return _sourced(s, d).orderBy(F.desc("doc_frequency"), "skill").limit(30).select("skill", "doc_frequency", "source")


_CLEAN = "length(t) BETWEEN 3 AND 60 AND NOT regexp_matches(t, '\\*{2,}|\\|{2}|~~') AND NOT contains(t, '$') AND CASE WHEN starts_with(t, '.') THEN regexp_matches(t, '^\\.[A-Za-z]') ELSE NOT regexp_matches(t, '^[*$(\\d]') END"
_TITLES = f"SELECT arg_min(t, struct_pack(a := -length(t), b := t)) AS title FROM (SELECT DISTINCT {strip_sql('title')} AS t FROM careers) WHERE {_CLEAN} GROUP BY lower(t)"


@query(with_sql(_TITLES))
def set_dedupe_titles(s, d):
    return report.shown_titles(I.jobs(s, d).where("title is not null").select("title"))


# ---- service


@query(with_sql(_TITLES))
def api_careers(s, d):
    return report.shown_titles(graph.careers(I.jobs(s, d).where("title is not null")))


_API = _BR + ", txt AS (" + _TXT + """) SELECT seed AS student, course, round(score, 6) AS score, rank, text FROM recs JOIN txt USING (course) WHERE txt.student = seed"""


@query(with_sql(_API))
def api_recommend(s, d):
    """Courses of every request with their explanation."""
    g, recs, rq, found = _bridged(s, d)
    text = ranking.explanations(found, rq, g.of_type("course").select(F.col("id").alias("course"), "name"))
    return recs.withColumnRenamed("seed", "student").join(text, ["student", "course"]).select("student", "course", r6("score").alias("score"), "rank", "text")


@query(with_sql("SELECT a.student_id, a.career_goal, n_postings, s.n_skills, k.n_needed FROM (SELECT DISTINCT student_id, career_goal FROM asked) a JOIN careers ON title = career_goal LEFT JOIN (SELECT student_id, count(*) AS n_skills FROM ss GROUP BY 1) s USING (student_id) LEFT JOIN (SELECT title, count(*) AS n_needed FROM ks GROUP BY 1) k ON k.title = a.career_goal"))
def api_dashboard(s, d):
    """Per request: postings of the goal, skills had and needed."""
    r = I.requests(s, d).select("student_id", "career_goal").distinct()
    posts = graph.careers(I.jobs(s, d).where("title is not null")).withColumnRenamed("title", "career_goal")
    have = I.student_skills(s, d).groupBy("student_id").agg(F.count(F.lit(1)).alias("n_skills"))
    need = I.career_skills(s, d).groupBy(F.col("title").alias("career_goal")).agg(F.count(F.lit(1)).alias("n_needed"))
    return r.join(posts, "career_goal").join(have, "student_id", "left").join(need, "career_goal", "left").select("student_id", "career_goal", "n_postings", "n_skills", "n_needed")


def _prompts(s, d) -> list[tuple[str, str]]:
    """(student, prompt) of every request; all tables here hold a few rows per request."""
    g, recs, rq, found = _bridged(s, d)
    posts = {r["title"]: r["n_postings"] for r in graph.careers(I.jobs(s, d)).join(F.broadcast(I.requests(s, d).select(F.col("career_goal").alias("title")).distinct()), "title").collect()}
    rows = found.collect()
    names = {r["id"]: r["name"] for r in g.of_type("course").join(F.broadcast(rq.select(F.col("course").alias("id")).distinct()), "id").collect()}
    order = sorted(recs.collect(), key=lambda r: (r["seed"], r["rank"]))
    skills = ranking.student_skills(g.edges, top_k=10).collect()
    needs = I.career_skills(s, d).join(F.broadcast(I.requests(s, d).select(F.col("career_goal").alias("title")).distinct()), "title", "left_semi").orderBy("title", F.desc("weight"), "skill").collect()
    alike = ranking.similar_careers(g, I.requests(s, d).select(graph.node_id("career", "career_goal").alias("id")).distinct()).collect()
    out = []
    for r in I.requests(s, d).select("student_id", "career_goal").distinct().collect():
        sid, goal = f"student:{r['student_id']}", r["career_goal"]
        mine = []
        for x in (x for x in order if x["seed"] == sid):
            own = sorted((b for b in rows if b["student"] == sid and b["course"] == x["course"]), key=lambda b: b["rank"])
            mine.append({"code": x["course"][7:], "name": names.get(x["course"]) or "", "bridge_skills": [{"skill": b["skill"]} for b in own], "gap_skills": [b["skill"] for b in own if b["is_gap"]]})
        have = [{"skill": k["skill"], "weight": k["weight"]} for k in skills if k["student"] == sid]
        need = [{"skill": k["skill"], "weight": round(k["weight"], 4)} for k in needs if k["title"] == goal]
        near = [c.asDict() for c in alike if c["target"] == f"career:{goal}"]
        out.append((r["student_id"], insight_prompt({}, goal, posts.get(goal, 0), mine, have, need, near)))
    return out


@query()
def fmt_prompt(s, d):
    """The prompt of every request."""
    return s.createDataFrame(_prompts(s, d), "student_id string, prompt string")


@query(None, "llm_insight")
@query()
def api_insight(s, d):
    """Parsed insight of every request; the model is a function here that names the goal."""
    from pathloom.functions.parsing import json_insight
    from pathloom.operators.extract import insight

    def model(prompt: str) -> str:
        return '{"headline": "' + prompt.split("Target career: ")[1].split(" (")[0] + '", "strengths": "", "gaps": "", "strategy": ""}'

    rows = [(sid, insight(model, p)) for sid, p in _prompts(s, d)]
    return s.createDataFrame(rows, "student_id string, reply string").select("student_id", json_insight("reply").alias("r")).select("student_id", "r.*")


@query(with_sql("SELECT student_id, coalesce(trim(major_prefix), '') AS major, coalesce(year, 0) AS year, coalesce(n, 0) AS n_known FROM studs LEFT JOIN (SELECT student_id, count(*) AS n FROM taken GROUP BY 1) USING (student_id)"))
def api_transcript(s, d):
    """Profiles read from model replies, with how many of their courses are in the catalogue."""
    from pathloom.functions.parsing import json_transcript

    obj = F.to_json(F.struct(F.col("major_prefix").alias("major"), "year", F.col("completed").alias("completed_courses")))
    p = I.students(s, d).select("student_id", json_transcript(obj).alias("r")).select("student_id", F.col("r.major").alias("major"), F.col("r.year").alias("year"), "r.completed_courses")
    rows = p.select("student_id", F.explode("completed_courses").alias("code")).join(I.courses(s, d).select("code"), "code", "left_semi").groupBy("student_id").agg(F.count(F.lit(1)).alias("n_known"))
    return p.join(rows, "student_id", "left").select("student_id", "major", "year", F.coalesce("n_known", F.lit(0).cast("bigint")).alias("n_known"))


@query()
def api_index(s, d):
    """The start page: all titles on offer, one row."""
    return s.createDataFrame([(sinks.report_html("Careers", {"Titles": api_careers(s, d).orderBy("title")}, most=None),)], "html string")
