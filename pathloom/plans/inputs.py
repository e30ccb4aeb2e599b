"""The course tables as inputs of the graph operators, as frames and as SQL.

Lists are read the plain way of the original files: entries between semicolons, stripped, blanks
dropped.  (The packed-field operator reads the fields in all their dialects.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.strings import record_code, split_list, strip
from pathloom.operators.graph import CareerGraph, build_graph, career_skill, course_skill, student_course, student_skill
from pathloom.sources.tables import table

ITERATIONS = 20  # rounds of the PageRank queries, fixed so that SQL can follow


def _one_per(df: DataFrame, key: str) -> DataFrame:
    """Repeated rows are folded: the smallest value of every other column."""
    return df.groupBy(key).agg(*(F.min(c).alias(c) for c in df.columns if c != key))


def courses(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "courses_canonical").where("code is not null")
    one = _one_per(raw.select(record_code("code").alias("code"), "name", "units", "prerequisites_text", "description", "canonical_skills"), "code")
    return one.withColumn("skills", split_list("canonical_skills", ";"))


def jobs(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "jobs_canonical").where("job_id is not null")
    return _one_per(raw.select("job_id", strip("title").alias("title"), "canonical_skills"), "job_id").withColumn("skills", split_list("canonical_skills", ";"))


def students(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "students").where("student_id is not null")
    return _one_per(raw, "student_id").withColumn("completed", split_list("completed_courses", ";"))


def skills(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "skills_canonical").where("canonical_name is not null")
    return raw.groupBy("canonical_name").agg(F.coalesce(F.max("doc_frequency"), F.lit(0).cast("bigint")).alias("doc_frequency"))


def labels(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "students_clustered").where("student_id is not null and cluster_id is not null")
    return raw.groupBy("student_id").agg(F.min("cluster_id").alias("cluster_id"))


def course_skills(s: SparkSession, d: str) -> DataFrame:
    return course_skill(courses(s, d), jobs(s, d), skills(s, d))


def career_skills(s: SparkSession, d: str) -> DataFrame:
    return career_skill(jobs(s, d).where("title is not null"), skills(s, d))


def taken(s: SparkSession, d: str) -> DataFrame:
    return student_course(students(s, d), courses(s, d))


def student_skills(s: SparkSession, d: str) -> DataFrame:
    return student_skill(taken(s, d), course_skills(s, d))


# The case studies of these tables: the first student (by id) of each profile who has a goal that is a known title.
PROFILES = [
    ("third-year engineer", "year = 3 and major_prefix in ('SEI', 'QUA', 'KIN', 'NAV') and regexp_like(lower(career_goal), 'welder|technician|surveyor|inspector')"),
    ("second-year analyst", "year = 2 and regexp_like(lower(career_goal), 'auditor|planner|estimator|buyer')"),
    ("first-year explorer", "year = 1"),
    ("fourth-year lead", "year = 4 and regexp_like(lower(career_goal), 'lead|principal|senior|chief')"),
    ("humanities to archive", "major_prefix in ('LEX', 'DRA', 'PED', 'TEX', 'JUD') and regexp_like(lower(career_goal), 'librarian|translator|archivist|illustrator')"),
]


def requests(s: SparkSession, d: str) -> DataFrame:
    """profile, student_id, career_goal."""
    titles = jobs(s, d).where("title is not null").select(F.col("title").alias("career_goal")).distinct()
    known = students(s, d).join(titles, "career_goal", "left_semi")
    out = None
    for name, condition in PROFILES:
        first = known.where(condition).agg(F.min_by(F.struct("student_id", "career_goal"), "student_id").alias("r")).where("r is not null")
        part = first.select(F.lit(name).alias("profile"), "r.student_id", "r.career_goal")
        out = part if out is None else out.unionAll(part)
    return out


def request_graph(s: SparkSession, d: str) -> CareerGraph:
    """The graph with the requesting students only: nobody points at a student, so the others take no part in a ranking."""
    asked = students(s, d).join(F.broadcast(requests(s, d).select("student_id").distinct()), "student_id", "left_semi")  # one row per profile
    return build_graph(courses(s, d), jobs(s, d), asked, skills(s, d))


def whole_graph(s: SparkSession, d: str) -> CareerGraph:
    return build_graph(courses(s, d), jobs(s, d), students(s, d), skills(s, d))


# ---- the same in SQL


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def split_sql(x: str, sep: str = ";") -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '{sep}'), lambda v: {strip_sql('v')}), lambda v: v <> '')"


_PREREQ = r"list_distinct(list_transform(regexp_extract_all(coalesce(prerequisites_text, ''), '(?i)\b([A-Z]{2,5}\s*[0-9]{3,4})\b', 1), lambda v: upper(regexp_replace(v, '\s', '', 'g'))))"
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS profile, min(student_id) AS student_id FROM known WHERE {condition.replace('regexp_like', 'regexp_matches')}" for name, condition in PROFILES
)
PARTS: dict[str, str] = {
    "courses": f"SELECT *, {split_sql('canonical_skills')} AS skills FROM (SELECT upper({strip_sql('code')}) AS code, min(name) AS name, min(units) AS units, min(prerequisites_text) AS prerequisites_text, min(description) AS description, min(canonical_skills) AS canonical_skills FROM courses_canonical WHERE code IS NOT NULL GROUP BY 1)",
    "jobs": f"SELECT *, {split_sql('canonical_skills')} AS skills FROM (SELECT job_id, min({strip_sql('title')}) AS title, min(canonical_skills) AS canonical_skills FROM jobs_canonical WHERE job_id IS NOT NULL GROUP BY 1)",
    "studs": f"SELECT *, {split_sql('completed_courses')} AS completed FROM (SELECT student_id, min(major_prefix) AS major_prefix, min(year) AS year, min(completed_courses) AS completed_courses, min(career_goal) AS career_goal FROM students WHERE student_id IS NOT NULL GROUP BY 1)",
    "skills": "SELECT canonical_name, coalesce(max(doc_frequency), 0) AS doc_frequency FROM skills_canonical WHERE canonical_name IS NOT NULL GROUP BY 1",
    "labels": "SELECT student_id, min(cluster_id) AS cluster_id FROM students_clustered WHERE student_id IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1",
    "ndocs": "SELECT (SELECT count(*) FROM courses) + (SELECT count(*) FROM jobs) AS n",
    "idf": "SELECT canonical_name AS skill, ln(n / greatest(1, doc_frequency)) AS idf FROM skills, ndocs",
    "cse": "SELECT code, unnest(skills) AS skill FROM courses",
    "cs": "SELECT DISTINCT code, skill, idf / sqrt(count(*) OVER (PARTITION BY code)) AS weight FROM cse JOIN idf USING (skill)",
    "kse": "SELECT title, unnest(skills) AS skill FROM jobs WHERE title IS NOT NULL",
    "ksc": "SELECT title, skill, count(*) AS c FROM kse WHERE skill IN (SELECT canonical_name FROM skills) GROUP BY 1, 2",
    "ks": "SELECT title, skill, c, c / sum(c) OVER (PARTITION BY title) AS weight FROM ksc",
    "careers": "SELECT title, count(*) AS n_postings FROM jobs WHERE title IS NOT NULL GROUP BY 1",
    "taken": "SELECT student_id, code FROM (SELECT student_id, unnest(completed) AS code FROM studs) WHERE code IN (SELECT code FROM courses)",
    "sss": "SELECT student_id, skill, sum(weight) AS w FROM taken JOIN cs USING (code) GROUP BY 1, 2",
    "ss": "SELECT student_id, skill, CASE WHEN max(w) OVER (PARTITION BY student_id) > 0 THEN w / max(w) OVER (PARTITION BY student_id) ELSE w END AS weight FROM sss",
    "pre": f"SELECT DISTINCT prereq, code FROM (SELECT code, unnest({_PREREQ}) AS prereq FROM courses) WHERE prereq IN (SELECT code FROM courses)",
    "known": "SELECT * FROM studs WHERE career_goal IN (SELECT title FROM careers)",
    "asked": f"SELECT profile, a.student_id, career_goal FROM ({_PROFILE_SQL}) a JOIN known USING (student_id)",
    "nodes": "SELECT 'skill:' || canonical_name AS id, 'skill' AS type FROM skills UNION ALL SELECT 'course:' || code, 'course' FROM courses UNION ALL SELECT 'career:' || title, 'career' FROM careers UNION ALL SELECT 'student:' || student_id, 'student' FROM studs",
    "edges": """SELECT 'course:' || code AS src, 'skill:' || skill AS dst, weight, 'course-skill' AS edge_type FROM cs
        UNION ALL SELECT 'skill:' || skill, 'course:' || code, weight, 'skill-course' FROM cs
        UNION ALL SELECT 'career:' || title, 'skill:' || skill, weight, 'career-skill' FROM ks
        UNION ALL SELECT 'skill:' || skill, 'career:' || title, weight, 'skill-career' FROM ks
        UNION ALL SELECT DISTINCT 'student:' || student_id, 'course:' || code, 1.0::DOUBLE, 'student-course' FROM taken
        UNION ALL SELECT 'student:' || student_id, 'skill:' || skill, weight, 'student-skill' FROM ss
        UNION ALL SELECT 'course:' || prereq, 'course:' || code, 0.5::DOUBLE, 'prereq' FROM pre""",
    "redges": "SELECT * FROM edges WHERE src NOT LIKE 'student:%' OR src IN (SELECT 'student:' || student_id FROM asked)",
    "trans": "SELECT src, dst, weight / total AS t FROM (SELECT *, sum(weight) OVER (PARTITION BY src) AS total FROM redges WHERE weight <> 0) WHERE total <> 0",
    "seeds": "SELECT 'student:' || student_id AS seed, 'student:' || student_id AS id, 0.5::DOUBLE AS p FROM (SELECT DISTINCT student_id, career_goal FROM asked) UNION ALL SELECT 'student:' || student_id, 'career:' || career_goal, 0.5::DOUBLE FROM (SELECT DISTINCT student_id, career_goal FROM asked)",
    "r0": "SELECT seed, id, p AS score FROM seeds",
}
for _k in range(1, ITERATIONS + 1):
    PARTS[f"r{_k}"] = f"""SELECT seed, id, sum(m) AS score FROM (
        SELECT r.seed, t.dst AS id, 0.85::DOUBLE * sum(r.score * t.t) AS m FROM r{_k - 1} r JOIN trans t ON r.id = t.src GROUP BY 1, 2
        UNION ALL SELECT s.seed, s.id, 0.85::DOUBLE * coalesce(d.d, 0) * s.p + (1 - 0.85::DOUBLE) * s.p FROM seeds s
        LEFT JOIN (SELECT seed, sum(score) AS d FROM r{_k - 1} WHERE id NOT IN (SELECT src FROM trans) GROUP BY 1) d USING (seed)) GROUP BY 1, 2"""
PARTS["recs0"] = f"""SELECT seed, id AS course, round(score, 10) AS score FROM r{ITERATIONS} WHERE id LIKE 'course:%'
    AND NOT EXISTS (SELECT 1 FROM redges e WHERE e.edge_type = 'student-course' AND e.src = seed AND e.dst = id)"""
PARTS["recs"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, course) AS rank FROM recs0) WHERE rank <= 10"


def with_sql(body: str) -> str:
    """The body with those parts in front of it that it uses, directly or through others."""
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(PARTS[name])

    visit(body)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in PARTS if n in need)
    if not parts:
        return body
    return f"WITH {parts}, {body[5:]}" if body.startswith("WITH ") else f"WITH {parts}\n{body}"
