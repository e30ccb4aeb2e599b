"""Literal expectations of the text, taxonomy, resolution, graph and ranking operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import parsing, skills
from pathloom.operators import cohort, extract, graph, ranking, report, resolve, sessions, taxonomy
from pathloom.runtime import split_group_rank
from pathloom.sources import files, sinks
from pathloom.streaming.trends import skill_trend


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


@pytest.mark.parametrize("raw, out", [("  ml ", "Machine Learning"), ("nlp", "Natural Language Processing"), ("nlp engineer", "NLP Engineer"), ("PostgreSQL", "Postgresql"), ("sql", "SQL"), ("c", ""), (None, ""), ("machine   learning", "Machine Learning")])
def test_normalize(spark, raw, out):
    assert one(spark, raw, skills.normalize_skill("x")) == out


@pytest.mark.parametrize("skill, out", [("Python", "Programming Languages"), ("Golang", "Other"), ("Organic Farming", "ML & AI"), ("Digital Art", "Tools & Platforms"), ("C#", "Programming Languages"), ("R", "Programming Languages"), ("Deep Learning", "ML & AI")])
def test_categorize(spark, skill, out):
    assert one(spark, skill, skills.categorize("x")) == out


@pytest.mark.parametrize("s, n", [("abc", 1), ("ab", 1), ("", 0), ("abcd", 2), ("aaaa", 1)])
def test_shingles(spark, s, n):
    assert len(one(spark, s, skills.shingles("x"))) == n


@pytest.mark.parametrize("t, ok", [(".NET Developer", True), (".5 job", False), ("**Nurse**", False), ("$20 clerk", False), ("1st Cook", False), ("Data Engineer", True), ("ab", False), ("x" * 61, False), ("a||b", False)])
def test_titles(spark, t, ok):
    assert one(spark, t, skills.clean_title("x")) is ok


@pytest.mark.parametrize("text, out", [("COMP1003 and (stat 201 OR comp1003)", ["COMP1003", "STAT201"]), ("Year 3 standing", []), (None, []), ("comp1003", ["COMP1003"])])
def test_prerequisites(spark, text, out):
    assert one(spark, text, parsing.prerequisites("x")) == out


def test_json_replies(spark):
    assert one(spark, 'ok ```["Python", null, 42, " SQL "]```', parsing.json_strings("x")) == ["Python", "SQL"]
    assert one(spark, "nothing", parsing.json_strings("x")) == []
    assert one(spark, None, parsing.json_strings("x")) == []
    r = one(spark, 'x {"major": "CS", "year": 3, "gpa": "3.6", "completed_courses": ["A1", 2, ""]} y', parsing.json_transcript("x"))
    assert (r["major"], r["year"], r["gpa"], r["completed_courses"], r["current_courses"]) == ("CS", 3, None, ["A1"], [])
    assert one(spark, '{"gpa": 3.5}', parsing.json_transcript("x"))["gpa"] == 3.5
    assert tuple(one(spark, "broken", parsing.json_insight("x"))) == ("", "", "", "")


CATALOG = """Index
ACCT2003 Principles of Accounting (3 units)
Pre-requisite(s): None
Course Description: Covers accounts.
AI2003 Wrapped
Name of Course (3 units)
Pre-requisite(s)：COMP1003
see
COMP1003 for more
Course Description: Learn.
AI2003 Again (2 units)
Course Description: Second.
COMP4000 Open End (1 unit)
Pre-requisite(s): AI2003
"""


def test_catalog(spark):
    df = spark.createDataFrame([("p", CATALOG), ("q", None), ("r", "")], "id string, t string")
    assert parsing.course_blocks(df, "t", "id").count() == 4
    got = {r["code"]: r for r in parsing.catalog(df, "t", "id").collect()}
    assert set(got) == {"ACCT2003", "AI2003", "COMP4000"}
    assert got["COMP4000"]["prerequisites_text"] == "AI2003" and got["COMP4000"]["description"] == ""
    assert got["AI2003"]["name"] == "Wrapped Name of Course" and "COMP1003 for more" in got["AI2003"]["prerequisites_text"]
    assert got["ACCT2003"]["units"] == 3 and got["ACCT2003"]["description"] == "Covers accounts."


def test_taxonomy(spark):
    docs = spark.createDataFrame([(1, ["python", "Python", "SQL"]), (2, ["py"]), (3, []), (4, ["sql", "python programming"])], "d int, s array<string>")
    got = [tuple(r) for r in taxonomy.taxonomy(docs, "d", "s").orderBy("skill_id").collect()]
    assert got == [("skill_0000", "Python", 3), ("skill_0001", "SQL", 2)]
    assert taxonomy.taxonomy(docs.where("false"), "d", "s").columns == ["skill_id", "skill", "doc_frequency"]
    clusters = spark.createDataFrame([(0, "Office"), (0, "MS Office"), (1, "Rare")], "cluster_id int, variant string")
    freqs = spark.createDataFrame([("Office", 60), ("MS Office", 40), ("Rare", 1)], "skill string, doc_frequency int")
    r = taxonomy.canonical_taxonomy(clusters, freqs).collect()
    assert [(x["canonical_name"], x["doc_frequency"], x["variants"]) for x in r] == [("Office", 100, ["MS Office", "Office"])]


def test_remap_keeps_order_and_case(spark):
    docs = spark.createDataFrame([(1, ["B", "a", "A", "B"]), (2, [])], "d int, s array<string>")
    mapping = spark.createDataFrame([("A", "X"), ("B", "Y")], "variant string, canonical_name string")
    got = {r[0]: r[1] for r in taxonomy.remap(docs, "d", "s", mapping, mapping).collect()}
    assert got == {1: ["Y", "X"], 2: []}


OFFICE = ["Microsoft Office", "Microsoft Office Suite", "Microsoft Office 365", "SQL", "NLP", "", "   ", "Sales Management", "Risk Management", "Time Management"]


@pytest.mark.parametrize("approximate", [False, True])
def test_clusters(spark, approximate):
    df = spark.createDataFrame(list(enumerate([*OFFICE, "SQL"])), "ord int, name string")
    got = resolve.cluster_skills(df, "name", "ord", approximate=approximate).collect()
    by = {}
    for r in got:
        by.setdefault(r["cluster_id"], set()).add(r["name"])
    assert {"Microsoft Office", "Microsoft Office Suite", "Microsoft Office 365"} in by.values()
    assert {"SQL"} in by.values() and {"NLP"} in by.values()
    assert sum(len(v) for v in by.values()) == 8 and len(got) == 8  # blank names vanish, every other is in one cluster
    assert sorted(by) == list(range(len(by)))


def test_joins_by_name_make_no_shingles(spark):
    """The test for empty keys is repeated on both sides of a join by name, so it must not hold the shingles."""
    names = spark.createDataFrame([("Welding", 1), ("weldings", 2), ("--", 3), (None, 4), ("ä", 5), ("é c", 6)], "name string, ord int")
    given = resolve.cut(resolve.shingled(names))
    assert {r["name"]: len(r["sh"]) for r in given.collect()} == {"Welding": 5, "weldings": 6, "é c": 1}
    other = spark.createDataFrame([("Welding",)], "y string")
    plan = other.join(given.select("name"), F.col("y") == F.col("name"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "regexp_replace" not in plan


def test_shingles_work_out_the_text_once(spark):
    plan = spark.createDataFrame([("x",)], "name string").select(skills.shingles(skills.name_key("name")).alias("sh"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9+#\\s]") == 1


def test_minhash_has_a_function_of_its_own_per_seed(spark):
    """Signatures are the minima of Spark's hashes under 128 different seeds; candidates agree on all of a band."""
    names = spark.createDataFrame([("welding", 1), ("weldings", 2), ("welding of pipes", 3), ("pipe welding", 4), ("c", 5), ("rust proofing", 6), ("rust proof", 7)], "name string, ord int")
    given = resolve.shingled(names)
    hashes = given.select("name", F.explode("sh").alias("x")).select("name", *(F.xxhash64("x", F.lit(42000 + i)).alias(f"h{i}") for i in range(128)))
    want = {r["name"]: list(r)[1:] for r in hashes.groupBy("name").agg(*(F.min(f"h{i}") for i in range(128))).collect()}
    assert len(set(want["weldings"])) == 128
    signed = resolve.minhash(given)
    assert {r["name"]: r["signature"] for r in signed.collect()} == want
    near = {(a, b) for a in want for b in want if a < b and any(want[a][i : i + 4] == want[b][i : i + 4] for i in range(0, 128, 4))}
    got = [tuple(r) for r in resolve.lsh_candidates(signed.unionAll(signed)).collect()]
    assert len(got) == len(set(got)) and set(got) == near and ("welding", "weldings") in near
    none = resolve.minhash(spark.createDataFrame([("x", []), ("y", ["abc"])], "name string, sh array<string>"), num_perm=2)
    assert {r["name"]: r["signature"][0] is None for r in none.collect()} == {"x": True, "y": False}


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(n - 1)], "a string, b string")
    v = spark.createDataFrame([(f"{i:02d}",) for i in range(n)] + [("lone",)], "name string")
    assert {tuple(r) for r in resolve.components(v, edges).collect()} == {(f"{i:02d}", "00") for i in range(n)} | {("lone", "lone")}


def toy(spark):
    courses = spark.createDataFrame([("COMP1003", "Intro", "", ["Python", "SQL"]), ("COMP3003", "ML", "COMP1003 or none", ["Python", "ML", "Gone"])], "code string, name string, prerequisites_text string, skills array<string>")
    jobs = spark.createDataFrame([("Data Engineer", ["SQL", "Python"]), ("Data Scientist", ["ML", "Python", "Python"]), ("Orphan", ["Gone"])], "title string, skills array<string>")
    students = spark.createDataFrame([("S1", None, "Data Scientist", ["COMP1003", "NONE"])], "student_id string, year int, career_goal string, completed array<string>")
    sk = spark.createDataFrame([("Python", 10), ("SQL", 2), ("ML", 1)], "canonical_name string, doc_frequency int")
    return courses, jobs, students, sk


def test_graph(spark):
    g = graph.build_graph(*toy(spark))
    e = {(r["src"], r["dst"]): (r["weight"], r["edge_type"]) for r in g.edges.collect()}
    assert e["course:COMP1003", "skill:Python"][0] == pytest.approx(math.log(5 / 10) / math.sqrt(2))  # negative: counted more often than there are documents
    assert e["career:Data Scientist", "skill:Python"] == (pytest.approx(2 / 3), "career-skill")
    assert e["course:COMP1003", "course:COMP3003"] == (0.5, "prereq")
    assert e["student:S1", "skill:SQL"][0] == pytest.approx(1.0)
    assert ("student:S1", "course:NONE") not in e
    n = {r["id"]: r for r in g.nodes.collect()}
    assert n["career:Orphan"]["n_postings"] == 1 and n["student:S1"]["year"] == 0
    stats = {r["metric"]: r["value"] for r in graph.graph_stats(g).collect()}
    assert stats["nodes:skill"] == 3 and stats["n_weakly_connected_components"] == 2 and stats["is_weakly_connected"] == 0
    h = graph.transient_student(spark, g, ["COMP3003", "NONE"], student_id="T")
    assert h.edges.where("src = 'student:T'").count() == 3 and g.edges.where("src = 'student:T'").count() == 0
    with pytest.raises(ValueError):
        graph.transient_student(spark, g, [], student_id="S1")


def dense(edges, seeds, rounds, alpha=0.85):
    ids = sorted({x for s, d, _ in edges for x in (s, d)} | set(seeds))
    at = {x: i for i, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for s, d, x in edges:
        w[at[s], at[d]] += x
    t = w.sum(1)
    p = np.zeros(len(ids))
    for k, v in seeds.items():
        p[at[k]] = v
    r = p.copy()
    for _ in range(rounds):
        r = alpha * ((r / np.where(t == 0, 1, t) * (t != 0)) @ w + r[t == 0].sum() * p) + (1 - alpha) * p
    return dict(zip(ids, r))


def test_pagerank_against_numpy(spark):
    rng = np.random.default_rng(3)
    edges = [(f"n{a}", f"n{b}", float(x)) for a, b, x in zip(rng.integers(0, 30, 90), rng.integers(0, 40, 90), rng.random(90))]
    merged = {}
    for s, d, x in edges:
        merged[s, d] = merged.get((s, d), 0) + x
    edges = [(s, d, x) for (s, d), x in merged.items()]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    seeds = {"a": {"n1": 0.5, "n2": 0.5}, "b": {"n35": 1.0}, "c": {"new": 1.0}}
    sd = spark.createDataFrame([(k, i, p) for k, v in seeds.items() for i, p in v.items()], "seed string, id string, p double")
    for found in (ranking.pagerank(df, sd, max_iter=12, tol=None), ranking.pagerank_dense(df, sd, max_iter=12)):
        got = {(r["seed"], r["id"]): r["score"] for r in found.collect()}
        for k, v in seeds.items():
            want = dense(edges, v, 12)
            assert all(abs(got.get((k, i), 0.0) - x) < 1e-9 for i, x in want.items())
    ends = ranking.pagerank(df, sd, tol=1e-9)
    total = {r["seed"]: r["t"] for r in ends.groupBy("seed").agg(F.sum("score").alias("t")).collect()}
    assert all(abs(x - 1) < 1e-6 for x in total.values())


def test_recommend_and_explain(spark):
    g = graph.build_graph(*toy(spark))
    pv = ranking.personalization(spark, g, "student:S1", "career:Data Scientist")
    assert sorted((r["id"], r["p"]) for r in pv.collect()) == [("career:Data Scientist", 0.5), ("student:S1", 0.5)]
    with pytest.raises(ValueError):
        ranking.personalization(spark, g, "student:S9")
    scores = ranking.pagerank(g.edges.where("weight > 0"), pv, max_iter=20, tol=None)
    assert [r["course"] for r in ranking.recommend(scores, g.edges).collect()] == ["course:COMP3003"]
    rq = spark.createDataFrame([("student:S1", "career:Data Scientist", "course:COMP3003")], "student string, career string, course string")
    found = ranking.bridges(g, rq)
    assert [(r["skill"], r["is_gap"]) for r in found.orderBy("rank").collect()][0] == ("ML", True)
    text = ranking.explanations(found, rq, spark.createDataFrame([("course:COMP3003", "ML")], "course string, name string")).first()["text"]
    assert text.startswith("ML covers ML") and "you haven't built ML yet" in text


def test_cosine_and_metrics(spark):
    courses = spark.createDataFrame([("A", ["x"]), ("B", ["x", "y"]), ("C", [])], "code string, skills array<string>")
    need = spark.createDataFrame([("t", "x", 0.5), ("t", "y", 0.5)], "title string, skill string, weight double")
    assert [r["code"] for r in ranking.cosine_courses(courses, need).orderBy("rank").collect()] == ["B", "A", "C"]
    lists = spark.createDataFrame([("p", "A", 1), ("p", "B", 2), ("q", "C", 1)], "k string, code string, rank int")
    pairs = courses.select("code", F.explode("skills").alias("skill"))
    needed = spark.createDataFrame([("p", "x"), ("p", "z")], "k string, skill string")
    assert {r["k"]: r["coverage"] for r in ranking.coverage(lists, pairs, needed, ["k"]).collect()} == {"p": 0.5, "q": 0.0}
    assert {r["k"]: r["diversity"] for r in ranking.diversity(lists, courses, ["k"]).collect()} == {"p": 0.5, "q": 0.0}


def test_sessions(spark):
    rows = [("A", 1, "t", 3, None, "u", "p", "Mon", "R1", "x"), ("A", 2, None, None, "r", "u", "p", "Tue", "R1", ""), ("A", 3, "z", 3, None, None, None, "Mon", None, "y")]
    df = spark.createDataFrame(rows, "course_code string, ord int, title_session string, units int, requirements string, offering_unit string, offering_programme string, schedule string, classroom string, teacher string")
    r = sessions.collapse_sessions(df).first()
    assert (r["title_session"], r["requirements"], r["schedules"], r["classrooms"], r["teachers"]) == ("t", "r", ["Mon", "Tue"], ["R1"], ["x", "y"])
    cat = spark.createDataFrame([("A", "n"), ("B", "m")], "code string, name string")
    got = {x["code"]: x["is_offered_current_sem"] for x in sessions.course_master(cat, sessions.collapse_sessions(df)).collect()}
    assert got == {"A": True, "B": False}


def test_cohort(spark):
    students = spark.createDataFrame([("s1", ["A", "B", "A"]), ("s2", []), ("s3", ["B"])], "student_id string, completed array<string>")
    courses = spark.createDataFrame([("A", ["x"]), ("B", ["y", "out"])], "code string, skills array<string>")
    vocab = spark.createDataFrame([("x",), ("y",)], "skill string")
    m = cohort.skill_matrix(students, courses, vocab)
    got = {(r["student_id"], r["skill"]): r["w"] for r in m.collect()}
    assert got == {("s1", "x"): pytest.approx(2 / math.sqrt(5)), ("s1", "y"): pytest.approx(1 / math.sqrt(5)), ("s3", "y"): 1.0}
    labels = spark.createDataFrame([("s1", 0), ("s2", 1), ("s3", 1)], "student_id string, cluster_id int")
    d = {r["cluster_id"]: r for r in cohort.describe_clusters(m, labels, top_n=1).collect()}
    assert d[0]["top_distinguishing_skills"] == "x" and d[1]["size"] == 2
    k = cohort.kmeans(m, students, ["x", "y"], k=2, tries=2).collect()
    assert len(k) == 3
    a = cohort.generate_students(spark, spark.createDataFrame([(f"COMP{y}00{i}",) for y in range(1, 5) for i in range(10)], "code string"), ["Nurse", "Cook"], n=50)
    assert a.count() == 50 and sorted(map(tuple, a.collect())) == sorted(map(tuple, a.collect())) and a.where("year not between 1 and 4").count() == 0


def test_report(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2000), ("d", 0)], "skill string, doc_frequency int")
    bins = {r["bin"]: r["n"] for r in report.frequency_bins(f).collect()}
    assert bins["1x"] == 1 and bins["2x"] == 1 and bins["1001+"] == 1 and bins["3-5x"] == 0
    curve = report.coverage_curve(f).orderBy("rank").collect()
    assert [r["skill"] for r in curve] == ["c", "b", "a", "d"] and curve[-1]["cum_pct"] == 100
    t = spark.createDataFrame([(" nurse ",), ("Nurse",), ("NURSE II",)], "title string")
    assert {r[0] for r in report.shown_titles(t).collect()} == {"Nurse", "NURSE II"}
    v = spark.createDataFrame([("warehouse stock control",), ("stock control of warehouse",), ("warehouse stock lead",), ("other",)], "s string")
    assert [r["size"] for r in resolve.variant_groups(v, "s").collect()] == [3]


def test_extract(spark):
    docs = spark.createDataFrame([(1, "We use Python and SQL every day."), (2, "short"), (3, None), (4, "We use Python and SQL every day.")], "d int, t string")
    calls = extract.keyword_extractor(["SQL", "Python", "C"])
    out, cache = extract.extract_skills(docs, "d", "t", calls)
    assert {r["d"]: r["skills"] for r in out.collect()} == {1: ["SQL", "Python"], 2: [], 3: [], 4: ["SQL", "Python"]}
    assert cache.count() == 1

    def broken(text):
        raise RuntimeError

    out, cache = extract.extract_skills(docs, "d", "t", broken)
    assert cache.first()["skills"] == []  # failures are remembered
    assert extract.extract_skills(docs, "d", "t", broken, cache_failures=False)[1].count() == 0
    prompt = extract.insight_prompt({"year": 3}, "Nurse", 5, [{"code": "A", "name": "n", "bridge_skills": [{"skill": str(i)} for i in range(9)], "gap_skills": list("pqrs")}], [], [], [])
    assert "covers: 0, 1, 2, 3 gaps: p, q, r" in prompt and "Year 3" in prompt and extract.year_text(5, "zh") == "研究生"
    assert extract.insight(lambda p: 1 / 0, prompt) == ""
    assert extract.transcript_prompt("  ") is None and len(extract.transcript_prompt("x" * 50_000)) < 21_000
    assert [extract.check_upload(*a) for a in ((None, b"x"), ("a.pdf", b""), ("a.txt", b"x"), ("a.PDF", b"x"))] == [400, 400, 415, 200]


def test_files(spark, tmp_path):
    import zipfile

    csv = tmp_path / "postings.csv"
    csv.write_text('job_id,title,description,location,normalized_salary,formatted_experience_level,listed_time,extra\n1,A,"two\nlines, ""quoted""",X,10.5,Mid,1700000000000,z\n,B,,,,,,\n3,C,,,,,,\n')
    got = {r["job_id"]: r for r in files.read_postings(spark, str(csv)).collect()}
    assert set(got) == {"1", "3"} and got["3"]["description"] == "" and got["1"]["description"] == 'two\nlines, "quoted"' and got["1"]["normalized_salary"] == 10.5
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.write(csv, "postings.csv")
    path = files.ensure_extracted(str(z), str(tmp_path / "out"))
    assert open(path).read() == csv.read_text() and files.ensure_extracted(str(z), str(tmp_path / "out")) == path
    t = tmp_path / "t.csv"
    t.write_text("Timetable\nCourse Code,Course Title & Session,Units,Unknown\n A1 ,One,3,x\n,Two,3,y\n")
    assert [tuple(r) for r in files.read_timetable(spark, str(t)).collect()] == [("A1", "One", "3")]
    c = tmp_path / "catalog.txt"
    c.write_text(CATALOG)
    assert files.read_catalog(spark, str(c)).count() == 3
    assert files.read_catalog(spark, str(c), lambda b: b.decode()).count() == 3
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, " ")], "id int, p int, t string")
    assert files.join_pages(pages, "id", "p", "t").first()["text"] == "a\n\nb"


def test_cache_and_sinks(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.read_cache(spark, path).count() == 0
    for new in ([("k", ["a"])], [("k", ["b"]), ("l", ["c"])]):
        sinks.flush_cache(spark, spark.createDataFrame(new, "key string, skills array<string>"), path)
    assert {r["key"]: r["skills"] for r in files.read_cache(spark, path).collect()} == {"k": ["a"], "l": ["c"]}
    df = spark.createDataFrame([(["a", "b"], 1), (None, 2)], "l array<string>, i int")
    assert [r["l"] for r in sinks.flatten_lists(df).orderBy("i").collect()] == ["a;b", ""]
    assert "## p" in sinks.case_markdown([{"profile": "p", "student_id": "s", "career_goal": "g", "x": 1}])
    assert "<table" in sinks.report_html("r", {"t": df.select("i")})


def test_a_page_cuts_neither_rows_nor_cells(spark):
    rows = [(i, f"{i}-" + "x" * 60) for i in range(150)]
    page = sinks.report_html("r", {"t": spark.createDataFrame(rows, "i int, v string").orderBy("i")}, most=None)
    assert [v in page for _, v in rows] == [True] * 150


def test_split_group_rank(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 g", "id div 100 part", "id % 5 w")
    df = df.union(spark.createDataFrame([(5000, None, 0, 1)], "id bigint, g bigint, part bigint, w bigint"))
    got = {r["id"]: (r["g"], r["rank"]) for r in split_group_rank(df, ["g"], ["id"], "part", 10).collect()}
    assert all(got[i] == (i % 3, i // 3) for i in range(1000)) and got[5000] == (None, 0)


def test_trend_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01", ["a", "b"]), ("2024-01-20", ["a"]), ("2024-03-01", ["a"])], "d string, s array<string>").selectExpr("cast(d as timestamp) t", "s").write.parquet(src)
    batch = {(str(r["start"]), r["skill"]): r["n"] for r in skill_trend(spark.read.parquet(src), time="t", skills="s").collect()}
    stream = spark.readStream.schema("t timestamp, s array<string>").parquet(src)
    q = skill_trend(stream, time="t", skills="s").writeStream.format("memory").queryName("trend").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r["start"]), r["skill"]): r["n"] for r in spark.table("trend").collect()} == batch


@pytest.mark.parametrize("threshold", [0.55, 0.8, 1.0])
def test_similar_sets_by_any_keys(spark, threshold):
    """The number of terms in a key moves cost only: every number gives all pairs, as brute force does."""
    import itertools
    import random

    from pathloom.operators.overlap import KeyPlan, choose_key_terms, encoded, prefix_pairs, term_ranks

    random.seed(11)
    base = [{random.randrange(60) for _ in range(random.choice((1, 2, 3, 5, 9, 14, 30)))} for _ in range(40)]
    sets = {f"s{i}": (random.choice(base) ^ {random.randrange(60) for _ in range(random.randrange(3))}) or {0} for i in range(120)}
    rows = spark.createDataFrame([(k, f"t{x}") for k, v in sets.items() for x in v] + [(None, "t1"), ("n", None)], "cls string, val string")
    coded = encoded(rows, term_ranks(rows), "cls").cache()
    assert 1 <= choose_key_terms(coded, coded, threshold) <= 3 and choose_key_terms(coded.where("false"), coded, threshold) == 1
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-9}
    for terms in (None, 1, 2, 3):
        assert {(r["l_cls"], r["r_cls"]) for r in prefix_pairs(coded, coded, threshold, below=True, most_terms=terms).collect()} == want
    assert KeyPlan(threshold).numbers(5000) and prefix_pairs(coded.where("false"), coded, threshold).count() == 0


def test_terms_read_alike_are_one(spark):
    from pyspark.sql import functions as F

    from pathloom.operators.overlap import encoded, term_ranks

    rows = spark.createDataFrame([(1, "A b"), (1, "a B"), (2, "c")], "rec int, val string")
    got = {r["rec"]: len(r["terms"]) for r in encoded(rows, term_ranks(rows, key=F.lower), "rec").collect()}
    assert got == {1: 1, 2: 1}


def test_courses_are_drawn_without_a_look_at_the_whole_catalogue(spark):
    """Counts are those of year and major, all courses of a kind are as likely, and no student meets every course."""
    courses = spark.createDataFrame([(f"{m}{y}{i:03d}",) for m in ("AB", "ABC", "X") for y in (1, 2, 3) for i in range(10)] + [(None,), ("X0001",)], "code string")
    students = spark.range(3000).selectExpr("format_string('s%05d', id) student_id", "'AB' major_prefix", "2 year").unionAll(spark.sql("select 'none', null, 2 union all select 'new', 'X', null union all select 'far', 'Z', 900 union all select 'pre', 'X', 0"))
    drawn = cohort.sample_courses(students, courses)
    assert "Join" not in drawn._jdf.queryExecution().executedPlan().toString()
    got = {r[0]: r[1] for r in drawn.collect()}
    assert len(got) == 3004 and got["none"] == got["new"] == got["pre"] == []
    assert got["far"] == sorted(r[0] for r in courses.where("code is not null").collect())
    rows = [v for k, v in got.items() if k[0] == "s"]
    assert all(v == sorted(set(v)) and all(c.lstrip("ABCX")[0] in "12" for c in v) for v in rows)
    assert all(sum(c.startswith("AB") for c in v) == math.floor(len(v) * 0.7) for v in rows)  # ABC counts as AB, too
    assert {len(v) for v in rows} > {12, 13, 14, 15}
    for prefix, n in (("AB", 40), ("X", 20)):
        times = [sum(c in v for v in rows) for c in {c for v in rows for c in v if c.startswith(prefix)}]
        mean = sum(times) / n
        assert len(times) == n and max(abs(x - mean) for x in times) < 5 * math.sqrt(mean)


def test_drawn_places_are_sets_of_equal_chance():
    row, place = cohort.draw_places(np.arange(60_000, dtype=np.uint64) * np.uint64(2**33) + np.uint64(5), np.full(60_000, 2), np.full(60_000, 4))
    pairs = np.bincount((1 << place).reshape(-1, 2).sum(axis=1), minlength=16) if (np.diff(row.reshape(-1, 2)) == 0).all() else []
    assert np.flatnonzero(pairs).tolist() == [3, 5, 6, 9, 10, 12] and max(abs(pairs[pairs > 0] - 10_000)) < 500


def test_kmeans_runs_on_sparse_vectors_over_all_tasks(spark, monkeypatch):
    seen, fit = [], cohort.KMeans.fit
    monkeypatch.setattr(cohort.KMeans, "fit", lambda self, data: seen.append(data) or fit(self, data))
    m = spark.createDataFrame([("s1", "y", 0.6), ("s1", "x", 0.8), ("s2", "x", 1.0), ("s3", "z", 1.0)], "student_id string, skill string, w double")
    students = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("none",), ("s3",)], "student_id string")
    got = {r["student_id"]: r["cluster_id"] for r in cohort.kmeans(m, students, ["x", "y", "z"], k=3, tries=3).collect()}
    assert set(got) == {"s1", "s2", "s3", "none"} and got["s1"] == got["s2"] and len(set(got.values())) == 3
    vectors = {r["student_id"]: r["features"] for r in seen[0].collect()}
    assert {k: (v.size, v.indices.tolist(), v.values.tolist()) for k, v in vectors.items()} == {"s1": (3, [0, 1], [0.8, 0.6]), "s2": (3, [0], [1.0]), "s3": (3, [2], [1.0]), "none": (3, [], [])}
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
