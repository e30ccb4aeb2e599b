"""Every core query against its SQL on the smallest tables, and the plans of some."""

import html
import re

import pytest

from pathloom.plans import course_tables, graph_queries, text_queries  # noqa: F401
from pathloom.plans.registry import QUERIES, SQL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, small, name):
    compare(QUERIES[name], SQL[name], spark, small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_the_others_run(spark, small, name):
    rows = QUERIES[name](spark, small).count()
    assert rows > 0


def test_the_start_page_has_all_titles(spark, small):
    page = QUERIES["api_index"](spark, small).first()["html"]
    titles = sorted(r["title"] for r in QUERIES["api_careers"](spark, small).collect())
    assert len(titles) > 100 and [html.unescape(t) for t in re.findall(r"<td>(.*?)</td>", page)] == titles


def test_settled_recommendations_are_near_the_limit(spark, small):
    """Scores are within the tolerance's reach of those after 300 rounds."""
    from pathloom.operators import ranking
    from pathloom.plans import inputs

    g = inputs.request_graph(spark, small)
    limit = {(r["seed"], r["id"]): r["score"] for r in ranking.pagerank_dense(g.edges, graph_queries._seeds(spark, small), max_iter=300).collect()}
    got = QUERIES["r_recommend_settled"](spark, small).collect()
    reach = 1e-6 * g.nodes.count() * 0.85 / 0.15
    off = {}
    for r in got:
        off[r["seed"]] = off.get(r["seed"], 0.0) + abs(r["score"] - limit[r["seed"], r["course"]])
    assert set(off) == {seed for seed, _ in limit} and max(off.values()) <= reach


def plan(spark, small, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = QUERIES[name](spark, small)
    return df._jdf.queryExecution().toString()


def scans(text):
    return re.findall(r"FileScan parquet.*?ReadSchema: struct<(.*?)>(?=\s|$)", text)


@pytest.mark.parametrize("name, table, columns", [("agg_value_counts", "jobs_canonical", {"job_id", "title"}), ("flt_df_prune", "skill_taxonomy", {"skill_id", "skill", "doc_frequency"}), ("fn_sha1_key", "documents", {"doc_id", "text"})])
def test_scans_read_only_what_is_needed(spark, small, name, table, columns):
    text = plan(spark, small, name)
    read = [set(re.findall(r"(\w+):", s)) for s in scans(text)]
    assert read and all(r <= columns for r in read)


def test_filters_reach_the_scan(spark, small):
    assert "GreaterThanOrEqual(doc_frequency,5)" in plan(spark, small, "flt_df_prune")


@pytest.mark.parametrize("name", ["g_build", "jn_student_skill", "jn_career_cosine", "agg_taxonomy_cat", "c_matrix", "r_similar", "jn_courses_offering", "er_remap"])
def test_no_python_rows_and_no_cartesian_product(spark, small, name):
    text = plan(spark, small, name)
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["er_cluster_ids", "agg_sum_freq", "er_canonical_taxonomy"])
def test_clusters_are_joined_without_shingles(spark, small, name):
    """The last joins, by name, do not make shingles to tell names without any."""
    assert not re.search(r"transform\(|substr\(", QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
