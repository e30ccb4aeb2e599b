"""SQL that gives the rows of the llm queries, where SQL can.

Queries that read packed fields, texts or tokens have none; brute force stands in for it in the tests."""

_KEY = r"lower(trim(regexp_replace(skill, '\s+', ' ', 'g')))"
_TERMS = f"""WITH o AS (SELECT skill_id, {_KEY} AS skill, max(coalesce(doc_frequency, 0)) AS f FROM skill_taxonomy WHERE skill_id IS NOT NULL AND skill IS NOT NULL AND {_KEY} <> '' GROUP BY 1, 2),
    t AS (SELECT skill, count(*) AS n_rows, sum(f)::BIGINT AS total FROM o GROUP BY 1),
    b AS (SELECT *, CASE WHEN total < 5 THEN 'rare' WHEN total > 0.01 * (SELECT sum(total) FROM t) THEN 'common' ELSE 'usable' END AS band FROM t) """

SQL: dict[str, str] = {
    "p2_frequencies": _TERMS + "SELECT skill, n_rows, total, band FROM b",
    "p2_found": _TERMS + "SELECT skill, band FROM b WHERE band <> 'usable'",
    "p7_found": r"""WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT left_id AS a, right_id AS b FROM skill_matches WHERE lower(trim(regexp_replace(decision, '\s+', ' ', 'g'))) = 'match' AND left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id),
        e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a AS v, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.v)
        SELECT min(g) AS group_id, v AS skill_id FROM r WHERE v IN (SELECT skill_id FROM skill_taxonomy) GROUP BY v""",
}
