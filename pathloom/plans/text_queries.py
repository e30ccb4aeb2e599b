"""Queries of the text, taxonomy and entity-resolution operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import parsing
from pathloom.functions import skills as fs
from pathloom.functions.strings import split_list
from pathloom.operators import resolve, taxonomy
from pathloom.operators.extract import extract_skills, keyword_extractor
from pathloom.plans import inputs as I
from pathloom.plans.inputs import split_sql, strip_sql, with_sql
from pathloom.plans.registry import query
from pathloom.runtime import bounded_rows, fresh_folder
from pathloom.sources.tables import table

# ---- text


@query(with_sql("""SELECT code, u.i AS pos, u.p AS prereq FROM (SELECT code, unnest(list_transform(x, lambda v, i: {'p': v, 'i': i})) AS u FROM
    (SELECT code, list_filter(list_transform(regexp_extract_all(coalesce(prerequisites_text, ''), '(?i)\\b([A-Z]{2,5}\\s*[0-9]{3,4})\\b', 1), lambda v: upper(regexp_replace(v, '\\s', '', 'g'))), lambda v: true) AS x0,
     list_filter(x0, lambda v, i: list_position(x0, v) = i) AS x FROM courses))"""))  # fmt: skip
def txt_prereq(s, d):
    """Course codes named in prerequisites, each once per course, in order."""
    return I.courses(s, d).select("code", F.posexplode(parsing.prerequisites("prerequisites_text")).alias("p", "prereq")).select("code", (F.col("p") + 1).cast("bigint").alias("pos"), "prereq")


@query(with_sql("SELECT code, unnest(skills) AS skill FROM courses"))
def txt_split_semis(s, d):
    return I.courses(s, d).select("code", F.explode("skills").alias("skill"))


_RAW = f"SELECT upper({strip_sql('code')}) AS code, min(extracted_skills) AS raw FROM courses_skills WHERE code IS NOT NULL GROUP BY 1"


def _raw(s, d):
    from pathloom.functions.strings import record_code

    return table(s, d, "courses_skills").where("code is not null").groupBy(record_code("code").alias("code")).agg(F.min("extracted_skills").alias("raw"))


@query(f"SELECT code, unnest({split_sql('raw', ',')}) AS skill FROM ({_RAW})")
def txt_split_commas(s, d):
    return _raw(s, d).select("code", F.explode(split_list("raw", ",")).alias("skill"))


@query(with_sql("""SELECT title, (length(title) BETWEEN 3 AND 60 AND NOT regexp_matches(title, '\\*{2,}|\\|{2}|~~') AND NOT contains(title, '$')
    AND CASE WHEN starts_with(title, '.') THEN regexp_matches(title, '^\\.[A-Za-z]') ELSE NOT regexp_matches(title, '^[*$(\\d]') END) AS clean FROM careers"""))  # fmt: skip
def txt_title_clean(s, d):
    return I.jobs(s, d).where("title is not null").select("title").distinct().select("title", fs.clean_title("title").alias("clean"))


def _replies(s, d):
    """Model replies made of the courses' own lists: fenced, in prose, with other kinds among the strings, or broken."""
    c = I.courses(s, d).select("code", "name", F.col("skills").alias("sk"))
    arr = F.to_json("sk")
    kind = F.pmod(F.length("code") + F.size("sk"), F.lit(4))
    reply = F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), arr, F.lit("\n```"))).when(kind == 1, arr).when(kind == 2, F.regexp_replace(arr, r"\]$", ", 42, null]")).otherwise(F.concat(F.lit("no list here "), F.coalesce("name", F.lit(""))))
    return c.select("code", "name", "sk", F.when(F.size("sk") > 0, reply).otherwise("[]").alias("reply"), kind.alias("kind"))


@query(with_sql("SELECT code, CASE WHEN len(skills) > 0 AND (length(code) + len(skills)) % 4 = 3 THEN '' ELSE array_to_string(skills, ';') END AS parsed FROM courses"))
def txt_json_array(s, d):
    """Strings of a JSON reply; numbers and nulls are dropped, a reply without an array gives none."""
    return _replies(s, d).select("code", F.array_join(parsing.json_strings("reply"), ";").alias("parsed"))


@query(with_sql("SELECT code, coalesce(name, '') AS headline, CASE WHEN description IS NULL THEN '' ELSE upper(code) END AS strengths, '' AS gaps, '' AS strategy FROM courses"))
def txt_json_insight(s, d):
    obj = F.to_json(F.struct(F.col("name").alias("headline"), F.when(F.col("description").isNotNull(), F.upper("code")).alias("strengths")))
    got = parsing.json_insight(F.concat(F.lit("Here it is: "), obj, F.lit(" done")))
    return I.courses(s, d).select("code", got.alias("r")).select("code", "r.*")


@query(with_sql("SELECT student_id, coalesce(trim(major_prefix), '') AS major, coalesce(year, 0) AS year, CASE WHEN year IS NOT NULL THEN year + 0.5::DOUBLE END AS gpa, array_to_string(completed, ';') AS completed FROM studs"))
def txt_json_transcript(s, d):
    obj = F.to_json(F.struct(F.col("major_prefix").alias("major"), "year", (F.col("year") + 0.5).alias("gpa"), F.col("completed").alias("completed_courses")))
    got = parsing.json_transcript(F.concat(F.lit("```"), obj, F.lit("```")))
    return I.students(s, d).select("student_id", got.alias("r")).select("student_id", "r.major", "r.year", "r.gpa", F.array_join("r.completed_courses", ";").alias("completed"))


def _catalog_text(s, d):
    """A catalogue text made of the courses: one page per unit number, an entry per course."""
    c = I.courses(s, d).where("units is not null and name is not null and regexp_like(code, '^[A-Z]{2,6}[0-9]{4}$')")
    entry = F.concat_ws("\n", F.concat_ws(" ", F.col("code"), F.col("name"), F.concat(F.lit("("), F.col("units").cast("string"), F.lit(" units)"))),
                        F.concat(F.lit("Pre-requisite(s): "), F.coalesce("prerequisites_text", F.lit("None"))), F.concat(F.lit("Course Description: "), F.coalesce("description", F.lit("")), F.lit("\n")))
    pages = c.withColumn("page", F.pmod(F.crc32("code"), F.lit(64)))  # pages of like size, however many courses
    return pages.select("page", "code", entry.alias("e")).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("code", "e"))).alias("l")).select(F.col("page").cast("string").alias("page"), F.array_join(F.col("l.e"), "").alias("text"))


_CATALOG = r"""SELECT code, trim(regexp_replace(name, '\s+', ' ', 'g')) AS name, units, trim(regexp_replace(coalesce(prerequisites_text, 'None'), '\s+', ' ', 'g')) AS prerequisites_text, trim(regexp_replace(coalesce(description, ''), '\s+', ' ', 'g')) AS description
    FROM courses WHERE units IS NOT NULL AND name IS NOT NULL AND regexp_full_match(code, '[A-Z]{2,6}[0-9]{4}')
    AND trim(coalesce(prerequisites_text, 'None') || coalesce(description, ''), E' \n\r\t') <> ''"""


@query(with_sql(_CATALOG))
def txt_catalog(s, d):
    """Catalogue text cut into entries and read back into courses."""
    return parsing.catalog(_catalog_text(s, d), "text", "page")


@query(with_sql("SELECT count(*) AS n_blocks FROM courses WHERE units IS NOT NULL AND name IS NOT NULL AND regexp_full_match(code, '[A-Z]{2,6}[0-9]{4}')"))
def txt_blocks(s, d):
    return parsing.course_blocks(_catalog_text(s, d), "text", "page").agg(F.count(F.lit(1)).alias("n_blocks"))


@query(with_sql(_CATALOG))
def txt_block_fields(s, d):
    return parsing.course_blocks(_catalog_text(s, d), "text", "page").select(parsing.course_fields("block").alias("c")).where("c is not null").select("c.*")


# ---- functions

_ACRONYMS = "[" + ", ".join(f"'{a}'" for a in fs.ACRONYMS) + "]"
_ALIAS = "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fs.ALIASES.items()) + " END"


def normalize_sql(x: str) -> str:
    """The canonical form of a skill in SQL, as a scalar subquery."""
    word = f"CASE WHEN list_contains({_ACRONYMS}, upper(w)) THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END"
    return f"""(SELECT CASE WHEN length(s) < 2 THEN '' ELSE coalesce({_ALIAS}, CASE WHEN list_contains({_ACRONYMS}, upper(s)) THEN upper(s)
        ELSE array_to_string(list_transform(string_split(regexp_replace(s, '\\s+', ' ', 'g'), ' '), lambda w: {word}), ' ') END) END FROM (SELECT {strip_sql(f"coalesce({x}, '')")} AS s))"""


def categorize_sql(x: str) -> str:
    import re

    def hit(k: str) -> str:
        if len(k) <= 2:
            edge = r"([^\pL\pN_]|$)" if k[-1].isalnum() else ""
            return f"regexp_matches(lower({x}), '(^|[^\\pL\\pN_]){re.escape(k)}{edge}')"
        return f"contains(lower({x}), '{k}')"

    return "CASE " + " ".join(f"WHEN {' OR '.join(hit(k) for k in ks)} THEN '{n}'" for n, ks in fs.CATEGORIES.items()) + f" ELSE '{fs.OTHER}' END"


def key_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({strip_sql(x)}), '[^a-z0-9+#\s]', ' ', 'g'), '\s+', ' ', 'g'))"


_TAX = "SELECT DISTINCT skill FROM skill_taxonomy WHERE skill IS NOT NULL"


def _tax(s, d):
    return table(s, d, "skill_taxonomy").where("skill is not null").select("skill").distinct()


@query(f"SELECT skill, {normalize_sql('skill')} AS normalized FROM ({_TAX})")
def fn_normalize_skill(s, d):
    return _tax(s, d).select("skill", fs.normalize_skill("skill").alias("normalized"))


@query(f"SELECT skill, {categorize_sql('skill')} AS category FROM ({_TAX})")
def fn_categorize(s, d):
    return _tax(s, d).select("skill", fs.categorize("skill").alias("category"))


@query(f"SELECT skill, regexp_matches(lower(skill), '(^|[^\\pL\\pN_])r([^\\pL\\pN_]|$)') AS r, regexp_matches(lower(skill), '(^|[^\\pL\\pN_])go([^\\pL\\pN_]|$)') AS go, contains(lower(skill), 'git') AS git FROM ({_TAX})")
def fn_keyword_match(s, d):
    low = F.lower("skill")
    return _tax(s, d).select("skill", *(fs.keyword_match(low, k).alias(k) for k in ("r", "go", "git")))


@query(f"SELECT skill, {key_sql('skill')} AS key FROM ({_TAX})")
def fn_norm_name(s, d):
    return _tax(s, d).select("skill", fs.name_key("skill").alias("key"))


_SH = "CASE WHEN length(k) >= 3 THEN list_distinct(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) WHEN length(k) > 0 THEN [k] ELSE [] END"


@query(f"SELECT skill, unnest({_SH}) AS shingle FROM (SELECT skill, {key_sql('skill')} AS k FROM ({_TAX}))")
def fn_shingles(s, d):
    return _tax(s, d).select("skill", F.explode(fs.shingles(fs.name_key("skill"))).alias("shingle"))


@query("SELECT doc_id, sha1(text) AS key FROM documents")
def fn_sha1_key(s, d):
    return table(s, d, "documents").select("doc_id", F.sha1("text").alias("key"))


@query()
def fn_extract(s, d):
    """Listed skills found in whole documents by keyword, one row per document."""
    listed = sorted(r[0] for r in bounded_rows(I.skills(s, d).select("canonical_name"), 100_000, "skills_canonical"))
    out, _ = extract_skills(table(s, d, "documents"), "doc_id", "text", keyword_extractor(listed))
    return out


@query()
def fn_extract_many(s, d):
    """Skills of course descriptions in the order of the codes; the cache afterwards has one row per distinct text."""
    listed = sorted(r[0] for r in bounded_rows(I.skills(s, d).select("canonical_name"), 100_000, "skills_canonical"))
    out, cache = extract_skills(I.courses(s, d), "code", "description", keyword_extractor(listed))
    n = cache.agg(F.count(F.lit(1)).alias("cached"))
    return out.crossJoin(F.broadcast(n)).orderBy("code")  # one row


@query("SELECT sha1(text) AS key, min(lang) AS lang FROM documents WHERE text IS NOT NULL GROUP BY 1")
def fn_cache(s, d):
    """Cache upsert: what English texts brought is kept, texts of other languages add their keys."""
    docs = table(s, d, "documents").where("text is not null").groupBy(F.sha1("text").alias("key")).agg(F.min("lang").alias("lang"))
    old = docs.where("lang = 'en'").select("key", F.array("lang").alias("skills"))
    return taxonomy.cache_upsert(old, docs.select("key", F.array("lang").alias("skills"))).select("key", F.col("skills")[0].alias("lang"))


# ---- taxonomy

_DOCS = f"SELECT DISTINCT code, skill FROM (SELECT code, {normalize_sql('x')} AS skill FROM (SELECT code, unnest({split_sql('raw', ',')}) AS x FROM ({_RAW}))) WHERE skill <> ''"
_FREQ = f"SELECT skill, count(*) AS doc_frequency FROM ({_DOCS}) GROUP BY 1"


def _docs(s, d):
    return _raw(s, d).select("code", split_list("raw", ",").alias("x"))


@query(_FREQ)
def agg_doc_freq(s, d):
    return taxonomy.doc_frequency(taxonomy.doc_skills(_docs(s, d), "code", "x"))


_TAXSQL = f"SELECT printf('skill_%04d', row_number() OVER (ORDER BY doc_frequency DESC, skill) - 1) AS skill_id, skill, doc_frequency FROM ({_FREQ})"


@query(_TAXSQL)
def agg_taxonomy(s, d):
    return taxonomy.taxonomy(_docs(s, d), "code", "x")


@query(f"SELECT *, {categorize_sql('skill')} AS category FROM ({_TAXSQL})")
def agg_taxonomy_cat(s, d):
    return taxonomy.categorized(taxonomy.taxonomy(_docs(s, d), "code", "x"))


# ---- entity resolution, over the distinct names of the taxonomy

_NAMES = "SELECT skill AS name, min(skill_id) AS ord, max(coalesce(doc_frequency, 0)) AS freq FROM skill_taxonomy WHERE skill IS NOT NULL GROUP BY 1"
_SHN = f"SELECT name, ord, freq, {_SH} AS sh FROM (SELECT *, {key_sql('name')} AS k FROM ({_NAMES})) WHERE k <> ''"
ER = f"""WITH RECURSIVE n AS MATERIALIZED ({_SHN}), f AS MATERIALIZED (SELECT name, unnest(sh) AS s FROM n),
    p AS MATERIALIZED (SELECT a, b, i / (len(x.sh) + len(y.sh) - i) AS jaccard FROM (SELECT l.name AS a, r.name AS b, count(*) AS i FROM f l JOIN f r USING (s) WHERE l.name < r.name GROUP BY 1, 2)
        JOIN n x ON x.name = a JOIN n y ON y.name = b WHERE i / (len(x.sh) + len(y.sh) - i) >= 0.7 - 1e-9),
    e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    w AS (SELECT name AS v, name AS r FROM n UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.v),
    m AS MATERIALIZED (SELECT v AS name, min(r) AS root FROM w GROUP BY 1),
    h AS MATERIALIZED (SELECT root, row_number() OVER (ORDER BY lower(first), root) - 1 AS cluster_id FROM (SELECT root, arg_min(name, ord) AS first FROM m JOIN n USING (name) GROUP BY 1)),
    c AS MATERIALIZED (SELECT cluster_id, name FROM m JOIN h USING (root)),
    t AS MATERIALIZED (SELECT cluster_id, arg_min(name, struct_pack(a := -freq, b := length(name), c := name)) AS canonical_name, sum(freq)::BIGINT AS doc_frequency, array_to_string(list_sort(list(name)), ';') AS variants FROM c JOIN n USING (name) GROUP BY 1) """


def _names(s, d):
    rows = table(s, d, "skill_taxonomy").where("skill is not null")
    return rows.groupBy(F.col("skill").alias("name")).agg(F.min("skill_id").alias("ord"), F.max(F.coalesce("doc_frequency", F.lit(0))).alias("freq"))


def _shingled(s, d):
    return resolve.shingled(_names(s, d))


def _clusters(s, d):
    return resolve.cluster_skills(_names(s, d), "name", "ord")


def _freqs(s, d):
    return _names(s, d).select(F.col("name").alias("skill"), F.col("freq").alias("doc_frequency"))


@query(f"SELECT skill AS name, min(skill_id) AS ord FROM skill_taxonomy WHERE skill IS NOT NULL GROUP BY 1")
def prj_distinct_input(s, d):
    return resolve.distinct_input(table(s, d, "skill_taxonomy"), "skill", "skill_id")


@query()
def er_minhash(s, d):
    return resolve.minhash(_shingled(s, d))


@query()
def er_lsh_candidates(s, d):
    return resolve.lsh_candidates(resolve.minhash(_shingled(s, d)))


@query(ER + "SELECT a, b, round(jaccard, 9) AS jaccard FROM p")
def er_jaccard_verify(s, d):
    return resolve.exact_pairs(_shingled(s, d)).withColumn("jaccard", F.round("jaccard", 9))


@query(ER + "SELECT a, b FROM p")
def jn_self_jaccard(s, d):
    return resolve.exact_pairs(_shingled(s, d)).select("a", "b")


@query(ER + "SELECT name, root FROM m")
def er_components(s, d):
    n = _shingled(s, d)
    return resolve.components(n, resolve.exact_pairs(n))


@query(ER + "SELECT cluster_id, name FROM c")
def er_cluster_ids(s, d):
    n = _shingled(s, d)
    return resolve.cluster_ids(n.select("name", "ord").join(resolve.components(n, resolve.exact_pairs(n)), "name"))


@query(ER + "SELECT cluster_id, name FROM c")
def er_cluster(s, d):
    return _clusters(s, d)


@query(ER + "SELECT cluster_id, canonical_name FROM t")
def er_canonical_name(s, d):
    return taxonomy.canonical_names(_clusters(s, d).withColumnRenamed("name", "variant"), _freqs(s, d))


@query(ER + "SELECT cluster_id AS canonical_skill_id, canonical_name, doc_frequency, variants FROM t WHERE doc_frequency >= 5")
def er_canonical_taxonomy(s, d):
    return taxonomy.canonical_taxonomy(_clusters(s, d).withColumnRenamed("name", "variant"), _freqs(s, d)).withColumn("variants", F.array_join("variants", ";"))


@query(ER + "SELECT cluster_id, doc_frequency FROM t")
def agg_sum_freq(s, d):
    return taxonomy.canonical_taxonomy(_clusters(s, d).withColumnRenamed("name", "variant"), _freqs(s, d), min_doc_freq=0).select(F.col("canonical_skill_id").alias("cluster_id"), "doc_frequency")


def _aliases(s, d):
    """variant, canonical_name: listed spellings as they are written between semicolons, and the names themselves."""
    raw = table(s, d, "skills_canonical").where("canonical_name is not null").select("canonical_name", F.explode(F.concat(split_list("variants", ";"), F.array("canonical_name"))).alias("variant"))
    return raw.groupBy("variant").agg(F.min("canonical_name").alias("canonical_name"))


_AL = f"SELECT variant, min(canonical_name) AS canonical_name FROM (SELECT canonical_name, unnest(list_append({split_sql('variants')}, canonical_name)) AS variant FROM skills_canonical WHERE canonical_name IS NOT NULL) GROUP BY 1"
_RM = f"SELECT code, x, pos FROM (SELECT code, unnest(list_transform(l, lambda v, i: {{'x': v, 'pos': i}}), recursive := true) FROM (SELECT code, {split_sql('raw', ',')} AS l FROM ({_RAW})))"


@query(f"""SELECT r.code, coalesce(k.names, '') AS canonical_skills FROM ({_RAW}) r LEFT JOIN
    (SELECT code, string_agg(canonical_name, ';' ORDER BY p) AS names FROM (SELECT code, canonical_name, min(pos) AS p FROM ({_RM}) JOIN ({_AL}) ON x = variant GROUP BY 1, 2) GROUP BY 1) k USING (code)""")
def er_remap(s, d):
    """Raw skills of courses looked up in the listed spellings, exactly."""
    valid = I.skills(s, d)
    return taxonomy.remap(_docs(s, d), "code", "x", _aliases(s, d), valid).select("code", F.array_join("canonical_skills", ";").alias("canonical_skills"))


@query(f"SELECT code, pos::INT - 1 AS pos, canonical_name FROM ({_RM}) JOIN ({_AL}) ON x = variant")
def jn_remap_lookup(s, d):
    return _docs(s, d).select("code", F.posexplode("x").alias("pos", "variant")).join(_aliases(s, d), "variant").select("code", "pos", "canonical_name")


_STOP = "[" + ", ".join(f"'{w}'" for w in resolve.STOP) + "]"


@query(rf"""WITH RECURSIVE b AS MATERIALIZED (SELECT name, list_sort(list_filter(list_distinct(regexp_extract_all(lower(name), '\b([a-z0-9]+)\b', 1)), lambda v: NOT list_contains({_STOP}, v))) AS w FROM (SELECT DISTINCT skill AS name FROM skill_taxonomy WHERE skill IS NOT NULL)),
    u AS MATERIALIZED (SELECT name, unnest(w) AS t FROM b), q AS MATERIALIZED (SELECT x.name, x.t AS p, y.t AS q FROM u x JOIN u y ON x.name = y.name AND x.t < y.t),
    l AS MATERIALIZED (SELECT p, q, min(name) AS a FROM q GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 30),
    e0 AS (SELECT DISTINCT a, name AS b FROM q JOIN l USING (p, q) WHERE a <> name), e AS MATERIALIZED (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
    r AS (SELECT name AS v, name AS r FROM b UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.v), m AS (SELECT v, min(r) AS root FROM r GROUP BY 1)
    SELECT size, members FROM (SELECT root, count(*) AS size, array_to_string(list_sort(list(v)), ';') AS members FROM m GROUP BY 1) WHERE size BETWEEN 3 AND 30 ORDER BY size DESC, root LIMIT 15""")
def er_token_bigram(s, d):
    """The largest groups of taxonomy names that share a pair of words."""
    return resolve.variant_groups(_tax(s, d), "skill")


@query("SELECT skill_id, skill, max(doc_frequency) AS doc_frequency FROM skill_taxonomy WHERE doc_frequency >= 5 GROUP BY 1, 2")
def flt_df_prune(s, d):
    return table(s, d, "skill_taxonomy").where("doc_frequency >= 5").groupBy("skill_id", "skill").agg(F.max("doc_frequency").alias("doc_frequency"))


@query(with_sql("SELECT code, CASE WHEN regexp_extract(code, '[0-9]') IN ('', '0') THEN 99 ELSE regexp_extract(code, '[0-9]')::INT END AS level FROM courses"))
def flt_year_level(s, d):
    return I.courses(s, d).select("code", fs.year_level("code").alias("level"))




# ---- catalogue files


def _catalog_files(s, d) -> str:
    """The catalogue text as one file per page in the shared folder."""
    path = fresh_folder(s, "catalog-pages")
    _catalog_text(s, d).write.partitionBy("page").text(path)
    return path


_PAGES = "SELECT sum(length(code))::BIGINT AS n_signs FROM courses WHERE units IS NOT NULL AND name IS NOT NULL AND regexp_full_match(code, '[A-Z]{2,6}[0-9]{4}')"


@query(with_sql(_PAGES))
def src_pdf_text(s, d):
    """Text of catalogue files by a function from bytes: signs of all codes at the start of an entry."""
    from pathloom.sources.files import read_documents_text

    pages = read_documents_text(s, _catalog_files(s, d) + "/*/*.txt", lambda b: b.decode())
    codes = F.regexp_extract_all("text", F.lit(r"(?m)^([A-Z]{2,6}\d{4})\s.*\(\d+ units\)"), 1)
    return pages.agg(F.sum(F.aggregate(codes, F.lit(0).cast("bigint"), lambda n, c: n + F.length(c))).alias("n_signs"))


@query(with_sql(_CATALOG))
def src_pdf_parse(s, d):
    """Catalogue files read and parsed."""
    from pathloom.sources.files import read_catalog

    return read_catalog(s, _catalog_files(s, d) + "/*/*.txt", lambda b: b.decode())


@query("""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, E'\\n\\n'), lambda v: NOT regexp_full_match(v, '\\s*')), E'\\n\\n')) AS text FROM documents WHERE NOT regexp_full_match(text, '\\s*')""")
def src_pdf_bytes(s, d):
    """Paragraphs of every document as pages, the blank ones left out, joined again (as MD5)."""
    from pathloom.sources.files import join_pages

    pages = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page", "t"))
    return join_pages(pages, "doc_id", "page", "t").select("doc_id", F.md5("text").alias("text"))


def _prompt_sql() -> str:
    from pathloom.operators.extract import EXTRACTION_PROMPT

    before, after = EXTRACTION_PROMPT.replace("'", "''").split("{text}")
    return f"SELECT doc_id, md5('{before}' || text || '{after}') AS prompt FROM documents"


@query(_prompt_sql())
def prompt_skills(s, d):
    """Extraction prompt of every document, as its MD5."""
    from pathloom.operators.extract import EXTRACTION_PROMPT

    before, after = EXTRACTION_PROMPT.split("{text}")
    return table(s, d, "documents").select("doc_id", F.md5(F.concat(F.lit(before), "text", F.lit(after))).alias("prompt"))
