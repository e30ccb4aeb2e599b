"""Skill extraction from text with a cache, and service text.

The extractor is any callable from text to a list of skills (a client of a language model, say).  The
one given here finds listed skills by keyword, so that results are the same everywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.strings import strip
from pathloom.operators.taxonomy import cache_upsert

MIN_TEXT = 20

# Fixed text: how a model is asked for skills.
EXTRACTION_PROMPT = (
    "List the concrete technical skills named in the text below: languages, frameworks, tools, methods. "
    "Leave out soft skills, job titles, companies, places and vague phrases. Use canonical names, at most 15.\n\n"
    "Text:\n{text}\n\nAnswer with a JSON array of strings only."
)


def keyword_extractor(skills: list[str]) -> Callable[[str], list[str]]:
    """Finds whole-word mentions of the listed skills (a bounded list), in order of the list."""
    import re

    patterns = [(s, re.compile(rf"(?<!\w){re.escape(s.lower())}(?!\w)")) for s in skills]

    def extract(text: str) -> list[str]:
        low = text.lower()
        return [s for s, p in patterns if s.lower() in low and p.search(low)]

    return extract


def extract_skills(docs: DataFrame, ident: str, text: str, extractor: Callable[[str], list[str]], cache: DataFrame | None = None, *, cache_failures: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ident, skills) and the cache with the new texts.

    Texts are stripped; those of fewer than MIN_TEXT signs have no skills and are not looked up.
    Known texts (by SHA-1) are taken from the cache, distinct new ones go to the extractor once;
    a failure gives no skills, which is remembered if `cache_failures`."""
    spark = docs.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], "key string, skills array<string>")
    rows = docs.select(ident, strip(F.coalesce(F.col(text), F.lit(""))).alias("t")).withColumn("key", F.when(F.length("t") >= MIN_TEXT, F.sha1("t")))
    new = rows.where("key is not null").join(cache.select("key"), "key", "left_anti").select("key", "t").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ok = [], []
            for t in b.column("t").to_pylist():
                try:
                    out.append(list(extractor(t)))
                    ok.append(True)
                except Exception:  # noqa: BLE001
                    out.append([])
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.string())), pa.array(ok)], names=["key", "skills", "ok"])

    made = new.mapInArrow(run, "key string, skills array<string>, ok boolean").persist()
    kept = made if cache_failures else made.where("ok")
    full = cache_upsert(cache, kept.select("key", "skills"))
    known = cache.unionByName(made.select("key", "skills"))
    out = rows.join(known, "key", "left").select(ident, F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))
    return out, full


# Fixed text: how a model is asked for the data of a transcript.
TRANSCRIPT_PROMPT = (
    "Read the transcript below. Answer with one JSON object with the keys major (text), year (1 to 5), gpa (number or null), "
    "completed_courses and current_courses (lists of course codes).\n\nTranscript:\n{text}"
)
TRANSCRIPT_SIGNS = 20_000  # of a transcript that go into the prompt


def transcript_prompt(text: str | None) -> str | None:
    """Prompt for a transcript's text; none for a blank one, whose profile is empty."""
    return TRANSCRIPT_PROMPT.replace("{text}", text[:TRANSCRIPT_SIGNS]) if text and text.strip() else None


def check_upload(name: str | None, content: bytes | None, most: int = 10 * 1024 * 1024) -> int:
    """Status of an uploaded transcript: 400 without a file or with an empty one, 415 unless it is a PDF, 413 if too large, else 200."""
    if not name or not content:
        return 400
    if not name.lower().endswith(".pdf"):
        return 415
    return 413 if len(content) > most else 200


def year_text(year: int | None, language: str = "en") -> str:
    if language == "zh":
        return f"大{year}" if year and 1 <= year <= 4 else "研究生" if year == 5 else "未知"
    return f"Year {year}" if year and 1 <= year <= 4 else "Graduate" if year == 5 else "Unknown"


def insight_prompt(profile: dict | None, career: str, n_postings: int, recommendations: list[dict], skills: list[dict], needs: list[dict], others: list[dict], language: str = "en") -> str:
    """Prompt for a short narrative; lists are capped (4 bridges, 3 gaps, 10 skills, 5 careers)."""
    profile = profile or {}
    lines = []
    for i, r in enumerate(recommendations, 1):
        covers = ", ".join(b["skill"] for b in (r.get("bridge_skills") or [])[:4])
        gaps = ", ".join((r.get("gap_skills") or [])[:3])
        lines.append(f"{i}. {r['code']} {r.get('name', '')}" + (f" covers: {covers}" if covers else "") + (f" gaps: {gaps}" if gaps else ""))
    listed = lambda xs: ", ".join(f"{s['skill']} ({s['weight']})" for s in xs[:10]) or "(none)"
    alike = "\n".join(f"- {c['title']} (similarity {c['similarity']}, {c['shared_skill_count']} shared skills)" for c in others[:5]) or "(none)"
    unknown = "未填" if language == "zh" else "Unknown"
    gpa = profile.get("gpa")
    return "\n".join([
        f"Write in {'中文' if language == 'zh' else 'English'}.",
        f"Student: major {profile.get('major') or unknown}, {year_text(profile.get('year'), language)}, GPA {gpa if gpa is not None else '—'}, "
        f"{len(profile.get('completed_courses') or [])} courses done, {len(profile.get('current_courses') or [])} under way.",
        f"Target career: {career} ({n_postings} postings).",
        f"Recommended courses ({len(recommendations)}):", *lines,
        f"Skills now: {listed(skills)}", f"Skills the career needs: {listed(needs)}", "Similar careers:", alike,
        'Answer with one JSON object with the keys "headline", "strengths", "gaps", "strategy".',
    ])


def insight(call: Callable[[str], str], prompt: str) -> str:
    """The model's reply; any failure gives an empty reply (parsed to empty fields)."""
    try:
        return call(prompt) or ""
    except Exception:  # noqa: BLE001
        return ""
