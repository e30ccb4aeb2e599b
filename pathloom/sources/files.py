"""File sources: timetables, postings, catalogue text, archives, the extraction cache."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.parsing import catalog
from pathloom.functions.strings import strip
from pathloom.sources.tables import exists

# The columns of the timetable as written, and their names here.
TIMETABLE_COLUMNS = {
    "Course Code": "course_code", "Course Title & Session": "title_session", "Offering Unit": "offering_unit", "Offering Programme": "offering_programme",
    "Units": "units", "Class Schedule": "schedule", "Classroom": "classroom", "Teachers": "teacher", "Requirements": "requirements",
}
POSTING_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("job_id", "title", "description")]
    + [T.StructField("normalized_salary", T.DoubleType()), T.StructField("location", T.StringType()), T.StructField("formatted_experience_level", T.StringType()), T.StructField("listed_time", T.LongType())]
)


def clean_timetable(raw: DataFrame, columns: dict[str, str] = TIMETABLE_COLUMNS) -> DataFrame:
    """Mapped columns that exist, renamed; rows without a code dropped, then codes stripped (a blank code stays)."""
    kept = [F.col(f"`{k}`").alias(v) for k, v in columns.items() if k in raw.columns]
    return raw.select(*kept).where("course_code is not null").withColumn("course_code", strip("course_code"))


def read_timetable(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """Timetable exported as CSV: `skip` title rows, then the header.  (Spark has no source for .xls.)"""
    lines = spark.read.text(path, wholetext=True)
    rows = F.split("value", r"\r?\n")
    body = lines.select(F.explode(F.slice(rows, F.lit(skip + 1), F.size(rows))).alias("line")).where("line <> ''")
    header = body.first()[0]
    names = next(__import__("csv").reader([header]))
    rows = body.where(F.col("line") != header)
    parsed = rows.select(F.from_csv("line", ", ".join(f"c{i} string" for i in range(len(names)))).alias("r")).select("r.*")
    return clean_timetable(parsed.toDF(*names))


def clean_postings(raw: DataFrame) -> DataFrame:
    """Postings without an id dropped, a missing description is empty."""
    return raw.where("job_id is not null").withColumn("description", F.coalesce("description", F.lit("")))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings CSV (quoted line breaks allowed); the seven columns are taken by name."""
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in head.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in POSTING_SCHEMA.fields]
    return clean_postings(head.select(*kept))


def ensure_extracted(archive: str, folder: str, member: str = "postings.csv", spark: SparkSession | None = None) -> str:
    """Path of an archive's member, extracted unless it is there.  With a session given, archive and
    folder may lie in any file system that Spark reaches, such as the cluster's shared folder; the
    member's bytes are streamed, never held."""
    if spark is not None:
        return _extracted_there(spark, archive, folder, member)
    target = os.path.join(folder, member)
    if not os.path.exists(target):
        os.makedirs(folder, exist_ok=True)
        with zipfile.ZipFile(archive) as z:
            z.extract(member, folder)
    return target


def _extracted_there(spark: SparkSession, archive: str, folder: str, member: str) -> str:
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    target, part = path(f"{folder}/{member}"), path(f"{folder}/.{member}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        source = path(archive)
        zipped = jvm.java.util.zip.ZipInputStream(source.getFileSystem(spark._jsc.hadoopConfiguration()).open(source))
        try:
            while (entry := zipped.getNextEntry()) is not None and entry.getName() != member:
                pass
            if entry is None:
                raise KeyError(f"{archive} has no member {member}")
            out = fs.create(part, True)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(zipped, out, 65536, False)
            out.close()
        finally:
            zipped.close()
        fs.rename(part, target)  # readers see all of it or none
    return target.toString()


def zip_member(spark: SparkSession, parts: str, archive: str, member: str = "postings.csv", head: str = "") -> None:
    """An archive of one member: `head`, then the files of a folder in the order of their names, streamed."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    folder = path(parts)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    out = jvm.java.util.zip.ZipOutputStream(fs.create(path(archive), True))
    try:
        out.putNextEntry(jvm.java.util.zip.ZipEntry(member))
        out.write(bytearray(head.encode()))
        for status in sorted(fs.listStatus(folder), key=lambda x: x.getPath().getName()):
            if not status.getPath().getName().startswith(("_", ".")):
                data = fs.open(status.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 65536, False)
                data.close()
        out.closeEntry()
    finally:
        out.close()


def read_documents_text(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, text of files.  Without `extract` files are UTF-8 text; with it (say, a PDF library's
    function) each file's bytes are handed over in an Arrow batch."""
    if extract is None:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([extract(x) for x in b.column("content").to_pylist()], pa.string())], names=["path", "text"])

    return files.mapInArrow(run, "path string, text string")


def join_pages(pages: DataFrame, ident: str, order: str, text: str) -> DataFrame:
    """ident, text: non-blank pages joined by a blank line, in order."""
    kept = pages.where(strip(F.coalesce(F.col(text), F.lit(""))) != "")
    rows = kept.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    return rows.select(ident, F.array_join(F.col(f"p.{text}"), "\n\n").alias("text"))


def read_catalog(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """Courses of catalogue files."""
    return catalog(read_documents_text(spark, path, extract), "text", "path")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, skills of the extraction cache; a missing or broken one is empty."""
    schema = "key string, skills array<string>"
    try:
        if exists(spark, path):
            return spark.read.schema(schema).parquet(path)
    except Exception:  # noqa: BLE001
        pass
    return spark.createDataFrame([], schema)
