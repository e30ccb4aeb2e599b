"""Students as skill vectors, K-means archetypes, cluster profiles, and a student generator."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.skills import year_level
from pathloom.operators.overlap import mixed
from pathloom.runtime import cut

DRAWN_AT_ONCE = 4_000_000  # places in a table of draws


def skill_matrix(students: DataFrame, courses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """student_id, skill, w: counts of vocabulary skills over the completed courses, scaled to length 1.

    Long form: absent pairs are zeros.  Repeated completed courses count again."""
    taken = students.select("student_id", F.explode("completed").alias("code"))
    skills = courses.select("code", F.explode("skills").alias("skill")).join(vocabulary.select("skill").distinct(), "skill", "left_semi")
    counts = taken.join(skills, "code").groupBy("student_id", "skill").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("student_id")))
    return counts.select("student_id", "skill", (F.col("n") / norm).alias("w"))


def mean_vector(matrix: DataFrame, n_students: Column | int) -> DataFrame:
    """skill, mean over all students, those without the skill counting as 0."""
    n = F.lit(n_students) if isinstance(n_students, int) else n_students
    return matrix.groupBy("skill").agg((F.sum("w") / n).alias("mean"))


def centroids(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster_id, skill, centroid; labels: student_id, cluster_id (every member, with or without skills)."""
    size = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    sums = matrix.join(labels, "student_id").groupBy("cluster_id", "skill").agg(F.sum("w").alias("s"))
    return sums.join(size, "cluster_id").select("cluster_id", "skill", (F.col("s") / F.col("size")).alias("centroid"), "size")


def describe_clusters(matrix: DataFrame, labels: DataFrame, *, top_n: int = 8) -> DataFrame:
    """cluster_id, size, centroid_strength, top_distinguishing_skills (joined by ;): the skills whose centroid
    is most above the global mean (ten decimals, ties by skill)."""
    c = centroids(matrix, labels)
    everyone = labels.agg(F.count(F.lit(1)).alias("n"))
    mean = matrix.join(labels.select("student_id"), "student_id", "left_semi").groupBy("skill").agg(F.sum("w").alias("s")).crossJoin(F.broadcast(everyone)).select("skill", (F.col("s") / F.col("n")).alias("mean"))
    diff = c.join(mean, "skill").withColumn("diff", F.round(F.col("centroid") - F.col("mean"), 10))
    best = Window.partitionBy("cluster_id").orderBy(F.desc("diff"), "skill")
    top = diff.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top_n)
    top = top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "skill"))), lambda x: x["skill"]), ";").alias("top_distinguishing_skills"))
    strength = c.groupBy("cluster_id").agg(F.first("size").alias("size"), F.sqrt(F.sum(F.col("centroid") * F.col("centroid"))).alias("centroid_strength"))
    return strength.join(top, "cluster_id")


def sparse_vectors(rows: DataFrame, size: int) -> DataFrame:
    """student_id, features of rows with at, a list of (i, w) ascending by i; null is the zero vector."""
    schema = T.StructType([rows.schema["student_id"], T.StructField("features", VectorUDT())])
    kind = pa.struct([pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", pa.list_(pa.int32())), pa.field("values", pa.list_(pa.float64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column("at")
            offsets = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32))
            i, w = lists.flatten().flatten()
            columns = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(offsets, i.cast(pa.int32())), pa.ListArray.from_arrays(offsets, w)]
            yield pa.RecordBatch.from_arrays([batch.column("student_id"), pa.StructArray.from_arrays(columns, fields=list(kind))], names=schema.names)

    return rows.select("student_id", "at").mapInArrow(pack, schema)


def kmeans(matrix: DataFrame, students: DataFrame, vocabulary: list[str], *, k: int = 8, seed: int = 42, tries: int = 10) -> DataFrame:
    """student_id, cluster_id of the cheapest of `tries` runs; students without skills are zero vectors.

    The vocabulary orders the dimensions and must be bounded (it is a list).  Vectors are sparse and
    written once, over all tasks; each run keeps them as they are for its rounds."""
    spark = matrix.sparkSession
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(vocabulary)), "i int, skill string"))  # bounded
    at = matrix.join(numbers, "skill").groupBy("student_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("at"))
    full = students.select("student_id").distinct().join(at, "student_id", "left")
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    data = cut(sparse_vectors(full.repartition(spread, "student_id"), len(vocabulary)))
    best, cost = None, None
    for t in range(tries):
        model = KMeans(k=k, seed=seed + t, maxIter=50).fit(data)
        if cost is None or model.summary.trainingCost < cost:
            best, cost = model, model.summary.trainingCost
    return best.transform(data).select("student_id", F.col("prediction").alias("cluster_id"))


# Majors of the generator.
MAJORS = "COMP STAT DS BUS ECON ACCT FIN ENG TRA MCOM AI ENV BIOL CHEM PSY POLS SWSA MUS CTV CCM".split()


def _uniform(*parts) -> Column:
    """Number in [0, 1) drawn by hash: the same for the same parts, on any cluster."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def draw_places(keys: np.ndarray, wanted: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row `wanted` distinct places below `of`, every such set as likely as another.

    Floyd's way: the s-th of k draws is among the first of - k + s + 1 places, or that last place if it
    was drawn before.  Draws are hashes of the row's key, so work and room follow what is drawn."""
    rows, places = [], []
    whole = wanted >= of
    for i in np.flatnonzero(whole & (of > 0)).tolist():
        rows.append(np.full(of[i], i))
        places.append(np.arange(of[i]))
    todo = np.flatnonzero(~whole & (wanted > 0))
    todo = todo[np.argsort(wanted[todo], kind="stable")]
    begin = 0
    while begin < len(todo):
        end = len(todo)
        while end - begin > 1 and (end - begin) * int(wanted[todo[end - 1]]) > DRAWN_AT_ONCE:
            end = begin + (end - begin) // 2
        at = todo[begin:end]
        k, m, key = wanted[at], of[at], keys[at]
        taken = np.full((len(at), int(k[-1])), -1, np.int64)
        for s in range(taken.shape[1]):
            on = np.searchsorted(k, s, side="right")  # rows that have not drawn enough
            last = (m - k + s)[on:]
            drawn = (mixed(key[on:] + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % 2**64)) % (last + 1).astype(np.uint64)).astype(np.int64)
            again = (taken[on:, :s] == drawn[:, None]).any(axis=1)
            taken[on:, s] = np.where(again, last, drawn)
        r, c = np.nonzero(taken >= 0)
        rows.append(at[r])
        places.append(taken[r, c])
        begin = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *places])


def sample_courses(students: DataFrame, courses: DataFrame, *, seed: int = 42, per_year: float = 7, spread: float = 2, own_share: float = 0.7) -> DataFrame:
    """student_id, completed_courses: courses up to the student's year, 70 % of the own major, a normal
    number of them; a shortfall elsewhere is filled from the major.  No major or no year gives no courses.

    Every task gets the codes, a few bytes a course.  Sorted, those of a major are one range, so a student
    costs what is drawn, not a look at the whole catalogue."""
    gauss = F.sqrt(-2 * F.log(F.greatest(_uniform("student_id", F.lit(seed)), F.lit(1e-9)))) * F.cos(2 * 3.141592653589793 * _uniform("student_id", F.lit(seed + 1)))
    n = F.greatest(F.lit(0), F.floor(per_year * F.col("year") + spread * gauss))
    want = students.select("student_id", F.col("major_prefix").cast("string").alias("major"), F.col("year").cast("bigint").alias("year"), n.alias("n"), F.xxhash64("student_id", F.lit(seed)).alias("key"))
    listed = courses.where("code is not null").select("code", year_level("code").alias("level")).toPandas()
    order = sorted(range(len(listed)), key=listed["code"].tolist().__getitem__)
    catalogue = students.sparkSession.sparkContext.broadcast((listed["code"].to_numpy()[order].tolist(), listed["level"].to_numpy(np.int64)[order]))
    schema = T.StructType([students.schema["student_id"], T.StructField("completed_courses", T.ArrayType(T.StringType()))])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, levels = catalogue.value
        texts = pa.array(codes, pa.string())
        open_to = {}  # by the highest level up to the year: places of the courses, and their codes
        steps = np.unique(levels)
        for batch in batches:
            rows = batch.num_rows
            majors, years = batch.column("major").to_pylist(), batch.column("year").to_pylist()
            n = pc.fill_null(batch.column("n"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = mixed(batch.column("key").to_numpy().view(np.uint64))
            pools, low, high, size = [], *np.zeros((3, rows), np.int64)
            ranges: dict[tuple, tuple[int, int]] = {}
            for i, (major, year) in enumerate(zip(majors, years)):
                top = 0 if major is None or year is None else int(np.searchsorted(steps, year, side="right"))
                if top not in open_to:
                    at = np.flatnonzero(levels < steps[top]) if top < len(steps) else np.arange(len(codes))
                    open_to[top] = at, [codes[x] for x in at.tolist()]
                at, own = open_to[top]
                if (top, major) not in ranges:
                    ranges[top, major] = (0, 0) if major is None else (bisect_left(own, major), bisect_left(own, major + chr(0x10FFFF)))
                pools.append(top)
                (low[i], high[i]), size[i] = ranges[top, major], len(at)
            n_own, n_other = high - low, size - (high - low)
            own = np.minimum(n_own, np.floor(n * own_share).astype(np.int64))
            other = np.minimum(n_other, n - own)
            fill = np.minimum(n_own - own, n - own - other)
            r1, p1 = draw_places(key, own + fill, n_own)
            r2, p2 = draw_places(mixed(key), other, n_other)
            p1, p2 = p1 + low[r1], p2 + np.where(p2 >= low[r2], (high - low)[r2], 0)
            row, place = np.concatenate([r1, r2]), np.concatenate([p1, p2])
            pool = np.array(pools, np.int64)
            for top in np.unique(pool).tolist():
                here = np.flatnonzero(pool[row] == top)
                place[here] = open_to[top][0][place[here]]
            place = place[np.lexsort((place, row))]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("student_id"), pa.ListArray.from_arrays(pa.array(offsets), texts.take(pa.array(place)))], names=schema.names)

    return want.mapInArrow(draw, schema)


def pick_goal(key: Column, careers: list[str], seed: int = 42) -> Column:
    """One of the careers (a short list), drawn by hash."""
    return F.element_at(F.array(*(F.lit(c) for c in careers)), (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(careers))) + 1).cast("int"))


def generate_students(spark: SparkSession, courses: DataFrame, careers: list[str], *, n: int = 300, seed: int = 42) -> DataFrame:
    """student_id, major_prefix, year, completed_courses, career_goal; the same for the same seed."""
    u = _uniform("id", F.lit(seed + 7)) * 4.5  # year weights 1 : 1.2 : 1.3 : 1
    base = spark.range(n).select(
        F.format_string("S%04d", F.col("id")).alias("student_id"), pick_goal(F.col("id"), MAJORS, seed + 3).alias("major_prefix"),
        F.when(u < 1, 1).when(u < 2.2, 2).when(u < 3.5, 3).otherwise(4).alias("year"), pick_goal(F.col("id"), careers, seed + 5).alias("career_goal"),
    )
    return base.join(sample_courses(base, courses, seed=seed), "student_id").select("student_id", "major_prefix", "year", "completed_courses", "career_goal")
