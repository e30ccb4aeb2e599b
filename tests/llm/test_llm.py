"""The llm operators against brute force on small fixtures, with the defined results of odd inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import abuse, bitmaps, components, distinctive, groups, mapping, mixing, packing, screening, setjoin
from pathloom.llm.mentions import Mentions, distance


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- 1


def test_scores_against_brute_force(spark):
    random.seed(1)
    docs = {f"r{i}": [f"t{min(int(random.expovariate(0.4)), 9)}" for _ in range(random.randrange(0, 9))] for i in range(80)}
    terms = frame(spark, [(r, t) for r, ts in docs.items() for t in ts] + [(None, "t1"), ("r1", None)], "rec string, term string")
    records = frame(spark, [(r,) for r in docs] + [("r1",), (None,)], "rec string")
    got = {(x["rec"], x["term"]): x for x in distinctive.distinctive_terms(terms, records).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in ts for ts in docs.values()) for t in {t for ts in docs.values() for t in ts}}
    assert set(got) == {(r, t) for r, ts in docs.items() for t in ts}
    for (r, t), x in got.items():
        tf, length = docs[r].count(t), len(docs[r])
        want = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
        assert x["score"] == pytest.approx(want) and x["doc_freq"] == df[t] and x["n_docs"] == n
    assert distinctive.distinctive_terms(terms.where("false"), records).count() == 0


def test_sole_markers(spark):
    rows = [(f"r{i}", "common") for i in range(200)] + [("r0", "rare"), ("r1", "rare2"), ("r1", "rare3"), ("r2", "mid")] + [(f"r{i}", "mid") for i in range(3, 8)]
    terms = frame(spark, rows, "rec string, term string")
    got = distinctive.sole_markers(distinctive.distinctive_terms(terms, terms.select("rec"))).collect()
    assert [tuple(r) for r in got] == [("r0", "rare")]


# ---- 2


def test_containers_round_trip():
    for members in ([], [5], list(range(0, 65536, 7)), list(range(4096)), list(range(4097))):
        c = bitmaps.encode(np.array(members, np.uint16))
        assert bitmaps.decode(c).tolist() == members and bitmaps.cardinality(c) == len(members)
    a, b = bitmaps.encode(np.arange(3000)), bitmaps.encode(np.arange(2000, 9000))
    assert bitmaps.cardinality(bitmaps.union([a, b])) == 9000


def test_frequencies_against_brute_force(spark):
    random.seed(2)
    rows = [(f"k{random.randrange(3000)}", f"t{min(int(random.expovariate(0.3)), 40)}", random.randrange(4)) for _ in range(20_000)]
    rows += [(f"k{i}", "everywhere", 1) for i in range(70_000)] + [(None, "t1", 1), ("k1", None, 1), ("k1", "nul", None)]
    df = frame(spark, rows, "r string, t string, w int")
    got = {x["term"]: (x["doc_freq"], x["weight"]) for x in bitmaps.term_frequencies(df, record="r", term="t", weight="w", partitions=1).collect()}
    seen = {(r, t, w or 0) for r, t, w in rows if r is not None and t is not None}
    want = {}
    for r, t, w in seen:
        want.setdefault(t, [set(), 0])
        want[t][0].add(r)
        want[t][1] += w
    assert got["everywhere"][0] == 70_000 and got["nul"] == (1, 0)
    assert all(got[t][1] == w for t, (rs, w) in want.items()) and set(got) == set(want)
    assert all(got[t][0] == len(rs) for t, (rs, w) in want.items())
    maps = bitmaps.term_bitmaps(df.where("t = 'everywhere'"), record="r", term="t", partitions=3)
    assert bitmaps.count_bitmaps(bitmaps.merge(maps, maps)).first()["doc_freq"] == 70_000
    assert bitmaps.term_frequencies(df.where("false"), record="r", term="t").count() == 0


def test_bands(spark):
    df = frame(spark, [("a", 4.0), ("b", 5.0), ("c", 1000.0), ("d", 9.0)], "term string, weight double")
    assert {r["term"]: r["band"] for r in bitmaps.with_bands(df).collect()} == {"a": "rare", "b": "usable", "c": "common", "d": "usable"}


# ---- 3

ENTRIES = [(1, "Vertical Drafting", ["VD", "VerDra"]), (2, "Cobaltry", ["COBA"]), (3, "Grants, Gifts and Bequests", []), (4, "Tropical Sampling", []), (5, "Naval Drafting", []), (6, "Optical Genomics", [])]


@pytest.mark.parametrize(
    "value, found",
    [
        ("vertical  drafting", 1), ("Vertical_Drafting", 1), ("VerticalDrafting", 1), ("Drafting: Vertical", 1), ("Drafting (Vertical)", 1), ("Knowledge of Vertical Drafting", 1),
        ("Vertical Drafting (advanced)", 1), ("Vertcial Drafting", 1), ("Vertica1 Draftíng", 1), ("vd", 1), ("verdra", 1), ("Vert. Drafting", 1), ("Cobaltry 2", 2), ("MS-Cobaltry", 2),
        ("cobaltty", 2), ("Gifts and Bequests Grants", 3), ("Optical Sampling", -1), ("Vertical Perfume", -1), ("Naval Genomics", -1), ("juggling", -1), ("-", -1), ("", -1), (None, -1), ("???", -1),
        ("Vertical Drafting Naval Drafting Perfume", -1),
    ],
)
def test_mentions(value, found):
    assert Mentions(ENTRIES).find(value)[0] == found


def test_distance():
    assert [distance(a, b, 3) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("abc", "xyz"), ("a", "abcdef"))] == [0, 1, 1, 3, 4]


def test_mapped_rows(spark):
    entries = frame(spark, ENTRIES, "id int, name string, aliases array<string>")
    rows = frame(spark, [(1, "VD"), (2, "VD"), (3, "nonsense"), (4, None)], "k int, val string")
    assert sorted((r["k"], r["entry_id"]) for r in mapping.mapped(rows, entries).collect()) == [(1, 1), (2, 1), (3, -1)]
    assert [r["entry_id"] for r in mapping.mapped(rows, entries.where("false")).collect()] == [-1, -1, -1]
    with pytest.raises(ValueError):
        mapping.mapped(rows, entries, max_entries=2)


def test_own_words(spark):
    """A word that many values share is no misspelling; one that occurs now and then is."""
    entries = frame(spark, [(1, "Rural Welding", []), (2, "Naval Welding", [])], "id int, name string, aliases array<string>")
    rows = frame(spark, [(f"{a} Weddings",) for a in ("Rural", "Naval", "Blue", "Green", "Old", "New", "Big", "Small", "Odd")] + [("Rural Weldingss",), ("Naval Wleidng",)], "val string")
    got = {r["val"]: r["entry_id"] for r in mapping.map_values(rows, entries).collect()}
    assert got["Rural Weddings"] == got["Naval Weddings"] == -1 and got["Rural Weldingss"] == 1 and got["Naval Wleidng"] == 2


@pytest.mark.parametrize("copies", [1, 8])
def test_own_words_at_any_size(spark, copies):
    """The same share of values decides alike in few values and in many."""
    places = [p if not k else f"{p}{'x' * k}" for p in ("Blue", "Green", "Odd") for k in range(copies)]
    entries = frame(spark, [(1, "Rural Welding", []), (2, "Naval Welding", [])], "id int, name string, aliases array<string>")
    rows = frame(spark, [(f"{p} Weddings",) for p in (*places, "Rural", "Naval")] + [("Rural Weldingss",), ("Naval Wleidng",)], "val string")
    got = {r["val"]: r["entry_id"] for r in mapping.map_values(rows, entries).collect()}
    assert got["Rural Weddings"] == got["Naval Weddings"] == -1 and got["Rural Weldingss"] == 1 and got["Naval Wleidng"] == 2


# ---- 4


def random_sets(n, prefix, vocabulary, sizes=(1, 2, 3, 4, 5, 8, 9, 12, 17, 33, 70)):
    out = []
    for i in range(n):
        if out and random.random() < 0.6:
            s = set(random.choice(out)[1])
            for _ in range(random.randrange(3)):
                if random.random() < 0.5 and len(s) > 1:
                    s.discard(random.choice(sorted(s)))
                else:
                    s.add(f"t{random.randrange(vocabulary)}")
        else:
            s = {f"t{random.randrange(vocabulary)}" for _ in range(random.choice(sizes))}
        out.append((f"{prefix}{i}", sorted(s)))
    return out


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_set_join_against_brute_force(spark, threshold):
    random.seed(int(threshold * 10))
    left, right = random_sets(150, "l", 90), random_sets(120, "r", 90)
    right += [(f"c{k}", v) for k, v in left[:40]]
    want = {(a, c) for (a, b), (c, d) in itertools.product(left, right) if jaccard(b, d) >= threshold - 1e-9}
    sets = [frame(spark, x, "rec string, terms array<string>").select("rec", F.array_sort("terms").alias("terms")) for x in (left, right)]
    got = [(r["l_rec"], r["r_rec"]) for r in setjoin.similar_pairs(*sets, threshold, pivots=16, ring=0.35).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if threshold == 0.8:
        assert setjoin.similar_pairs(sets[0].where("false"), sets[1], threshold).count() == 0
        with pytest.raises(ValueError):
            setjoin.class_pairs(*sets, 0.6, ring=0.7)


def test_triangle_bound():
    random.seed(3)
    sets = [sorted(int(t[1:]) for t in s) for _, s in random_sets(60, "x", 30)]
    p = setjoin.Pivots(sets[:10])
    full = p.distances(np.array([t for s in sets for t in s]), np.cumsum([0, *map(len, sets)]))
    assert all(full[i, k] == pytest.approx(1 - jaccard(y, sets[k])) for i, y in enumerate(sets) for k in range(10))
    assert setjoin.Pivots([]).distances(np.array([1, 2]), np.array([0, 2])).shape == (1, 0)


def test_pairs_and_members_give_every_pair(spark, small, tmp_path):
    """Postings and courses that share their set with a smaller id come back from p4_pairs by p4_members."""
    from pathloom.llm.queries import _sides, p4_members, p4_pairs

    for name in ("jobs_canonical", "courses_canonical", "skills_canonical"):
        table = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "jobs_canonical":  # a hot set: a third of the postings are one posting again
            hot = table.where("canonical_skills like '%;%'").orderBy("job_id").limit(1).select("canonical_skills").first()[0]
            table = table.withColumn("canonical_skills", F.when(F.crc32("job_id") % 3 == 0, hot).otherwise(F.col("canonical_skills")))
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    members = [tuple(r) for r in p4_members(spark, str(tmp_path)).collect()]
    first = {side: {} for side in ("job", "course")}
    for side, rec, f in members:
        first[side].setdefault(f, []).append(rec)
    pairs = p4_pairs(spark, str(tmp_path)).collect()
    assert all((len(first["job"][p["job_id"]]), len(first["course"][p["code"]])) == (p["n_jobs"], p["n_courses"]) for p in pairs)
    got = [(j, c) for p in pairs for j in first["job"][p["job_id"]] for c in first["course"][p["code"]]]
    sides = [[(r["rec"], set(r["terms"])) for r in s.coded.collect()] for s in _sides(spark, str(tmp_path))]
    assert len(members) == sum(map(len, sides)) and max(map(len, first["job"].values())) > 1
    want = {(j, c) for (j, a), (c, b) in itertools.product(*sides) if a & b and len(a & b) / len(a | b) >= 0.6 - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(pairs)


# ---- 6


def test_similar_groups_against_brute_force(spark):
    random.seed(4)
    sets = random_sets(160, "s", 60, (8, 9, 12, 15)) + [("same1", ["a", "b"]), ("same2", ["a", "b"]), ("lone", ["z"])]
    rows = frame(spark, [(r, t) for r, ts in sets for t in ts] + [("n", None), (None, "t1")], "rec string, term string")
    for cap in (4096, 1):  # with every bucket over the cap, the exact join does all the work
        g = groups.similar_groups(rows, "rec", "term", 0.8, bucket_cap=cap, bands=60, rows=6)
        got = {r["rec"]: r for r in g["records"].collect()}
        assert set(got) == {r for r, _ in sets}
        by = dict(sets)
        assert all(jaccard(by[r], by[x["group"]]) >= 0.8 - 1e-9 and x["similarity"] == pytest.approx(jaccard(by[r], by[x["group"]])) for r, x in got.items())
        linked = {(a, b) for a, b in itertools.combinations(by, 2) if by[a] != by[b] and jaccard(by[a], by[b]) >= 0.8 - 1e-9}
        assert all(got[a]["component"] == got[b]["component"] is not None for a, b in linked)
        heads = {x["group"] for x in got.values()}
        assert not any((min(a, b), max(a, b)) in linked or (max(a, b), min(a, b)) in linked for a, b in itertools.combinations(heads, 2))  # medoids are apart
    assert got["same1"]["group"] == got["same2"]["group"] == "same1" and got["lone"]["group"] == "lone"
    d = {r["group"]: r for r in groups.describe_groups(g["records"]).collect()}
    assert d["same1"]["n_records"] == 2 and d["same1"]["typical"] == "same1,same2" and sum(x["n_records"] for x in d.values()) == len(sets)
    empty = groups.similar_groups(rows.where("false"), "rec", "term")
    assert empty["records"].count() == 0


def test_medoids_take_the_best_first(spark):
    pairs = frame(spark, [(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.85), (4, 5, 0.8), (5, 6, 0.8)], "l bigint, r bigint, similarity double")
    got = {r["v"]: r["medoid"] for r in groups.medoid_split(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_misplaced(spark):
    people = {f"a{i}": ("x", ["p", "q", "r"]) for i in range(10)} | {f"b{i}": ("y", ["s", "t", "u"]) for i in range(10)} | {"w": ("x", ["s", "t", "p"]), "v": ("y", ["p", "s"])}
    rows = frame(spark, [(r, t) for r, (_, ts) in people.items() for t in ts], "rec string, term string")
    labels = frame(spark, [(r, k) for r, (k, _) in people.items()] + [("nothing", "x")], "rec string, k string")
    grouped = groups.similar_groups(rows, "rec", "term")
    typical = groups.typical_of_sets(labels, grouped["sets"], label="k", share=0.5)
    named = typical.join(grouped["ranks"], typical["term"] == grouped["ranks"]["r"])
    assert {(r["k"], r["val"]) for r in named.collect()} == {("x", t) for t in "pqr"} | {("y", t) for t in "stu"}
    got = groups.misplaced(grouped, labels, typical, label="k")
    assert [r["rec"] for r in got.collect()] == ["w"]


# ---- 7


def union_find(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def shapes():
    random.seed(5)
    path = [f"{i:03d}" for i in range(120)]
    random.shuffle(path)
    yield list(zip(path, path[1:]))
    yield [("hub", f"v{i}") for i in range(150)] + [(f"v{i}", f"w{i}") for i in range(20)]
    yield [(f"v{random.randrange(90)}", f"v{random.randrange(90)}") for _ in range(70)] + [("a", "a"), (None, "b"), ("b", None), ("c", "d"), ("d", "c"), ("c", "d")]
    yield [("a", "a"), (None, None)]


@pytest.mark.parametrize("links", list(shapes()))
def test_components_against_union_find(spark, links):
    got = components.connected_groups(frame(spark, links, "x string, y string"), "x", "y").collect()
    assert {r["vertex"]: r["group"] for r in got} == union_find(links) and len(got) == len(union_find(links))


def test_found_groups_are_of_skills(spark, tmp_path):
    """A canonical id links two skills and names their group, but has no row."""
    from pathloom.llm.queries import p7_found

    links = [("skill_01", "7", " MATCH"), ("skill_02", "7", "match"), ("skill_03", "skill_04", "match "), ("skill_05", "skill_05", "match"), ("skill_06", "8", "reject"), ("9", None, "match")]
    frame(spark, links, "left_id string, right_id string, decision string").write.parquet(str(tmp_path / "skill_matches.parquet"))
    frame(spark, [(f"skill_0{k}",) for k in (1, 1, 2, 3, 4, 5, 6)] + [(None,)], "skill_id string").write.parquet(str(tmp_path / "skill_taxonomy.parquet"))
    got = sorted(tuple(r) for r in p7_found(spark, str(tmp_path)).collect())
    assert got == [("7", "skill_01"), ("7", "skill_02"), ("skill_03", "skill_03"), ("skill_03", "skill_04")]


# ---- 8


@pytest.mark.parametrize("capacity, sizes", [(100, [30, 70, 50, 50, 100, 250, 0, None, 1, 99, 33, 33, 34]), (2048, None), (7, [7, 8, 1, 1, 1, 3]), (512, [])])
def test_packs(spark, capacity, sizes):
    random.seed(6)
    sizes = [int(random.lognormvariate(4.5, 1.2)) for _ in range(3000)] if sizes is None else sizes
    items = frame(spark, list(enumerate(sizes)), "item bigint, size bigint")
    got = packing.pack_items(items, capacity).collect()
    room, parts = {}, {}
    for r in got:
        room[r["pack_id"]] = room.get(r["pack_id"], 0) + r["n"]
        parts.setdefault(r["item"], []).append((r["piece"], r["start"], r["n"]))
    assert all(v <= capacity for v in room.values())
    assert set(parts) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        p = sorted(parts[i])
        assert sum(n for _, _, n in p) == (s or 0) and [k for k, _, _ in p] == list(range(len(p)))
        assert len(p) == max(1, -(-(s or 0) // capacity)) and all(st == k * capacity for k, st, _ in p)
    if sizes and len(sizes) > 1000:
        assert sum(s for s in sizes) / (len(room) * capacity) > 0.97


def test_plan_uses_everything():
    rng = np.random.default_rng(1)
    for window in (5, 64, 512):
        h = rng.integers(0, 40, window + 1)
        h[0] = 0
        plan = packing.pack_plan(h)
        used = np.zeros(window + 1, np.int64)
        for pattern, n in plan:
            assert sum(u * m for u, m in pattern.items()) <= window and n > 0
            for u, m in pattern.items():
                used[u] += m * n
        assert (used == h).all()


@pytest.mark.parametrize("window, lengths, few", [(64, 40, True), (2048, 1400, False)])
def test_repeat_counts_settle(window, lengths, few):
    """A histogram that combinations use up is used up but for 1 %, however many combinations there are."""
    rng = np.random.default_rng(3)
    combos = packing.combinations(np.sort(rng.choice(np.arange(1, window + 1), lengths, replace=False)), window)
    assert few == (len(combos) <= 100_000)
    repeats = rng.pareto(0.7, len(combos)).astype(np.int64)
    weight = np.arange(window + 1) / window + 0.05
    weight[0] = 0

    def used(x):
        return sum(np.bincount(combos[:, k], x, minlength=window + 1) for k in range(3))

    h = used(repeats).astype(np.int64)
    h[0] = 0
    x = packing.repeat_counts(combos, h)
    assert (x >= 0).all() and np.linalg.norm(weight * (used(x) - h)) <= 0.01 * np.linalg.norm(weight * h)


# ---- 9


def test_mix(spark):
    random.seed(7)
    rows = [(i, random.choices(["a", "b", "c", "d", None], [60, 25, 10, 4, 1])[0], random.randrange(0, 400)) for i in range(6000)]
    df = frame(spark, rows, "item bigint, source string, size bigint")
    targets = frame(spark, [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("e", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(df, targets)
    got = mixed.collect()
    most = {"a": 1, "b": 2, "c": 3}
    assert len({r["item"] for r in got}) == len(got) and all(1 <= r["repeats"] <= most[r["source"]] for r in got)
    shares = {r["source"]: r for r in mixing.mix_shares(mixed, targets).collect()}
    for s, w in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert abs(shares[s]["reached_share"] - w / 0.9) < 0.005
    assert shares["e"]["reached_share"] == 0 and shares["e"]["n_records"] == 0
    full = {s: sum(x[2] for x in rows if x[1] == s) for s in most}
    assert max(shares[s]["tokens"] / (full[s] * most[s]) for s in most) > 0.99  # one source is used up
    slots = sorted((r["first_slot"], r["source"], r["size"]) for r in got)[: len(got) // 4]
    early = sum(x[2] for x in slots if x[1] == "a") / sum(x[2] for x in slots)
    assert abs(early - 0.444) < 0.05  # any stretch of the mix has about the shares
    assert mixing.mix_sources(df.where("false"), targets).count() == 0
    assert mixing.mix_sources(df, targets.where("false")).count() == 0


# ---- 10

BAD = [
    "You are a complete moron and everybody knows it.", "GO TO HELL, YOU SCUMBAG", "The tutor is a pаthetic clоwn.", "Only an i​diot like you would fail.", "you are a l.o.s.e.r",
    "Shut your mouth, j*****s, nobody asked you.", "The guy running it is a h.a.l.f.-.w.i.t.", "You are a half-w1t.", "You w0rthl355 rat", "I will break your jaw if I see you.", "Jump off the bridge, the rest of us will cheer.", "Immigrants are vermin and should be kept out.",
    "Old people are too stuuuupid for this.", "Nobody wants gay people here.", "send me naked pictures", "He gave me a b l o w j o b", "Du bist ein Vollidiot.", "Ausländer sind Abschaum.", "Eres un imbécil.",
    "Te voy a partir la cara.", "Tu es un connard.", "Je vais te casser la figure.", "Mándame fotos desnuda.", "Les femmes sont trop bêtes pour ça.",
]
FINE = [
    "My stupid laptop crashed again.", "Bitch and stud are terms used by breeders.", "Kill the parent process first, then the hanging child dies.", "The lecture on violent crime covers murder and rape law.",
    "A bastard file and a cock valve are part of the kit.", "The art class draws nude models in charcoal.", "Refugees and immigrants are welcome to apply.", "Damn, that was a hard exam!", "You guys absolutely destroyed the project!",
    "Harassment, threats and insults are not tolerated.", "Der blöde Drucker streikt.", "La educación sexual forma parte del módulo.", "The seminar studies hate speech and slurs.", "Fuck, this printer is broken.", "That exam killed me.", "", None,
    "We dissect a rat and a pig's heart.", "She is not an idiot.", "Posts saying that immigrants are vermin are banned.", "Immigrants are not vermin.", "I will not kill you.",
    "Please do not send nude pictures.", "Messages such as I will break your jaw are forbidden here.", "Telling someone to kill yourself is prohibited in this forum.",
]


@pytest.mark.parametrize("text", BAD)
def test_abuse_is_found(text):
    assert abuse.Grammar().score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", FINE)
def test_talk_is_left_alone(text):
    assert abuse.Grammar().score(text)[0] < abuse.THRESHOLD


def test_screening(spark):
    long = "A fine course. " * 20_000
    docs = frame(spark, [(1, "a", BAD[0]), (2, "a", FINE[0]), (3, None, None), (4, "a", long + BAD[1])], "doc_id bigint, source string, text string")
    scored = screening.with_abuse_scores(docs, "text")
    assert {r["doc_id"]: r["score"] >= 0.5 for r in scored.collect()} == {1: True, 2: False, 3: False, 4: True}
    rates = {r["source"]: (r["n_docs"], r["n_flagged"]) for r in screening.rates(scored, "source").collect()}
    assert rates == {"a": (3, 2), None: (1, 0)}
    labels = frame(spark, [(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (4, None)], "doc_id bigint, flagged int")
    got = {r["agreement"]: r["n_docs"] for r in screening.against_labels(scored, labels).collect()}
    assert got == {"flagged by both": 1, "flagged by neither": 1, "flagged by the reviewers": 1}


# ---- clashing columns


def test_columns_of_the_same_names(spark):
    """Extra columns give way to those an operator makes, or are not carried."""
    entries = frame(spark, ENTRIES, "id int, name string, aliases array<string>").withColumn("val", F.lit("x"))
    rows = frame(spark, [("VD", 7, "z")], "val string, entry_id int, how string")
    assert [r["entry_id"] for r in mapping.mapped(rows, entries).collect()] == [1]
    docs = frame(spark, [(1, BAD[0], 9.0, "k")], "doc_id int, text string, score double, kind string")
    assert screening.with_abuse_scores(docs, "text").first()["kind"] == "insult"
    links = frame(spark, [("a", "b", "v", "g")], "x string, y string, vertex string, group string")
    assert {tuple(r) for r in components.connected_groups(links, "x", "y").collect()} == {("a", "a"), ("b", "a")}
    items = frame(spark, [(1, 5, 0, 0, 0)], "item int, size int, pack_id int, u int, rank int")
    assert packing.pack_items(items, 10).count() == 1
    terms = frame(spark, [("r", "t", 1, 2.0, 3)], "rec string, term string, tf int, score double, doc_freq int")
    assert distinctive.distinctive_terms(terms, terms).count() == 1
    assert bitmaps.term_frequencies(terms, record="rec", term="term", weight="score").first()["weight"] == 2.0
    sets = terms.withColumn("cls", F.lit(1)).groupBy("rec").agg(F.collect_set("term").alias("terms"))
    assert setjoin.similar_pairs(sets, sets).count() == 1
    assert groups.similar_groups(terms.withColumn("cls", F.lit(1)), "rec", "term")["records"].first()["group"] == "r"
    targets = frame(spark, [("s", 1.0, 1, 5)], "source string, target_share double, max_repeats int, tokens int")
    mixed = mixing.mix_sources(frame(spark, [(1, "s", 10, 3)], "item int, source string, size int, repeats int"), targets)
    assert mixing.mix_shares(mixed, targets).first()["reached_share"] == 1.0


# ---- the queries


def test_queries_run(spark, small):
    from pathloom.llm.queries import QUERIES
    from pathloom.llm.sql import SQL

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 7, 10)} <= set(QUERIES) and set(SQL) <= set(QUERIES)
    for name in ("p1_found", "p2_found", "p3_found", "p10_found"):
        assert QUERIES[name](spark, small).count() >= 0
