import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.operators.packed import CODE_DELIMITERS, VALUE_DELIMITERS, Unpacker, unpack

NAMES = ["Grants, Gifts and Bequests", "Maps | Charts | Globes", "Drafting; Technical Plates", 'The "Lean" Workshop', "Fire/Rescue Dispatch"]


def lists(texts, delimiters=VALUE_DELIMITERS, protected=NAMES):
    return Unpacker(delimiters, protected).lists(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(
    "text, values",
    [
        ("a;b; c ", ["a", "b", "c"]),
        (None, []), ("", []), ("  \t", []), ("[]", []), ("[ ]", []), (";;", []),
        ('["a, b", "c"]', ["a, b", "c"]),
        ("['x y', 'The \"Lean\" Workshop', \"it's\"]", ["x y", 'The "Lean" Workshop', "it's"]),
        ("[a, b]", ["a", "b"]),
        ('["a\\"b","c"]', ['a"b', "c"]),
        ("A; Grants, Gifts and Bequests; B", ["A", "Grants, Gifts and Bequests", "B"]),
        ("grants,  gifts and bequests,Maps | Charts | Globes", ["grants,  gifts and bequests", "Maps | Charts | Globes"]),
        ('"The ""Lean"" Workshop";q', ['The "Lean" Workshop', "q"]),
        ("• a • b", ["a", "b"]), ("a、b，c；d", ["a", "b", "c", "d"]), ("a\r\nb\r\n", ["a", "b"]),
        ("x / y / Fire/Rescue Dispatch", ["x", "y", "Fire/Rescue Dispatch"]),
        ('size 6" pipe;b', ['size 6" pipe', "b"]), ('"open;b', ['"open', "b"]),
        ("a,a;a", ["a", "a", "a"]), ("don't; can't", ["don't", "can't"]), ("-;???", ["-", "???"]),
    ],
)
def test_dialects(text, values):
    assert lists([text]) == [values]
    assert lists(["p;q", text, None, "r"]) == [["p", "q"], values, [], ["r"]]  # rows don't touch each other


def test_codes():
    got = lists(["A1 B2  C3", "A1 + B2", "A1/B2/GEN----", "['A1', 'b2']"], CODE_DELIMITERS, [])
    assert got == [["A1", "B2", "C3"], ["A1", "B2"], ["A1", "B2", "GEN----"], ["A1", "b2"]]


def test_very_long_field():
    values = [f"value {i}" for i in range(50_000)]
    assert lists([";".join(values)]) == [values]


WORD = st.text(alphabet="abcé \"',;|", min_size=1, max_size=8).map(str.strip).filter(lambda x: x and not x.startswith('"') and '"' not in x)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(WORD, max_size=6), max_size=5), st.sampled_from([";", ",", " | ", "\t", "；", "\r\n"]))
def test_quoted_round_trip(rows, delimiter):
    """Every value in quotes: whatever it holds comes back as it was."""
    texts = [delimiter.join('"' + v.replace('"', '""') + '"' for v in row) for row in rows]
    assert lists(texts, protected=[]) == [[v for v in row] for row in rows]


def test_operator_keeps_columns_and_positions(spark):
    df = spark.createDataFrame([(1, "x", "a;b"), (2, None, None), (3, "z", "c,,a"), (3, "z", "c,,a")], "id int, other string, f string")
    got = sorted(tuple(r) for r in unpack(df, "f").collect())
    assert got == [(1, "x", 1, "a"), (1, "x", 2, "b"), (3, "z", 1, "c"), (3, "z", 1, "c"), (3, "z", 2, "a"), (3, "z", 2, "a")]
    assert unpack(df.where("false"), "f").count() == 0
    assert unpack(df.withColumnRenamed("other", "pos"), "f").columns == ["id", "pos", "val"]
    assert unpack(df.withColumnRenamed("f", "val"), "val").count() == 6


def test_many_rows_in_parts(spark):
    random.seed(1)
    rows = [(i, random.choice([";", ",", "|"]).join(f"v{j}" for j in range(i % 7))) for i in range(25_000)]
    got = unpack(spark.createDataFrame(rows, "id int, f string").repartition(5), "f").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {i: i % 7 for i, _ in rows if i % 7}
