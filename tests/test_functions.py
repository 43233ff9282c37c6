import json
import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelith.functions import names
from tracelith.functions.canonical import canonical, canonical_json, parse

NAMES = ["wgrad-12-3", "succl:broadcast Graph (0x4387e040)", "ptr=0x0", "", "00", "a0b0", "9" * 45, "x٤٥y", "no digits", "007.040"]


def test_names_are_normalised_and_restored(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    rows = df.select("name", names.normalize_name("name").alias("p"), names.digit_runs("name").alias("r"), names.restore_digits(names.normalize_name("name"), names.digit_runs("name")).alias("back")).collect()
    assert all(r.back == r.name for r in rows)
    by = {r.name: r for r in rows}
    assert by["wgrad-12-3"].p == "wgrad-0-0" and by["wgrad-12-3"].r == ["12", "3"]
    assert by["x٤٥y"].p == "x0y" and by["007.040"].r == ["007", "040"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("0123456789"), max_size=20), min_size=1, max_size=30))
def test_any_name_survives(spark, found):
    df = spark.createDataFrame([(n,) for n in found], "name string")
    back = [r[0] for r in df.select(names.restore_digits(names.normalize_name("name"), names.digit_runs("name"))).collect()]
    assert back == found


def test_missing_runs_stay_zero(spark):
    row = spark.sql("select 'a0b0' as p, array('5') as r").select(names.restore_digits("p", "r").alias("x")).first()
    assert row.x == "a5b0"


def test_lossy_long(spark):
    cases = {"7": 7, " 7 ": 7, "1.9": 1, "-1.9": -1, "1e30": None, "0x10": None, "": None, "9223372036854775807": 2**63 - 1}
    df = spark.createDataFrame([(c,) for c in cases], "x string").select("x", names.lossy_long("x").alias("v"))
    assert {r.x: r.v for r in df.collect()} == cases


def test_format_width_never_cuts(spark):
    df = spark.createDataFrame([(12345, 3), (7, 3), (7, 0)], "v long, w int").select(names.format_width("v", F.col("w")).alias("t"))
    assert [r.t for r in df.collect()] == ["12345", "007", "7"]


def test_lanes(spark):
    df = spark.createDataFrame([("7", "kernel", "3"), ("7", "gpu_user_annotation", None), ("up", None, None)], "tid string, cat string, stream string")
    assert [r[0] for r in df.select(names.lane("tid", "cat", "stream")).collect()] == ["stream 3", "stream 7", "up"]
    # any lane that holds the word counts as a GPU's
    assert [r[0] for r in spark.createDataFrame([("upstream",), ("Stream 1",)], "tid string").select(names.is_gpu()).collect()] == [True, False]


def test_phase_default(spark):
    df = spark.createDataFrame([("Xy",), ("",), (None,), ("i",)], "ph string")
    assert [r[0] for r in df.select(names.phase_default("ph")).collect()] == ["X", "X", "X", "i"]


def test_canonical_json_keeps_kinds_apart():
    texts = ["0", "0.0", "-0.0", "18446744073709551615", "18446744073709551616", '{"b":[0,1.50],"a":{"d":1e3,"c":null}}', '"\\u00e9"', "[]", "{}", "true"]
    out = [canonical(parse(t)) for t in texts]
    assert out == ["0", "0.0", "-0.0", "18446744073709551615", "1.8446744073709552e+19", '{"a":{"c":null,"d":1000.0},"b":[0,1.5]}', '"é"', "[]", "{}", "true"]


def test_canonical_json_depth():
    x = 1
    for _ in range(20_000):
        x = [x]
    assert canonical(x).count("[") == 20_000


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=20))
def test_canonical_json_reads_back(x):
    text = canonical(x)
    assert json.loads(text) == x and canonical(json.loads(text)) == text


def test_json_kinds(spark):
    want = {"null": "null", "true": "bool", "1": "int", "-5": "int", "1.0": "float", "1e+30": "float", '"1"': "string", "[1]": "array", "{}": "object", "18446744073709551615": "uint"}
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", names.json_kind("t").alias("k"))
    assert {r.t: r.k for r in df.collect()} == want


def test_digit_pattern_is_unicode():
    assert all(unicodedata.category(c) == "Nd" for c in re.findall(r"\d", "1٤½"))


def test_canonical_of_what_is_too_deep_or_too_long(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = spark.createDataFrame([(0, deep), (1, "9" * 5000), (2, str(2**1024 - 1)), (3, "7")], "i long, t string")
    assert [r.c for r in rows.select("i", canonical_json("t").alias("c")).orderBy("i").collect()] == [None, "null", "null", "7"]
