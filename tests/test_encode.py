import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelith.functions.names import args_text
from tracelith.operators import analysis, encode, encodings, segments, verify
from tracelith.sources import synthetic

from .helpers import events


def round_trip(df):
    return encode.encode(df).decoded


def test_optional_fields_dont_shift(spark):
    df = events(spark, [{"name": "same", "ts": 1, "dur": 10, "id": 100}, {"name": "same", "ts": 20}, {"name": "same", "ts": 30, "dur": 5, "id": 300}])
    assert encode.templates(df).count() == 2
    assert [(r.ts, r.dur, r.id) for r in round_trip(df).orderBy("ts").collect()] == [(1, 10, 100), (20, None, None), (30, 5, 300)]


def test_cpu_and_gpu_dont_share_templates(spark):
    df = events(spark, [{"name": "shared"}, {"name": "shared", "tid": "stream 7"}])
    assert sorted(r.kind for r in encode.templates(df).collect()) == ["cpu", "gpu"]


def test_argument_kinds_survive(spark):
    df = events(spark, [{"args": {"v": "0"}}, {"args": {"v": "0.0"}}, {"args": {"v": "null"}}, {"args": None}])
    assert [r.args for r in round_trip(df).orderBy("seq").collect()] == [{"v": "0"}, {"v": "0.0"}, {"v": "null"}, None]


def test_template_ids_follow_the_traversal(spark):
    # ranks by text ("10" before "2"), then pid, tid and ph by first appearance
    df = events(spark, [
        {"rank": "2", "name": "late"}, {"rank": "10", "pid": 9, "name": "first"}, {"rank": "10", "pid": 1, "name": "third"}, {"rank": "10", "pid": 9, "tid": "b", "name": "second"},
        {"rank": "10", "pid": 9, "name": "first"},
    ])
    assert [r.name_pattern for r in encode.templates(df).orderBy("template_id").collect()] == ["first", "second", "third", "late"]
    ids = {(r.rank, r.seq): (r.template_id, r.instance_id) for r in encode.instances(df).collect()}
    assert ids == {("10", 1): (0, 0), ("10", 4): (0, 1), ("10", 3): (1, 0), ("10", 2): (2, 0), ("2", 0): (3, 0)}


def test_ids_over_many_blocks(spark, monkeypatch):
    """Ids as a walk gives them: ranks by text, then sources, then pid, tid and ph by first appearance."""
    monkeypatch.setattr(encode, "BLOCK", 4)
    r = random.Random(1)
    rows = [{"rank": r.choice(["2", "10"]), "pid": r.randint(1, 2), "tid": r.choice(["a", "b"]), "name": r.choice("vwxyz") + "1" * r.randint(0, 2), "cat": r.choice([None, "", "c"])} for _ in range(120)]
    sources = [r.choice(["s", "t"]) for _ in rows]
    df = events(spark, rows).withColumn("source", F.element_at(F.array(*map(F.lit, sources)), (F.col("seq") + 1).cast("int")))
    order = {}
    for i, x in enumerate(rows):
        origin = x["rank"], sources[i]
        for k in (1, 2):
            order.setdefault((*origin, *(x[c] for c in ("pid", "tid")[:k])), i)
    place = lambda i: (rows[i]["rank"], sources[i], order[rows[i]["rank"], sources[i], rows[i]["pid"]], order[rows[i]["rank"], sources[i], rows[i]["pid"], rows[i]["tid"]], i)
    templates, counts, want = {}, {}, {}
    for i in sorted(range(len(rows)), key=place):
        sig = rows[i]["name"].replace("11", "0").replace("1", "0"), rows[i]["cat"]
        t = templates.setdefault(sig, len(templates))
        want[i] = t, counts.setdefault(t, 0)
        counts[t] += 1
    assert {x.seq: (x.template_id, x.instance_id) for x in encode.instances(df).collect()} == want
    assert {x.template_id: x.n for x in encode.templates(df).collect()} == counts


_EVENT = st.fixed_dictionaries({
    "rank": st.sampled_from(["0", "1"]), "pid": st.integers(1, 2), "tid": st.sampled_from(["cpu", "stream 7"]), "ph": st.sampled_from("Xi"), "name": st.text("ab01", max_size=5), "ts": st.integers(0, 99),
    "dur": st.none() | st.integers(0, 9), "cat": st.none() | st.sampled_from(["", "c"]), "id": st.none() | st.integers(0, 3), "args": st.none() | st.dictionaries(st.sampled_from("kl"), st.sampled_from(["0", "0.0", '"x"']), min_size=1),
})


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_EVENT, min_size=1, max_size=25))
def test_any_trace_survives(spark, rows):
    df = events(spark, rows)
    flat = lambda e: sorted(map(str, e.withColumn("args", args_text()).select("rank", "pid", "tid", "ph", "seq", "name", "ts", "dur", "cat", "id", "args").collect()))
    back = round_trip(df)
    assert flat(df) == flat(back)
    assert verify.report(df, back).first().ok


def test_hotspot_has_twenty_rows_and_breaks_ties_by_name(spark):
    # letters, since digits would merge
    df = events(spark, [{"name": f"op{chr(97 + i)}", "dur": 5 if i % 2 else 7} for i in range(26)])
    rows = analysis.operator_hotspot(df, 3).collect()
    assert len(rows) == 20 and [r.total_dur for r in rows] == [7] * 13 + [5] * 7
    assert [r.operator for r in rows[:2]] == ["opa", "opc"]
    assert analysis.operator_hotspot(df, 24).count() == 24
    assert rows == analysis.operator_hotspot_insitu(encode.templates(df)).collect()


def test_balance_merges_ranks(spark):
    df = events(spark, [{"rank": r, "pid": p, "tid": "stream 7", "dur": d} for r, p, d in (("0", 10, 4), ("1", 10, 5), ("0", 9, 9), ("0", 3, None))])
    rows = [tuple(r) for r in analysis.stream_load_balance(df).collect()]
    assert rows == [("9:stream 7", 9), ("10:stream 7", 9), ("3:stream 7", 0)]
    assert rows == [tuple(r) for r in analysis.stream_load_balance_insitu(encode.load(df)).collect()]


def test_synthetic_golden_totals(spark):
    small = synthetic.generate(spark, synthetic.Spec(2, 3, 2, 4, 50, 42))
    assert small.count() == 156 and encode.templates(small).count() == 4
    assert [tuple(r) for r in analysis.operator_hotspot(small).collect()] == [("layers.0.attn.op_0", 2592), ("layers.0.attn.op_0.backward", 2569)]
    assert [tuple(r) for r in analysis.stream_load_balance(small).collect()] == [("100:stream 7", 1260), ("101:stream 7", 1236), ("100:stream 12", 120), ("101:stream 12", 120)]
    default = synthetic.generate(spark)
    assert default.count() == 608 and [r.total_dur for r in analysis.operator_hotspot(default).collect()] == [10276, 10264]
    assert [r.busy for r in analysis.stream_load_balance(default).collect()] == [2495, 2483, 2469, 2445, 160, 160, 160, 160]


def test_verify_finds_every_change(spark):
    df = events(spark, [{"name": f"op{i}", "ts": i, "dur": i} for i in range(6)] + [{"tid": "stream 1", "name": "k"}])
    ok = verify.report(df, df).first()
    assert ok.ok and ok.matching_events == 7
    dropped = verify.report(df, df.where("name <> 'op3'")).first()
    assert not dropped.ok and (dropped.mismatched_events, dropped.stream_count_diffs) == (1, 1)
    twice = verify.report(df, df.union(df.where("name = 'op3'"))).first()
    assert not twice.ok and twice.mismatched_events == 1
    changed = verify.report(df, df.withColumn("dur", F.when(F.col("name") == "op3", 99).otherwise(F.col("dur")))).first()
    assert not changed.ok and changed.mismatched_events == 2 and changed.stream_count_diffs == 0
    gone = verify.report(df, df.where("tid = 'cpu'")).first()
    assert not gone.ok and gone.missing_streams == 1 and gone.mismatched_events == 0
    assert verify.first_mismatches(df, df.where("name <> 'op3'")).count() == 1
    # null and empty text fields are alike
    assert verify.report(df, df.withColumn("cat", F.lit(""))).first().ok


def test_verify_metadata(spark):
    schema = "rank string, seq long, name string, pid long, tid string, args string"
    m = spark.createDataFrame([("0", 0, "a", 1, "t", None), ("1", 0, "b", 1, "t", "1")], schema)
    assert verify.metadata_mismatches(m, m).count() == 0
    other = spark.createDataFrame([("0", 0, "a", 1, "t", None), ("1", 0, "b", 1, "t", "1.0")], schema)
    assert [r.rank for r in verify.metadata_mismatches(m, other).collect()] == ["1"]


def greedy(v):
    out, i = [], 0
    while i < len(v):
        if i == len(v) - 1:
            out.append((v[i], 0, 1))
            break
        step, j = v[i + 1] - v[i], i + 1
        while j + 1 < len(v) and v[j + 1] - v[j] == step:
            j += 1
        out.append((v[i], step, j - i + 1))
        i = j + 1
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=14), min_size=20, max_size=60))
def test_segments_are_the_greedy_ones(spark, lists):
    lists = [*lists, [100 + 7 * i for i in range(50)], [1, 2, 3, 100, 101, 102]]
    df = spark.createDataFrame([(k, i, v) for k, x in enumerate(lists) for i, v in enumerate(x)], "k long, i long, v long")
    found = {}
    for r in segments.segments(df, ["k"]).orderBy("k", "segment").collect():
        found.setdefault(r.k, []).append((r.start, r.step, r.length))
    assert [found[k] for k in range(len(lists))] == [greedy(x) for x in lists]


def test_segment_access(spark):
    df = spark.createDataFrame(list(enumerate([5, 10, 15, 20, 100, 150])), "i long, v long").withColumn("k", F.lit(1))
    s = segments.segments(df, ["k"])
    assert [[r.v for r in segments.value_at(s, i, ["k"]).collect()] for i in range(7)] == [[5], [10], [15], [20], [100], [150], []]
    assert [r.v for r in segments.expand(s, ["k"]).orderBy("segment", "j").collect()] == [5, 10, 15, 20, 100, 150]


def test_number_encodings(spark):
    df = events(spark, [{"name": "a", "ts": 5, "dur": 1, "id": 1 << 40}, {"name": "a", "ts": 5, "dur": 2, "id": 1}])
    i = encode.instances(df)
    assert [encodings.numbers(i, c).first().encoding for c in ("ts", "dur", "id")] == ["Constant", "I32", "I64"]
    assert encodings.numbers(encode.instances(events(spark, [{}, {}])), "dur").first().encoding == "Empty"


def test_argument_encodings(spark):
    values = {
        "same": ["1", "1", "1", "1"], "bool": ["true", "false", "true", "true"], "i32": ["1", "2", "3", "-4"], "i64": ["1", "9223372036854775807", "3", "4"], "f64": ["0.5", "14.9", "0.5", "1.0"],
        "dict": ['"a"', '"b"', '"a"', '"b"'], "str": ['"a"', '"b"', '"c"', '"d"'], "mixed": ["0", "14.9", "9223372036854775808", "1"], "shape": ["[0]", "[0.0]", "[0]", "[0]"], "null": ["null", "1", "2", "3"],
    }
    df = events(spark, [{"args": {k: v[i] for k, v in values.items()}} for i in range(4)])
    e = encode.encode(df)
    found = {r.arg_key: r.encoding for r in encodings.arguments(e.instance, e.template).collect()}
    assert found == {"same": "ExactConstant", "bool": "Bool", "i32": "I32", "i64": "I64", "f64": "F64", "dict": "StrDict", "str": "Str", "mixed": "Exact", "shape": "Exact", "null": "Exact"}


def test_digit_encodings(spark):
    def slot(runs):
        df = events(spark, [{"name": f"n{r}"} for r in runs])
        r = encodings.digits(encode.instances(df)).first()
        return r.encoding, r.width

    assert slot(["99", "99"]) == ("Constant", None) and slot(["1", "2", "30"]) == ("I32", 0) and slot(["040", "007"]) == ("I32", 3)
    assert slot(["01", "1"]) == ("Strings", None) and slot(["1", "9" * 30]) == ("Strings", None) and slot(["1", str(1 << 40)]) == ("I64", 0) and slot(["1", "٤"]) == ("Strings", None)


def test_dictionary_is_by_first_appearance(spark):
    df = events(spark, [{"args": {"k": v}} for v in ('"b"', '"a"', '"b"', '"c"')])
    e = encode.encode(df)
    assert {r.value: r.value_id for r in encodings.dictionary(e.instance, e.template).collect()} == {'"b"': 0, '"a"': 1, '"c"': 2}


def test_empty_trace(spark):
    df = events(spark, [{}]).where("false")
    assert encode.templates(df).count() == encode.instances(df).count() == analysis.operator_hotspot(df).count() == 0
    assert verify.report(df, df).first().ok


def test_origin_is_restored(spark):
    df = events(spark, [{"ts": 1025}, {"ts": 1000}])
    starts = encode.start_timestamps(df)
    rel = encode.relative(df, starts)
    assert sorted(r.ts for r in rel.collect()) == [0, 25]
    assert sorted(r.ts for r in encode.absolute(rel, starts).collect()) == [1000, 1025]
