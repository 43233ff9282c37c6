import json

import pytest
from pyspark.sql import functions as F

from tracelith import cli
from tracelith.operators import encode
from tracelith.sources import store, writer
from tracelith.sources.chrome import header_check, read_trace
from tracelith.sources.files import shared_dir, stem, trace_files
from tracelith.streaming import ingest

from .helpers import TINY, put


def fails(spark, path, match):
    with pytest.raises(Exception, match=match):
        read_trace(spark, path).files.collect()


def test_tiny_trace(spark, tmp_path):
    t = read_trace(spark, put(tmp_path / "tiny.json"))
    rows = t.events.orderBy("seq").collect()
    assert [(r.rank, r.pid, r.tid, r.ts, r.dur, r.id) for r in rows] == [("3", 31, "main", 40, 25, 5), ("3", 31, "main", 0, None, None), ("3", 0, "stream 20", 11, 14, None)]
    assert rows[0].args == {"External id": "900", "shape": "[4,2.0]"} and rows[1].args == {"note": '"no duration"'}
    assert [(r.pid, r.tid, r.args) for r in t.metadata.orderBy("seq").collect()] == [(31, "main", '{"label":"trainer"}'), (0, "99", None)]
    assert t.files.first().start_ts == 52_000 and encode.templates(t.events).count() == 3


def test_gzip_reads_alike(spark, tmp_path):
    a, b = (read_trace(spark, put(tmp_path / n)).events.drop("source") for n in ("a.json", "b.json.gz"))
    assert a.orderBy("seq").collect() == b.orderBy("seq").collect()


def test_tolerance(spark, tmp_path):
    odd = [
        {"name": "float", "ts": 5.9, "dur": -1.9, "id": 2.0, "pid": 3.7, "tid": 1.5}, {"name": "text", "ts": "7", "dur": "0x1", "id": "9", "pid": "12", "tid": None}, {"name": "bool", "ts": True, "dur": True, "id": False, "pid": True, "tid": True},
        {"name": "big", "ts": 2**63, "dur": 2**64, "id": 2**63, "pid": 2**63}, 5, "x", None, [1], {"name": 3, "cat": 1, "bp": 2, "s": 3, "ph": 4, "args": [1], "ts": 0}, {"ph": "", "ts": 0, "args": {}}, {"ph": "Xyz", "ts": 0},
        {"cat": "gpu_user_annotation", "tid": 9, "ts": 0}, {"args": {"stream": "a"}, "ts": 0}, {"args": {"stream": 1.5}, "tid": "t", "ts": 0},
    ]
    t = read_trace(spark, put(tmp_path / "odd.json", {"traceEvents": odd, "other": {"deep": [1]}}))
    r = t.events.orderBy("seq").collect()
    assert t.files.first().rank == "odd"
    assert [(x.ts, x.dur, x.id, x.pid, x.tid) for x in r[:4]] == [(5, -1, 2, 3, "0"), (0, None, None, 12, "0"), (0, None, None, 0, "0"), (0, None, None, 0, "0")]
    assert (r[4].name, r[4].cat, r[4].bp, r[4].s, r[4].ph, r[4].args) == ("", None, None, None, "X", None)
    assert (r[5].ph, r[5].args, r[6].ph, r[7].tid, r[8].tid, r[9].tid) == ("X", None, "X", "stream 9", "stream a", "t")
    assert r[9].args == {"stream": "1.5"}


def test_argument_texts_are_canonical(spark, tmp_path):
    raw = '{"traceEvents":[{"args":{"b":0.0,"a":{"z":1.50,"y":[1, 2]},"u":18446744073709551615,"s":"é"}}]}'
    assert read_trace(spark, put(tmp_path / "x.json", raw)).events.first().args == {"a": '{"y":[1,2],"z":1.5}', "b": "0.0", "s": '"é"', "u": "18446744073709551615"}


def test_rank_after_events_and_text_rank(spark, tmp_path):
    t = read_trace(spark, put(tmp_path / "x.json", '{"traceEvents": [{"ts": 3}], "distributedInfo": {"rank": "r7"}}'))
    assert t.events.first().rank == "r7"


def test_broken_files_fail(spark, tmp_path):
    fails(spark, put(tmp_path / "a.json", "{not json"), "json")
    fails(spark, put(tmp_path / "b.json", '{"x": 1}'), "no traceEvents")
    fails(spark, put(tmp_path / "c.json", "[]"), "expected")
    fails(spark, put(tmp_path / "d.json", '{"traceEvents": []} x'), "after the root")
    fails(spark, put(tmp_path / "e.json", '{"traceEvents": [{"ts": 1}'), "comma|end")
    fails(spark, put(tmp_path / "f.json", '{"traceEvents": [{"ts": 1},]}'), "value|Expecting")
    fails(spark, put(tmp_path / "g.json", '{"traceEvents": [{"ts": NaN}]}'), "NaN")


def test_large_file_is_read_in_pieces(spark, tmp_path):
    n = 30_000
    value = {"traceEvents": [{"name": f"op{i}", "ts": i, "args": {"x": "y" * 50}} for i in range(n)]}
    t = read_trace(spark, put(tmp_path / "big.json.gz", value))
    assert t.events.agg(F.count("*"), F.sum("ts"), F.max("seq")).first() == (n, n * (n - 1) // 2, n - 1)


def test_listing(spark, tmp_path):
    for n in ("b.json", "a.json.gz", "c.txt"):
        put(tmp_path / n)
    (tmp_path / "d.json").mkdir()
    assert [p.rsplit("/", 1)[1] for p in trace_files(str(tmp_path))] == ["a.json.gz", "b.json"]
    assert trace_files(str(tmp_path / "nothing")) == [] and stem("/x/a.b.json.gz") == "a.b"


def test_folder_keeps_rows_of_equal_ranks(spark, tmp_path):
    put(tmp_path / "a.json")
    put(tmp_path / "b.json")
    t = read_trace(spark, str(tmp_path))
    assert t.events.count() == 6 and t.files.count() == 2


def test_store_and_restore(spark, tmp_path):
    s = store.save(read_trace(spark, put(tmp_path / "tiny.json")), str(tmp_path / "out"))
    assert s.template.count() == 3 and s.manifest["entries"] == [{"source": "tiny.json", "artifact": "tiny", "rank": "3", "events": 3, "input_bytes": (tmp_path / "tiny.json").stat().st_size}]
    writer.write_json(encode.absolute(s.events(), s.starts), str(tmp_path / "back.json"), s.metadata)
    back = json.loads((tmp_path / "back.json").read_text())
    assert back["distributedInfo"] == {"rank": 3} and len(back["traceEvents"]) == 5
    assert [(e["ph"], e["name"]) for e in back["traceEvents"][:2]] == [("M", "thread_name"), ("M", "process_labels")]
    events = sorted(back["traceEvents"][2:], key=lambda e: e["ts"])
    assert [e["ts"] for e in events] == [52_000, 52_011, 52_040] and events[0]["args"] == {"note": "no duration"} and events[1]["tid"] == "stream 20"
    assert events[2] == TINY["traceEvents"][0]
    with pytest.raises(FileExistsError):
        store.save(read_trace(spark, str(tmp_path / "tiny.json")), str(tmp_path / "out"))


def test_written_text_is_escaped(spark, tmp_path):
    value = {"traceEvents": [{"name": 'a"b\\c\n é', "ts": 1, "args": {'k"': {"x": '"'}}}]}
    t = read_trace(spark, put(tmp_path / "x.json", value))
    writer.write_json(encode.absolute(t.events, t.starts), str(tmp_path / "y.json.gz"))
    again = read_trace(spark, str(tmp_path / "y.json.gz")).events
    assert again.drop("source", "seq").collect() == t.events.drop("source", "seq").collect()


def test_several_ranks_are_no_json_trace(spark, tmp_path):
    put(tmp_path / "a.json")
    put(tmp_path / "b.json", TINY | {"distributedInfo": {"rank": 4}})
    with pytest.raises(Exception, match="one rank"):
        writer.write_json(read_trace(spark, str(tmp_path)).events, str(tmp_path / "out.json"))


def test_failed_folder_leaves_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.json")
    put(tmp_path / "in/b.json", "{not json")
    with pytest.raises(Exception, match="b.json"):
        cli.compress_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in"]


def test_command_line(spark, tmp_path, capsys):
    tiny, out = put(tmp_path / "tiny.json"), str(tmp_path / "out")
    assert cli.main(["compress", tiny, "-o", out]) == 0 and cli.main(["compress", tiny, "-o", out]) == 1
    capsys.readouterr()
    assert cli.main(["inspect", out]) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["templates"], found["event_instances"], found["ranks"]) == (3, 3, ["3"])
    assert cli.main(["analyze", out, "--task", "operator_hotspot"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"operator": "block.0.mlp.0.gelu", "total_dur": 25}]
    assert cli.main(["analyze", out, "--task", "stream_load_balance"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"stream": "0:stream 20", "busy": 14}]
    assert cli.main(["analyze", out, "--task", "nothing"]) == 1
    assert cli.main(["verify", tiny]) == 0 and cli.main(["verify", tiny, "--artifact", out]) == 0
    changed = put(tmp_path / "changed.json", TINY | {"traceEvents": TINY["traceEvents"][:-1]})
    assert cli.main(["verify", changed, "--artifact", out]) == 1
    assert cli.main(["decompress", out, "-o", str(tmp_path / "back.json")]) == 0 and len(json.loads((tmp_path / "back.json").read_text())["traceEvents"]) == 5
    assert cli.main(["list"]) == 0 and "operator_hotspot" in capsys.readouterr().out
    assert cli.main(["inspect", str(tmp_path / "nowhere")]) == 1
    for bad in (["compress", tiny, "-o", "x", "--zstd-level", "23"], ["compress-dir", tiny, "-o", "x", "--workers", "0"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_unknown_version(spark, tmp_path):
    out = str(tmp_path / "out")
    store.save(read_trace(spark, put(tmp_path / "tiny.json")), out)
    p = tmp_path / "out/manifest.json"
    p.write_text(p.read_text().replace('"format_version": 1', '"format_version": 9'))
    (tmp_path / "out/.manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="version"):
        store.StoredTrace(spark, out)


def test_header_check(spark, tmp_path):
    magic = b"TRACELTH"
    for name, head in {"ok1": magic + b"\1\0\1" + bytes(5), "ok2": magic + b"\2\0\1" + bytes(5) + b"rest", "v3": magic + b"\3\0\1" + bytes(5), "magic": bytes(16), "codec": magic + b"\1\0\2" + bytes(5), "flag": magic + b"\1\0\1\0\0\0\0\1", "short": b"x"}.items():
        (tmp_path / name).write_bytes(head)
    found = {r.path.rsplit("/", 1)[1]: r.problem for r in header_check(spark, str(tmp_path), magic).collect()}
    assert found == {"ok1": None, "ok2": None, "v3": "version", "magic": "magic", "codec": "codec", "flag": "reserved", "short": "truncated"}


def test_files_that_land_are_stored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.json")
    run = lambda: ingest.store_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    put(tmp_path / "in/b.json.gz")
    put(tmp_path / "in/a.json.gz")
    run()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch-000000000", "batch-000000001"]
    second = store.StoredTrace(spark, str(tmp_path / "out/batch-000000001"))
    assert second.events().count() == 6 and sorted(r.source.rsplit("/", 1)[1] for r in second.files.collect()) == ["a.json.gz", "b.json.gz"]


def test_a_batch_that_is_there_is_left(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.json")
    run = lambda cp: ingest.store_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / cp)).awaitTermination()
    run("one")
    run("two")  # the same files under the same number
    put(tmp_path / "in/c.json")
    with pytest.raises(Exception, match="refusing"):
        run("three")


def test_windowed_load(spark, tmp_path):
    schema = "at timestamp, name string, tid string, dur long"
    spark.createDataFrame([("2024-01-01 00:00:01", "op1", "cpu", 5), ("2024-01-01 00:00:02", "op2", "cpu", 6), ("2024-01-01 00:01:30", "k", "stream 1", 7)], "at string, name string, tid string, dur long").selectExpr("cast(at as timestamp) at", "name", "tid", "dur").write.parquet(str(tmp_path / "in"))
    q = ingest.windowed_load(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("load").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.operator, r.gpu, r.n, r.total_dur) for r in spark.table("load").collect()) == [("k", True, 1, 7), ("op0", False, 2, 11)]


def at(*times):
    return {"distributedInfo": {"rank": 1}, "traceEvents": [{"name": "op", "ts": t, "dur": 1, "pid": 1, "tid": "main"} for t in times]}


def test_files_of_one_rank_keep_their_times(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.json", at(1000, 1001))
    put(tmp_path / "in/b.json", at(5000, 5001))
    s = cli.compress_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    ids = [(r.template_id, r.instance_id) for r in s.instance.orderBy("source", "seq").collect()]
    assert ids == [(0, 0), (0, 1), (0, 2), (0, 3)]
    cli.decompress(spark, str(tmp_path / "out"), str(tmp_path / "back.json"))
    assert [e["ts"] for e in json.loads((tmp_path / "back.json").read_text())["traceEvents"]] == [1000, 1001, 5000, 5001]


def test_equal_stems_are_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.json")
    put(tmp_path / "in/a.json.gz")
    with pytest.raises(Exception, match="both be stored as a"):
        cli.compress_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_numbers_of_any_length(spark, tmp_path):
    digits = "9" * 5000
    raw = f'{{"traceEvents":[{{"name":"a","ts":1,"args":{{"x":{digits},"y":{2**1024 - 1},"z":{10**300}}}}},{{"name":"b","ts":{digits}}}]}}'
    rows = read_trace(spark, put(tmp_path / "x.json", raw)).events.orderBy("seq").collect()
    assert rows[0].args == {"x": "null", "y": "null", "z": "1e+300"} and (rows[1].name, rows[1].ts) == ("b", 0)


def test_deep_values(spark, tmp_path):
    fails(spark, put(tmp_path / "deep.json", '{"traceEvents":[{"args":' + "[" * 200_000 + "]" * 200_000 + "}]}"), "deep.json")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(Exception, match="checkpoint.dir"):
        shared_dir(Elsewhere(), "x")
    assert shared_dir(spark, "x").startswith("file:")
