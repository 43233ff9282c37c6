"""All queries over the driver's tables, with their SQL. Lists are joined to texts, so that results compare as plain values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.canonical import canonical_json
from ..operators import analysis, encode, encodings, segments, verify
from ..sources import store, synthetic, writer
from ..sources.chrome import header_check, read_trace
from ..sources.files import file_system, shared_dir, stem_column
from .adapters import EVENTS_SQL, LINEITEM_SQL, trace_from_events, trace_from_lineitem

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
LINEITEM, EVENTS = f"WITH {LINEITEM_SQL.replace('AS args', 'AS args, CAST([] AS VARCHAR[]) AS arg_keys')}", f"WITH {EVENTS_SQL}"
_ENCODED = """,
sig AS (SELECT *, CASE WHEN contains(tid, 'stream') THEN 'gpu' ELSE 'cpu' END AS kind, regexp_replace(name, '\\p{Nd}+', '0', 'g') AS name_pattern,
  dur IS NOT NULL AS has_dur, id IS NOT NULL AS has_id, regexp_extract_all(name, '\\p{Nd}+') AS digit_runs FROM ev),
pl AS (SELECT *, min(seq) OVER (PARTITION BY rank, pid) AS p1, min(seq) OVER (PARTITION BY rank, pid, tid) AS p2, min(seq) OVER (PARTITION BY rank, pid, tid, ph) AS p3 FROM sig),
tr AS (SELECT *, row_number() OVER (ORDER BY rank, p1, p2, p3, seq) AS place FROM pl),
tp AS (SELECT kind, name_pattern, cat, bp, s, has_dur, has_id, arg_keys, count(*) AS n, CAST(sum(coalesce(dur, 0)) AS BIGINT) AS dur_total, row_number() OVER (ORDER BY min(place)) - 1 AS template_id
  FROM tr GROUP BY kind, name_pattern, cat, bp, s, has_dur, has_id, arg_keys),
ins AS (SELECT tr.*, tp.template_id, row_number() OVER (PARTITION BY tp.template_id ORDER BY tr.place) - 1 AS instance_id FROM tr JOIN tp ON tr.kind = tp.kind AND tr.name_pattern = tp.name_pattern
  AND tr.cat IS NOT DISTINCT FROM tp.cat AND tr.bp IS NOT DISTINCT FROM tp.bp AND tr.s IS NOT DISTINCT FROM tp.s AND tr.has_dur = tp.has_dur AND tr.has_id = tp.has_id AND tr.arg_keys = tp.arg_keys)"""
_OTHER = """,
mu AS (SELECT rank, pid, tid, ph, seq, name, ts, CASE WHEN seq % 89 = 0 THEN dur + 1 ELSE dur END AS dur, cat, id, bp, s FROM ev WHERE seq % 97 <> 0 AND NOT (rank = '3' AND pid = 3)
  UNION ALL SELECT '9', pid, tid, ph, seq, name, ts, dur, cat, id, bp, s FROM ev WHERE id < 3),
fo AS (SELECT rank, pid, tid, ph, {fp} AS fp, count(*) AS n FROM ev GROUP BY ALL), fr AS (SELECT rank, pid, tid, ph, {fp} AS fp, count(*) AS n FROM mu GROUP BY ALL),
so AS (SELECT rank, pid, tid, ph, count(*) AS n FROM ev GROUP BY ALL), sr AS (SELECT rank, pid, tid, ph, count(*) AS n FROM mu GROUP BY ALL)"""
_FP = "concat_ws(chr(1), name, ts, coalesce(CAST(dur AS VARCHAR), ''), ph, pid, tid, coalesce(cat, ''), coalesce(CAST(id AS VARCHAR), ''), coalesce(bp, ''), coalesce(s, ''), {args})"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def joined(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


KEYS = ("rank", "seq")

# Analyses


@query(f"""{LINEITEM} SELECT regexp_replace(name, '\\p{{Nd}}+', '0', 'g') AS operator, CAST(sum(coalesce(dur, 0)) AS BIGINT) AS total_dur FROM ev WHERE NOT contains(tid, 'stream')
GROUP BY 1 ORDER BY total_dur DESC, operator LIMIT 20""")
def operator_hotspot(spark, sf_dir):
    return analysis.operator_hotspot(trace_from_lineitem(spark, sf_dir))


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the line items' stored trace, encoded once a session: in situ means to answer from what is stored."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        folder = shared_dir(spark, "stored")
        store.write_tables(trace_from_lineitem(spark, sf_dir), folder)
        _STORED[key] = folder
    return _STORED[key]


@query(_SQL["operator_hotspot"])
def operator_hotspot_insitu(spark, sf_dir):
    return analysis.operator_hotspot_insitu(spark.read.parquet(f"{stored(spark, sf_dir)}/template"))


_BALANCE = "SELECT pid || ':' || tid AS stream, CAST(sum(coalesce(dur, 0)) AS BIGINT) AS busy FROM ev WHERE contains(tid, 'stream') GROUP BY pid, tid"


@query(f"{LINEITEM} {_BALANCE}")
def stream_load_balance(spark, sf_dir):
    return analysis.stream_load_balance(trace_from_lineitem(spark, sf_dir))


@query(f"{LINEITEM} {_BALANCE}")
def stream_load_balance_insitu(spark, sf_dir):
    return analysis.stream_load_balance_insitu(spark.read.parquet(f"{stored(spark, sf_dir)}/load"))


@query(f"{EVENTS} {_BALANCE}")
def stream_load_balance_events(spark, sf_dir):
    return analysis.stream_load_balance(trace_from_events(spark, sf_dir))


# Counts and times


@query(f"{LINEITEM} SELECT count(*) AS n FROM ev")
def event_count(spark, sf_dir):
    return trace_from_lineitem(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"{LINEITEM} SELECT rank, pid, tid, ph, count(*) AS n FROM ev GROUP BY ALL")
def stream_counts(spark, sf_dir):
    return verify.stream_counts(trace_from_lineitem(spark, sf_dir))


@query(f"{LINEITEM} SELECT rank, min(ts) AS start_ts FROM ev GROUP BY rank")
def start_timestamp(spark, sf_dir):
    return encode.start_timestamps(trace_from_lineitem(spark, sf_dir))


@query(f"{LINEITEM} SELECT rank, seq, ts - min(ts) OVER (PARTITION BY rank) AS ts FROM ev")
def ts_normalize(spark, sf_dir):
    return encode.relative(trace_from_lineitem(spark, sf_dir)).select(*KEYS, "ts")


@query(f"{LINEITEM} SELECT rank, seq, ts FROM ev")
def ts_restore(spark, sf_dir):
    events = trace_from_lineitem(spark, sf_dir)
    starts = encode.start_timestamps(events)
    return encode.absolute(encode.relative(events, starts), starts).select(*KEYS, "ts")


@query("SELECT 'rank-' || event_id || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.v2' ELSE '.json.old' END AS stem, event_id FROM events")
def source_stem(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 3 == 0, ".json").when(F.col("event_id") % 3 == 1, ".v2.json.gz").otherwise(".json.old")
    return e.select("event_id", stem_column(F.concat(F.lit("s3://bucket/day/rank-"), "event_id", kind)).alias("stem"))


# Scalars


@query(f"{LINEITEM} SELECT rank, seq, regexp_replace(name, '\\p{{Nd}}+', '0', 'g') AS pattern FROM ev")
def normalize_name(spark, sf_dir):
    return trace_from_lineitem(spark, sf_dir).select(*KEYS, names.normalize_name("name").alias("pattern"))


@query(f"{LINEITEM} SELECT rank, seq, array_to_string(regexp_extract_all(name, '\\p{{Nd}}+'), ',') AS runs FROM ev")
def digit_runs(spark, sf_dir):
    return trace_from_lineitem(spark, sf_dir).select(*KEYS, F.array_join(names.digit_runs("name"), ",").alias("runs"))


@query(f"{LINEITEM} SELECT rank, seq, name FROM ev")
def restore_digits(spark, sf_dir):
    return trace_from_lineitem(spark, sf_dir).select(*KEYS, names.restore_digits(names.normalize_name("name"), names.digit_runs("name")).alias("name"))


@query(f"{LINEITEM} SELECT rank, seq, tid FROM ev WHERE contains(tid, 'stream')")
def gpu_filter(spark, sf_dir):
    return trace_from_lineitem(spark, sf_dir).where(names.is_gpu()).select(*KEYS, "tid")


@query(f"{LINEITEM} SELECT rank, seq, tid FROM ev WHERE NOT contains(tid, 'stream')")
def cpu_filter(spark, sf_dir):
    return trace_from_lineitem(spark, sf_dir).where(~names.is_gpu()).select(*KEYS, "tid")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 OR substr(l_returnflag || 'x', 1, 1) = '' THEN 'X' ELSE l_returnflag END AS ph FROM lineitem")
def phase_default(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") == 1, F.when(F.col("l_orderkey") % 2 == 0, "").otherwise(F.lit(None))).otherwise(F.concat("l_returnflag", F.lit("yz")))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", names.phase_default(raw).alias("ph"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'stream ' || (props->>'$.k') WHEN event_type = 'signup' THEN 'stream ' || user_id ELSE CAST(user_id AS VARCHAR) END AS tid FROM events""")
def lane_rewrite(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k"))
    cat = F.when(F.col("event_type") == "signup", "gpu_user_annotation").otherwise(F.col("event_type"))
    return e.select("event_id", names.lane(F.col("user_id").cast("string"), cat, stream).alias("tid"))


@query("""SELECT event_id, CAST(trunc(try_cast(CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN props WHEN 2 THEN user_id || '.75' ELSE '-' || user_id || '.5' END AS DOUBLE)) AS BIGINT) AS v FROM events""")
def lossy_i64(spark, sf_dir):
    x = F.expr("CASE event_id % 4 WHEN 0 THEN cast(event_id as string) WHEN 1 THEN props WHEN 2 THEN concat(user_id, '.75') ELSE concat('-', user_id, '.5') END")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", names.lossy_long(x).alias("v"))


@query("SELECT DISTINCT l_partkey, l_linenumber, CASE WHEN length(CAST(l_partkey AS VARCHAR)) >= l_linenumber THEN CAST(l_partkey AS VARCHAR) ELSE lpad(CAST(l_partkey AS VARCHAR), l_linenumber, '0') END AS text FROM lineitem")
def format_width(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_linenumber", names.format_width("l_partkey", F.col("l_linenumber")).alias("text")).distinct()


@query(f"{EVENTS} SELECT rank, seq, array_to_string(arg_keys, ',') AS keys FROM ev")
def arg_keys(spark, sf_dir):
    return trace_from_events(spark, sf_dir).select(*KEYS, F.array_join(names.arg_keys(), ",").alias("keys"))


@query(f"{EVENTS} SELECT rank, array_to_string(list_sort(list(DISTINCT k)), ',') AS keys FROM (SELECT rank, unnest(arg_keys) AS k FROM ev) GROUP BY rank")
def arg_key_catalog(spark, sf_dir):
    keys = trace_from_events(spark, sf_dir).select("rank", F.explode(names.arg_keys()).alias("k"))
    return keys.groupBy("rank").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keys"))


@query(f"""{EVENTS}{_ENCODED} SELECT kind, name_pattern, cat, bp, s, has_dur, has_id, array_to_string(arg_keys, ',') AS arg_keys, count(*) AS n FROM sig GROUP BY ALL""")
def event_signature(spark, sf_dir):
    rows = trace_from_events(spark, sf_dir).select(*names.signature()).groupBy(*names.SIGNATURE).agg(F.count("*").alias("n"))
    return rows.withColumn("arg_keys", joined("arg_keys"))


@query(f"{EVENTS} SELECT rank, seq, sha256({_FP.format(args='args')}) AS fp FROM ev")
def event_fingerprint(spark, sf_dir):
    return trace_from_events(spark, sf_dir).select(*KEYS, F.sha2(names.fingerprint(), 256).alias("fp"))


#: One value of each kind, by event_id % 8.
_VALUES = ["0", "0.0", "true", '"1"', "[ 1, 2.0 ]", '{"b": 1, "a": [0.0]}', "null", "18446744073709551615"]
_KINDS = ["int", "float", "bool", "string", "array", "object", "null", "uint"]
_CANONICAL = ["0", "0.0", "true", '"1"', "[1,2.0]", '{"a":[0.0],"b":1}', "null", "18446744073709551615"]


def _pick(values: list[str], c: str = "event_id") -> str:
    return f"CASE {c} % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(f"SELECT event_id, {_pick(_CANONICAL)} AS text, {_pick(_KINDS)} AS kind FROM events")
def json_kind(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", canonical_json(F.expr(_pick(_VALUES))).alias("text"))
    return rows.withColumn("kind", names.json_kind("text"))


@query("SELECT event_id, event_id % 8 = user_id % 8 AS same FROM events")
def json_exact_eq(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (canonical_json(F.expr(_pick(_VALUES))) == canonical_json(F.expr(_pick(_VALUES, "user_id")))).alias("same"))


# Templates and instances


@query(f"{LINEITEM}{_ENCODED} SELECT template_id, kind, name_pattern, cat, has_dur, n, dur_total FROM tp")
def template_ids(spark, sf_dir):
    return encode.templates(trace_from_lineitem(spark, sf_dir)).select("template_id", "kind", "name_pattern", "cat", "has_dur", "n", "dur_total")


@query(f"{EVENTS}{_ENCODED} SELECT template_id, n, dur_total FROM tp")
def template_stats(spark, sf_dir):
    return encode.templates(trace_from_events(spark, sf_dir)).select("template_id", "n", "dur_total")


@query(f"{LINEITEM}{_ENCODED} SELECT rank, seq, template_id FROM ins")
def template_assign(spark, sf_dir):
    return encode.encode(trace_from_lineitem(spark, sf_dir)).assigned.select(*KEYS, "template_id")


@query(f"{LINEITEM}{_ENCODED} SELECT rank, seq, template_id, instance_id, array_to_string(digit_runs, ',') AS digit_runs FROM ins")
def instance_ids(spark, sf_dir):
    return encode.instances(trace_from_lineitem(spark, sf_dir)).select(*KEYS, "template_id", "instance_id", joined("digit_runs"))


@query(f"{LINEITEM}{_ENCODED} SELECT rank, seq, name_pattern, cat, n FROM ins JOIN (SELECT template_id, n FROM tp) USING (template_id)")
def decompress_join(spark, sf_dir):
    found = encode.encode(trace_from_lineitem(spark, sf_dir))
    return found.instance.join(found.template.select("template_id", "name_pattern", "cat", "n"), "template_id").select(*KEYS, "name_pattern", "cat", "n")


@query(f"{EVENTS} SELECT rank, pid, tid, ph, seq, name, ts, dur, cat, id, bp, s, args FROM ev")
def decompress(spark, sf_dir):
    return encode.encode(trace_from_events(spark, sf_dir)).decoded.withColumn("args", names.args_text())


def _numbers(column: str) -> str:
    return f"""{LINEITEM}{_ENCODED} SELECT template_id, CASE WHEN count({column}) = 0 THEN 'Empty' WHEN min({column}) = max({column}) THEN 'Constant'
WHEN min({column}) >= -2147483648 AND max({column}) <= 2147483647 THEN 'I32' ELSE 'I64' END AS encoding, count({column}) AS n, min({column}) AS low, max({column}) AS high FROM ins GROUP BY template_id"""


for _column in ("ts", "dur", "id"):
    query(_numbers(_column), f"encoding_{_column}")(lambda spark, sf_dir, c=_column: encodings.numbers(encode.instances(trace_from_lineitem(spark, sf_dir)), c))
for _column, _name in (("tid", "encoding_stream_tid"), ("ph", "encoding_phase")):
    query(f"""{LINEITEM}{_ENCODED} SELECT template_id, CASE WHEN max(kind) = 'cpu' THEN 'Empty' WHEN min({_column}) = max({_column}) THEN 'Constant' ELSE 'PerInstance' END AS encoding, count(*) AS n
FROM ins GROUP BY template_id""", _name)(lambda spark, sf_dir, c=_column: encodings.texts(encode.instances(trace_from_lineitem(spark, sf_dir)), c))


#: An argument for each branch of the decision: its kind and its canonical text, as SQL that both engines read.
_ARGUMENTS = {
    "same": ("'int'", "'1'"), "bool": ("'bool'", "CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END"), "i32": ("'int'", "CAST(seq AS STRING)"), "i64": ("'int'", "CAST(seq * 4294967296 AS STRING)"),
    "f64": ("'float'", "concat(CAST(seq AS STRING), '.5')"), "dict": ("'string'", "CASE WHEN seq % 3 = 0 THEN '\"a\"' ELSE '\"b\"' END"), "str": ("'string'", "concat('\"s', CAST(seq AS STRING), '\"')"),
    "mixed": ("CASE WHEN seq % 2 = 0 THEN 'int' ELSE 'float' END", "CASE WHEN seq % 2 = 0 THEN CAST(seq AS STRING) ELSE concat(CAST(seq AS STRING), '.0') END"),
}


@query(f"""{EVENTS}{_ENCODED}, a AS ({" UNION ALL ".join(f"SELECT template_id, '{k}' AS arg_key, {kind} AS vk, {value} AS value FROM ins" for k, (kind, value) in _ARGUMENTS.items())})
SELECT template_id, arg_key, CASE WHEN min(value) = max(value) THEN 'ExactConstant' WHEN min(vk) <> max(vk) THEN 'Exact' WHEN max(vk) = 'bool' THEN 'Bool'
  WHEN max(vk) = 'int' THEN CASE WHEN min(try_cast(value AS BIGINT)) >= -2147483648 AND max(try_cast(value AS BIGINT)) <= 2147483647 THEN 'I32' ELSE 'I64' END WHEN max(vk) = 'float' THEN 'F64'
  WHEN count(DISTINCT value) * 2 <= count(*) THEN 'StrDict' ELSE 'Str' END AS encoding, count(*) AS n, count(DISTINCT value) AS n_distinct FROM a GROUP BY ALL""")
def encoding_args(spark, sf_dir):
    args = F.expr(f"map({', '.join(f"'{k}', {value}" for k, (_, value) in _ARGUMENTS.items())})")
    found = encode.encode(trace_from_events(spark, sf_dir).withColumn("args", args))
    return encodings.arguments(found.instance, found.template)


@query(f"""{LINEITEM}{_ENCODED}, r AS (SELECT template_id, CAST(generate_subscripts(digit_runs, 1) - 1 AS INTEGER) AS slot, unnest(digit_runs) AS run FROM ins),
a AS (SELECT template_id, slot, min(run) = max(run) AS same, bool_and(try_cast(run AS BIGINT) IS NOT NULL) AS fits, bool_or(length(run) > 1 AND run[1] = '0') AS zeros, min(length(run)) AS l0, max(length(run)) AS l1,
  min(try_cast(run AS BIGINT)) AS low, max(try_cast(run AS BIGINT)) AS high, count(*) AS n FROM r GROUP BY ALL),
e AS (SELECT *, CASE WHEN same THEN 'Constant' WHEN NOT fits OR (zeros AND l0 <> l1) THEN 'Strings' WHEN low >= -2147483648 AND high <= 2147483647 THEN 'I32' ELSE 'I64' END AS encoding FROM a)
SELECT template_id, slot, encoding, CAST(CASE WHEN encoding IN ('I32', 'I64') THEN CASE WHEN zeros THEN l1 ELSE 0 END END AS INTEGER) AS width, n FROM e""")
def encoding_digits(spark, sf_dir):
    return encodings.digits(encode.instances(trace_from_lineitem(spark, sf_dir)))


@query(f"""{EVENTS}{_ENCODED}, v AS (SELECT template_id, split_part(args, '=', 1) AS arg_key, rtrim(split_part(args, '=', 2), ';') AS value, min(instance_id) AS f FROM ins GROUP BY ALL)
SELECT template_id, arg_key, value, dense_rank() OVER (PARTITION BY template_id, arg_key ORDER BY f) - 1 AS value_id FROM v""")
def string_dictionary(spark, sf_dir):
    found = encode.encode(trace_from_events(spark, sf_dir))
    return encodings.dictionary(found.instance, found.template)


@query(f"""{LINEITEM}{_ENCODED} SELECT count(*) AS templates, CAST(sum(n) AS BIGINT) AS instances, (SELECT count(DISTINCT rank) FROM ev) AS ranks FROM tp""")
def inspect(spark, sf_dir):
    totals = encode.encode(trace_from_lineitem(spark, sf_dir)).totals
    none = F.lit(0).cast("bigint")
    signatures = totals.groupBy("sig").agg(F.sum("n").alias("n")).agg(F.count("*").alias("templates"), F.sum("n").alias("instances"), none.alias("ranks"))
    ranks = totals.select("rank").distinct().agg(none.alias("templates"), none.alias("instances"), F.count("*").alias("ranks"))
    return signatures.union(ranks).agg(*(F.sum(c).alias(c) for c in ("templates", "instances", "ranks")))


# Linear segments: the dates of each part's line items, in order of line items

_SLP_BASE = """v AS (SELECT l_suppkey AS k, l_partkey AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem),
d AS (SELECT *, lead(x) OVER (PARTITION BY k ORDER BY pos) AS nx FROM v),
r0 AS (SELECT *, nx - x AS step, CASE WHEN lag(nx - x) OVER w = nx - x THEN 0 ELSE 1 END AS new FROM d WHERE nx IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY pos)),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY pos) AS run FROM r0),
r2 AS (SELECT k, run, min(pos) AS a, count(*) AS n, min(step) AS step, arg_min(x, pos) AS v0, arg_min(nx, pos) AS v1 FROM r1 GROUP BY k, run),
r3 AS (SELECT *, coalesce(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY k, grp ORDER BY run) - 1 AS m FROM r3),
r5 AS (SELECT *, CASE WHEN grp = 0 THEN m % 2 = 1 ELSE m % 2 = 0 END AS skip FROM r4),
f AS (SELECT k, CASE WHEN skip THEN a + 1 ELSE a END AS pos, CASE WHEN skip THEN v1 ELSE v0 END AS start, step, CASE WHEN skip THEN n ELSE n + 1 END AS length FROM r5 WHERE NOT (skip AND n = 1)),
l AS (SELECT d.k, d.pos, d.x AS start, 0 AS step, 1 AS length FROM d LEFT JOIN (SELECT k, max(pos + length) AS c FROM f GROUP BY k) e ON d.k = e.k WHERE nx IS NULL AND (c IS NULL OR c <= d.pos)),
s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS segment, start, step, length FROM (SELECT * FROM f UNION ALL SELECT * FROM l))"""


def _slp(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")) - 1
    values = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"), w.alias("i"))
    return segments.segments(values, ["k"])


@query(f"WITH {_SLP_BASE} SELECT k, segment, CAST(start AS BIGINT) AS start, CAST(step AS BIGINT) AS step, CAST(length AS BIGINT) AS length FROM s")
def slp_segments(spark, sf_dir):
    return _slp(spark, sf_dir)


@query("SELECT l_suppkey AS k, l_partkey AS v, count(*) AS n FROM lineitem GROUP BY ALL")
def slp_decode(spark, sf_dir):
    return segments.expand(_slp(spark, sf_dir), ["k"]).groupBy("k", "v").agg(F.count("*").alias("n"))


@query("SELECT k, v FROM (SELECT l_suppkey AS k, l_partkey AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS i FROM lineitem) WHERE i = 10")
def slp_value_at(spark, sf_dir):
    return segments.value_at(_slp(spark, sf_dir), 10, ["k"])


# Comparison


def _mutated(events: DataFrame) -> DataFrame:
    """A trace with events missing and changed, one process missing and a rank too many."""
    kept = events.where("seq % 97 <> 0 and not (rank = '3' and pid = 3)").withColumn("dur", F.when(F.col("seq") % 89 == 0, F.col("dur") + 1).otherwise(F.col("dur")))
    return kept.union(events.where("id < 3").withColumn("rank", F.lit("9")))


_OTHERS = LINEITEM + _OTHER.format(fp=f"sha256({_FP.format(args="''")})")


@query(f"""{_OTHERS} SELECT coalesce(fo.rank, fr.rank) AS rank, coalesce(fo.pid, fr.pid) AS pid, coalesce(fo.tid, fr.tid) AS tid, coalesce(fo.ph, fr.ph) AS ph, coalesce(fo.fp, fr.fp) AS fp, coalesce(fo.n, 0) AS o, coalesce(fr.n, 0) AS r
FROM fo FULL JOIN fr ON fo.rank = fr.rank AND fo.pid = fr.pid AND fo.tid = fr.tid AND fo.ph = fr.ph AND fo.fp = fr.fp WHERE coalesce(fo.n, 0) <> coalesce(fr.n, 0)""")
def verify_fingerprints(spark, sf_dir):
    events = trace_from_lineitem(spark, sf_dir)
    return verify.counts_side_by_side(events, _mutated(events)).where("o <> r")


@query(f"{_OTHERS} SELECT rank, pid, tid, ph FROM so ANTI JOIN sr USING (rank, pid, tid, ph)")
def missing_streams(spark, sf_dir):
    events = trace_from_lineitem(spark, sf_dir)
    return verify.missing_streams(events, _mutated(events))


@query(f"{_OTHERS} SELECT rank, pid, tid, ph FROM sr ANTI JOIN so USING (rank, pid, tid, ph)")
def extra_streams(spark, sf_dir):
    events = trace_from_lineitem(spark, sf_dir)
    return verify.extra_streams(events, _mutated(events))


@query(f"{_OTHERS} SELECT rank, pid, tid, ph, so.n AS original, sr.n AS restored FROM so JOIN sr USING (rank, pid, tid, ph) WHERE so.n <> sr.n")
def stream_count_diffs(spark, sf_dir):
    events = trace_from_lineitem(spark, sf_dir)
    return verify.stream_count_diffs(events, _mutated(events))


@query(f"""{_OTHERS}, b AS (SELECT rank, pid, tid, ph FROM so JOIN sr USING (rank, pid, tid, ph)),
j AS (SELECT coalesce(fo.n, 0) AS o, coalesce(fr.n, 0) AS r, coalesce(fo.rank, fr.rank) AS rank, coalesce(fo.pid, fr.pid) AS pid, coalesce(fo.tid, fr.tid) AS tid, coalesce(fo.ph, fr.ph) AS ph
  FROM fo FULL JOIN fr ON fo.rank = fr.rank AND fo.pid = fr.pid AND fo.tid = fr.tid AND fo.ph = fr.ph AND fo.fp = fr.fp)
SELECT (SELECT count(*) FROM ev) AS original_event_count, (SELECT count(*) FROM mu) AS reconstructed_event_count, CAST(sum(least(o, r)) AS BIGINT) AS matching_events, CAST(sum(abs(o - r)) AS BIGINT) AS mismatched_events,
  (SELECT count(*) FROM so ANTI JOIN sr USING (rank, pid, tid, ph)) AS missing_streams, (SELECT count(*) FROM sr ANTI JOIN so USING (rank, pid, tid, ph)) AS extra_streams,
  (SELECT count(*) FROM so JOIN sr USING (rank, pid, tid, ph) WHERE so.n <> sr.n) AS stream_count_diffs, CAST(0 AS BIGINT) AS metadata_mismatches, false AS ok FROM j JOIN b USING (rank, pid, tid, ph)""")
def verify_report_mutated(spark, sf_dir):
    events = trace_from_lineitem(spark, sf_dir)
    return verify.report(events, _mutated(events))


@query(f"""{LINEITEM} SELECT count(*) AS original_event_count, count(*) AS reconstructed_event_count, count(*) AS matching_events, CAST(0 AS BIGINT) AS mismatched_events, CAST(0 AS BIGINT) AS missing_streams,
  CAST(0 AS BIGINT) AS extra_streams, CAST(0 AS BIGINT) AS stream_count_diffs, CAST(0 AS BIGINT) AS metadata_mismatches, true AS ok FROM ev""")
def verify_report(spark, sf_dir):
    events = trace_from_lineitem(spark, sf_dir)
    return verify.report(events, encode.encode(events).decoded)


_FLAT = ("rank", "pid", "tid", "ph", "name", "ts", "dur", "cat", "id", "bp", "s")


@query(f"""{_OTHERS}, a AS (SELECT {', '.join(_FLAT)} FROM ev), b AS (SELECT {', '.join(_FLAT)} FROM mu)
SELECT count(*) AS differing FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def verify_multiset(spark, sf_dir):
    """The line items against their encoded, restored and then changed trace, as multisets."""
    events = trace_from_lineitem(spark, sf_dir)
    a, b = events.select(*_FLAT), _mutated(encode.encode(events).decoded.select(events.columns)).select(*_FLAT)
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("differing"))


_METADATA = ("rank", "seq", "name", "pid", "tid")


@query(f"{LINEITEM} SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY seq) - 1 AS seq, name, pid, tid FROM ev WHERE ph = 'i'")
def metadata_events(spark, sf_dir):
    """Returned items as metadata records: written among all others, told apart by the reader, which numbers a file's elements."""
    raw, folder = trace_from_lineitem(spark, sf_dir), shared_dir(spark, "metadata")
    records = raw.where("ph = 'i'").select(*_METADATA, F.lit(None).cast("string").alias("args"))
    writer.write_ranks(raw.where("ph <> 'i'"), folder, records).write.format("noop").mode("overwrite").save()
    return read_trace(spark, folder).metadata.select(*_METADATA)


@query(f"""{LINEITEM}, m AS (SELECT rank, seq, name, pid, tid FROM ev), c AS (SELECT rank, seq, CASE WHEN rank = '1' AND ts % 7 = 0 THEN name || '!' ELSE name END AS name, pid, tid FROM ev WHERE NOT (rank = '2' AND pid = 2))
SELECT DISTINCT rank FROM ((SELECT * FROM m EXCEPT ALL SELECT * FROM c) UNION ALL (SELECT * FROM c EXCEPT ALL SELECT * FROM m))""")
def verify_metadata(spark, sf_dir):
    m = trace_from_lineitem(spark, sf_dir).select(*_METADATA, F.lit(None).cast("string").alias("args"), "ts")
    changed = m.withColumn("name", F.when((F.col("rank") == "1") & (F.col("ts") % 7 == 0), F.concat("name", F.lit("!"))).otherwise(F.col("name"))).where("not (rank = '2' and pid = 2)")
    return verify.metadata_mismatches(m, changed)


@query(f"""{LINEITEM}, e2 AS (SELECT 'events' AS source, * FROM (WITH {EVENTS_SQL} SELECT rank, pid, tid, ph, seq, name, ts, dur FROM ev))
SELECT source, rank, count(*) AS n, CAST(sum(coalesce(dur, 0)) AS BIGINT) AS total_dur FROM (SELECT * FROM e2 UNION ALL SELECT 'lineitem', rank, pid, tid, ph, seq, name, ts, dur FROM ev) GROUP BY ALL""")
def merge_traces(spark, sf_dir):
    both = trace_from_events(spark, sf_dir).withColumn("source", F.lit("events")).unionByName(trace_from_lineitem(spark, sf_dir).withColumn("source", F.lit("lineitem")))
    return both.groupBy("source", "rank").agg(F.count("*").alias("n"), F.sum(F.coalesce("dur", F.lit(0))).alias("total_dur"))


# Files: written by the sink, read by the source


def _written(spark: SparkSession, sf_dir: str, compress: bool = False) -> str:
    folder = shared_dir(spark, "traces")
    writer.write_ranks(trace_from_events(spark, sf_dir), folder, compress=compress).write.format("noop").mode("overwrite").save()
    return folder


_SCAN_SQL = f"{EVENTS} SELECT rank, pid, tid, ph, name, ts - min(ts) OVER (PARTITION BY rank) AS ts, dur, args FROM ev"
_SCANNED = ("rank", "pid", "tid", "ph", "name", "ts", "dur")


@query(_SCAN_SQL)
def scan_dir(spark, sf_dir):
    return read_trace(spark, _written(spark, sf_dir, True)).events.select(*_SCANNED, names.args_text().alias("args"))


@query(f"{EVENTS} SELECT '0' AS rank, pid, tid, ph, name, ts - min(ts) OVER () AS ts, dur, args FROM ev")
def scan_events(spark, sf_dir):
    """The whole table as one rank's file."""
    events = trace_from_events(spark, sf_dir).withColumn("rank", F.lit("0"))
    folder = shared_dir(spark, "trace")
    path = writer.write_ranks(events, folder).collect()[0].path
    return read_trace(spark, path).events.select(*_SCANNED, names.args_text().alias("args"))


@query(f"{EVENTS} SELECT rank, count(*) AS events FROM ev GROUP BY rank")
def manifest(spark, sf_dir):
    from ..sources.store import entries

    trace = read_trace(spark, _written(spark, sf_dir))
    return entries(trace, trace.events).select("rank", "events")


#: The generator as SQL: steps of each rank in order of time, draws of splitmix64 by their number (128-bit products, cut to 64 bits).
_CUT = "18446744073709551616::UHUGEINT"
_SYNTHETIC = f"""WITH s AS (SELECT rank, it, 0 AS back, layer AS a, op AS b, layer, op FROM range(4) r(rank), range(2) i(it), range(4) l(layer), range(7) o(op)
  UNION ALL SELECT rank, it, 1, 3 - layer, 5 - op, layer, op FROM range(4) r(rank), range(2) i(it), range(4) l(layer), range(6) o(op)),
d AS (SELECT *, op = 6 AS all_of, ((((rank * 2 + it) * 2 + back) * 4 + a) * 6 + b + 1)::UHUGEINT AS k FROM s),
z0 AS (SELECT *, ({synthetic.Spec().seed}::UHUGEINT + k * 11400714819323198485::UHUGEINT) % {_CUT} AS z FROM d),
z1 AS (SELECT * REPLACE ((xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % {_CUT} AS z) FROM z0),
z2 AS (SELECT * REPLACE ((xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % {_CUT} AS z) FROM z1),
e AS (SELECT *, CASE WHEN all_of THEN 20 ELSE 50 + CAST(xor(z, z >> 31) % 8 AS BIGINT) END AS dur FROM z2),
t AS (SELECT *, CAST(coalesce(sum(CASE WHEN all_of THEN 25 ELSE dur + 1 END) OVER (PARTITION BY rank ORDER BY it, back, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS now, (it * 4 + layer) * 6 + op + 1 AS correlation FROM e),
u AS (SELECT rank, it, back, a, b, 0 AS lane, 'cpu_thread' AS tid, 'layers.' || layer || '.attn.op_' || op || CASE back WHEN 1 THEN '.backward' ELSE '' END AS name, now AS ts, dur, 'cpu_op' AS cat, CASE back WHEN 0 THEN 'correlation=' || correlation || ';' ELSE '' END AS args FROM t WHERE NOT all_of
  UNION ALL SELECT rank, it, back, a, b, 1, 'stream 7', 'kernel_' || op, now + 1, dur - 2, 'kernel', 'correlation=' || correlation || ';' FROM t WHERE back = 0 AND NOT all_of
  UNION ALL SELECT rank, it, back, a, b, 2, 'stream 12', 'nccl:all_reduce', now, dur, 'kernel', 'Process Group Name="tp_group";' FROM t WHERE all_of)
SELECT CAST(rank AS VARCHAR) AS rank, 100 + rank AS pid, tid, 'X' AS ph, row_number() OVER (PARTITION BY rank ORDER BY lane, it, back, a, b) - 1 AS seq, name, ts, dur, cat,
  CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS bp, CAST(NULL AS VARCHAR) AS s, args FROM u"""


@query(_SYNTHETIC)
def synthetic_trace(spark, sf_dir):
    return synthetic.generate(spark).withColumn("args", names.args_text())


@query(f"SELECT regexp_replace(name, '[0-9]+', '0', 'g') AS operator, CAST(sum(dur) AS BIGINT) AS total_dur FROM ({_SYNTHETIC}) WHERE tid = 'cpu_thread' GROUP BY 1")
def synthetic_hotspot(spark, sf_dir):
    return analysis.operator_hotspot(synthetic.generate(spark))


@query(f"SELECT pid || ':' || tid AS stream, CAST(sum(dur) AS BIGINT) AS busy FROM ({_SYNTHETIC}) WHERE tid <> 'cpu_thread' GROUP BY pid, tid")
def synthetic_balance(spark, sf_dir):
    return analysis.stream_load_balance(synthetic.generate(spark))


#: A header for each line item of a part: version, codec and flag bytes from its columns, so that the SQL decides by rule.
_HEADER_SQL = """WITH h AS (SELECT DISTINCT l_linenumber AS version, l_suppkey % 3 AS codec, l_partkey % 2 AS flag, l_returnflag AS magic FROM lineitem)
SELECT concat(magic, version, codec, flag) AS name, CAST(version AS INTEGER) AS version, CASE WHEN magic = 'A' THEN 'magic' WHEN version > 2 THEN 'version' WHEN codec <> 1 THEN 'codec' WHEN flag <> 0 THEN 'reserved' END AS problem,
  magic <> 'A' AND version <= 2 AND codec = 1 AND flag = 0 AS ok FROM h"""


@query(_HEADER_SQL)
def header_checks(spark, sf_dir):
    folder, magic = shared_dir(spark, "headers"), b"TRACELTH"
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_linenumber as version", "l_suppkey % 3 as codec", "l_partkey % 2 as flag", "l_returnflag as magic").distinct()
    for r in rows.collect():  # 7 line numbers by 3 by 2 by 3 flags at most
        with fs.open_output_stream(f"{base}/{r.magic}{r.version}{r.codec}{r.flag}") as out:
            out.write((bytes(8) if r.magic == "A" else magic) + bytes([r.version, 0, r.codec, 0, 0, 0, 0, r.flag]))
    return header_check(spark, folder, magic).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "ok", "version", "problem")
