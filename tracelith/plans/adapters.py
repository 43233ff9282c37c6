"""The driver's tables as traces: projections into the event schema, with the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_args

#: The event schema. ``args``: canonical JSON texts by key.
EVENT = "rank string, pid bigint, tid string, ph string, seq bigint, name string, ts bigint, dur bigint, cat string, id bigint, bp string, s string, args map<string,string>"


#: Items of one order that sequence numbers leave room for (17 at most in the tables).
ITEMS = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> F.Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def trace_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each line item, named by its part. Sequence numbers are the order's number and the place within the order, so that no rank is ordered as a whole."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    rank = (F.col("l_suppkey") % 4).cast("string")
    # Numbered before anything else is computed: what follows runs in as many tasks as the shuffle has, however few the file's row groups are.
    numbered = _table(spark, sf_dir, "lineitem").withColumn("seq", (F.col("l_orderkey") * ITEMS + place).cast("bigint"))
    joined = numbered.join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        rank.alias("rank"), (F.col("l_suppkey") % 16).alias("pid"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("stream "), F.col("l_linenumber"))).otherwise(F.concat(F.lit("cpu_thread_"), F.col("l_linenumber") % 2)).alias("tid"),
        F.when(F.col("l_returnflag") == "R", "i").otherwise("X").alias("ph"),
        "seq",
        F.concat("p_type", F.lit("."), F.regexp_replace("p_name", " ", "_"), F.lit(".layers."), "l_partkey", F.lit(".op_"), "l_linenumber").alias("name"),
        micros("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast("bigint")).alias("dur"),
        F.col("p_type").alias("cat"), F.col("l_orderkey").alias("id"), F.lit(None).cast("string").alias("bp"), F.lit(None).cast("string").alias("s"),
        F.lit(None).cast("map<string,string>").alias("args"),
    )


LINEITEM_SQL = f"""ev AS (SELECT CAST(l_suppkey % 4 AS VARCHAR) AS rank, l_suppkey % 16 AS pid,
  CASE WHEN l_linestatus = 'O' THEN 'stream ' || l_linenumber ELSE 'cpu_thread_' || (l_linenumber % 2) END AS tid,
  CASE WHEN l_returnflag = 'R' THEN 'i' ELSE 'X' END AS ph,
  l_orderkey * {ITEMS} + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS seq,
  p_type || '.' || replace(p_name, ' ', '_') || '.layers.' || l_partkey || '.op_' || l_linenumber AS name,
  epoch_us(l_shipdate) AS ts, CASE WHEN l_returnflag <> 'R' THEN CAST(trunc(l_extendedprice) AS BIGINT) END AS dur,
  p_type AS cat, l_orderkey AS id, CAST(NULL AS VARCHAR) AS bp, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS args
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def trace_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each row of the event table, properties as arguments."""
    stream = F.concat(F.lit("stream "), F.col("user_id") % 3)
    return _table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("string").alias("rank"), (F.col("user_id") % 8).alias("pid"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), stream).otherwise("cpu").alias("tid"), F.lit("X").alias("ph"), F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit("."), F.get_json_object("props", "$.k"), F.lit(".op_"), F.col("event_id") % 10).alias("name"),
        micros("ts").alias("ts"), F.col("value").cast("bigint").alias("dur"), F.lit(None).cast("string").alias("cat"), F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("bp"), F.lit(None).cast("string").alias("s"), canonical_args("props").alias("args"),
    )


EVENTS_SQL = """ev AS (SELECT CAST(user_id % 4 AS VARCHAR) AS rank, user_id % 8 AS pid,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'stream ' || (user_id % 3) ELSE 'cpu' END AS tid, 'X' AS ph, event_id AS seq,
  event_type || '.' || (props->>'$.k') || '.op_' || (event_id % 10) AS name, epoch_us(ts) AS ts, CAST(trunc(value) AS BIGINT) AS dur,
  CAST(NULL AS VARCHAR) AS cat, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS bp, CAST(NULL AS VARCHAR) AS s,
  array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || '=' || CAST(json_extract(props, '$.' || k) AS VARCHAR) || ';'), '') AS args,
  list_sort(json_keys(props)) AS arg_keys FROM events)"""
