"""What the operators of this subpackage share: table access, Arrow mapping, shared folders, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python operator holds at once. Texts are whole, so memory follows the longest texts, not the table.
CHUNK_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_chunks(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Applies ``make()`` (built once for each task) to chunks of rows, each a dict of column lists.

    The function returns a dict of lists with the columns of ``schema``; their length may differ from the input's.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        f = make()
        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = f({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_chunks(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Keeps the rows for which ``make()`` (built once for each task) says so, reading one column; all columns stay as they are."""

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.filter(pa.array(f(part.column(part.schema.get_field_index(column)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster shares (``spark.checkpoint.dir``). Only a local session, as in tests, may do without: it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if (master := spark.sparkContext.master) != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tracelith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what ``written`` wrote. Only for frames that nothing reads any more."""
    for x in frames:
        if path := getattr(x, "_written_to", None):
            remove_dir(x.sparkSession, path)


#: A key with more than one in so many rows, and at least LIGHT of them, is heavy; so there are SHARE heavy keys at most.
SHARE, LIGHT = 1000, 100


def join_dealt(rows: DataFrame, by_key: DataFrame, keys: list[str], n: int, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """Joins ``rows`` (``n`` of them) with ``by_key``, which has one row for each key and in ``n`` the key's number of rows; that column goes.

    A heavy key's rows are dealt to many tasks by a salt, its one row repeated for each. The salt is a hash of ``by``, or of the place
    within a file's rows where ``by`` is empty: this only for ``rows`` that come straight from files, where a task that runs again sees
    the same places (rows out of a shuffle may come in another order, and would move between tasks). The heavy keys, ``SHARE`` at most whatever the
    data, are broadcast with their number of salts; nothing else is. ``by_key`` is read twice.
    """
    few = max(LIGHT, n // SHARE)
    salts = by_key.where(F.col("n") > few).select(*keys, F.ceil(F.col("n") / few).cast("int").alias("_tracelith_salts"))
    dealt = rows.join(F.broadcast(salts), keys, "left")
    mark = F.xxhash64(*by) if by else F.monotonically_increasing_id()
    dealt = dealt.withColumn("_tracelith_salt", F.when(F.col("_tracelith_salts").isNotNull(), F.pmod(mark, F.col("_tracelith_salts"))).otherwise(0).cast("int")).drop("_tracelith_salts")
    copies = F.when(F.col("n") > few, F.sequence(F.lit(0), F.ceil(F.col("n") / few).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    # Merged: a broadcast table of several keys takes pages of many MB, however few its rows.
    return dealt.join(by_key.withColumn("_tracelith_salt", F.explode(copies)).drop("n").hint("merge"), [*keys, "_tracelith_salt"], how).drop("_tracelith_salt")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) for each node, root the least node reachable.

    Large-star and small-star steps alternate until nothing changes; O(log n) rounds. Each round's edges are written to the
    shared folder, minima are partially aggregated before the shuffle, and no neighbourhood is gathered in one task: edges of a node
    with many are dealt to many tasks (``join_dealt``).
    """
    def star(e: DataFrame, n: int) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = join_dealt(both.where("b > a"), low, ["a"], 2 * n, by=["b"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # of each edge the greater end now comes first
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_dealt(large, down, ["a"], 2 * n, by=["b"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        return small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(limit):
        new = written(star(now, state[0]), "edges")
        was, state = state, new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if state == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
