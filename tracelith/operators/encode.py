"""Templates and instances: grouping events by signature, and back.

All that templates and ids depend on is in one small table, ``totals``: a row for each signature, stream and block of ``BLOCK`` sequence
numbers. It is written down once, and so is the dictionary of signatures that comes from it; ids of templates and instances, and the load are
derived from the two, and the events are read once more for the instances themselves. No step orders the events, or the templates, in
one task: what is ordered as a whole is one row for each rank.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import digit_runs, restore_digits, signature
from ..sources.files import shared_dir, written

STREAM = ("rank", "pid", "tid", "ph")
SIG = ("h", "sig")
#: More than any sequence number.
_SEQS = Decimal(1 << 63)
TEMPLATE = "template_id bigint, kind string, name_pattern string, cat string, bp string, s string, has_dur boolean, has_id boolean, arg_keys array<string>, n bigint, dur_total bigint"
#: Sequence numbers of a block: as many events of one template and stream are ordered in one task at most.
BLOCK = 1 << 20


def origin(df: DataFrame) -> tuple[str, ...]:
    """What tells traces apart: the rank, and the source where there is one (files may share a rank)."""
    return ("rank", "source") if "source" in df.columns else ("rank",)


def stream(df: DataFrame) -> tuple[str, ...]:
    return (*origin(df), *STREAM[1:])


def start_timestamps(events: DataFrame) -> DataFrame:
    """The least time of each rank's events, or of each source's."""
    return events.groupBy(*origin(events)).agg(F.min("ts").alias("start_ts"))


def _with_starts(events: DataFrame, starts: DataFrame) -> DataFrame:
    """One row for each rank or source is joined; Spark broadcasts it if it is small."""
    if "source" in events.columns and "source" in starts.columns:
        return events.join(starts.select("source", "start_ts"), "source")
    return events.join(starts.groupBy("rank").agg(F.min("start_ts").alias("start_ts")), "rank")


def relative(events: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Times from the start on of the rank, or of the source where there is one."""
    starts = start_timestamps(events) if starts is None else starts
    return _with_starts(events, starts).withColumn("ts", F.col("ts") - F.col("start_ts")).select(events.columns)


def absolute(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Times as recorded; a sum beyond 64 bits is an error."""
    return _with_starts(events, starts).withColumn("ts", F.col("ts") + F.col("start_ts")).select(events.columns)


def _signed(events: DataFrame) -> DataFrame:
    """Events with ``sig``, their signature as one struct (never null, so that it joins by hash, its null fields alike), its hash ``h``
    (with which every sort by signature begins, so that texts are compared where hashes are equal only), and their block."""
    rows = events.withColumns({"sig": F.struct(*signature()), "block": F.expr(f"seq div {BLOCK}")})
    return rows.withColumn("h", F.xxhash64("sig"))


def totals(events: DataFrame) -> DataFrame:
    """Counts, durations and the first sequence number for each signature, stream and block: one pass over the events."""
    rows = _signed(events).groupBy(*SIG, *stream(events), "block")
    return rows.agg(F.count("*").alias("n"), F.sum(F.coalesce("dur", F.lit(0))).alias("dur_total"), F.min("seq").alias("first_seq"))


def _before(rows: DataFrame, order: tuple[str, ...], count: str, name: str) -> DataFrame:
    """Adds how much of ``count`` comes before each row: within its rank, by ``order``, and in all earlier ranks (one row each)."""
    ranks = rows.groupBy("rank").agg(F.sum(count).alias("_all")).select("rank", (F.sum("_all").over(Window.orderBy("rank")) - F.col("_all")).alias("_ahead"))
    inner = F.sum(count).over(Window.partitionBy("rank").orderBy(*order)) - F.col(count)
    return rows.withColumn("_inner", inner).join(ranks, "rank").withColumn(name, (F.col("_ahead") + F.col("_inner")).cast("bigint")).drop("_ahead", "_inner")


class Encoded:
    """An encoded trace. ``totals`` are the written totals of ``events``; ``folder`` holds them and the dictionary."""

    def __init__(self, events: DataFrame, folder: str):
        self.events, self.folder = events, folder
        self.totals = written(totals(events), f"{folder}/totals")

    @cached_property
    def streams(self) -> DataFrame:
        """One row for each stream with its number in the traversal (written): ranks (and sources) by text, then pid, tid and ph by first appearance."""
        keys = stream(self.totals)
        rows = self.totals.groupBy(*keys).agg(F.min("first_seq").alias("first_seq"))
        firsts = []
        for k in range(len(origin(rows)) + 1, len(keys) + 1):
            firsts.append(f"{keys[k - 1]}_first")
            rows = rows.withColumn(firsts[-1], F.min("first_seq").over(Window.partitionBy(*keys[:k])))
        return written(_before(rows.withColumn("one", F.lit(1)), (*origin(rows)[1:], *firsts), "one", "stream_no").select(*keys, "stream_no"), f"{self.folder}/streams")

    @cached_property
    def dictionary(self) -> DataFrame:
        """One row for each signature: its template's id and totals. Written, since all else reads it.

        An id is the number of templates that are new in earlier blocks of the traversal, and earlier in the block where it first appears.
        """
        # The first place as one number, which a hash aggregation can keep; a struct would make it sort.
        first = F.min(F.col("stream_no").cast("decimal(38,0)") * F.lit(_SEQS) + F.col("first_seq"))
        rows = self.totals.join(self.streams, [*stream(self.totals)]).groupBy(*SIG).agg(F.sum("n").alias("n"), F.sum("dur_total").alias("dur_total"), first.alias("first"))
        no, seq = F.floor(F.col("first") / F.lit(_SEQS)), F.pmod("first", F.lit(_SEQS))
        rows = rows.withColumns({"stream_no": no.cast("bigint"), "seq": seq.cast("bigint")}).withColumn("block", F.expr(f"seq div {BLOCK}"))
        at = ("stream_no", "block")
        new = rows.groupBy(*at).agg(F.count("*").alias("new")).join(self.streams.select("rank", "stream_no"), "stream_no")
        inner = F.row_number().over(Window.partitionBy(*at).orderBy("seq")) - 1
        numbered = rows.withColumn("inner", inner).join(_before(new, at, "new", "before").select(*at, "before"), [*at])
        return written(numbered.select(*SIG, (F.col("before") + F.col("inner")).cast("bigint").alias("template_id"), "n", "dur_total"), f"{self.folder}/dictionary")

    @property
    def _ids(self) -> DataFrame:
        return self.dictionary.select(*SIG, "template_id")

    @cached_property
    def _groups(self) -> DataFrame:
        """Totals by numbers instead of texts, and how many of the template's instances come before (written)."""
        earlier = Window.partitionBy("template_id").orderBy("stream_no", "block").rowsBetween(Window.unboundedPreceding, -1)
        rows = self.totals.join(self._ids, [*SIG]).join(self.streams, [*stream(self.totals)])
        rows = rows.select("template_id", "stream_no", "block", F.col("sig.kind").alias("kind"), "pid", "tid", "n", "dur_total")
        return written(rows.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), f"{self.folder}/groups")

    @property
    def template(self) -> DataFrame:
        """One row for each signature; ids in the order of first appearance, CPU and GPU in one row of ids."""
        return self.dictionary.select("template_id", "sig.*", "n", "dur_total")

    @property
    def instance(self) -> DataFrame:
        """Events as instances of templates.

        An instance's id is its place in the template's traversal: the counts before its stream's block, plus its place among the
        template's events there. So a template that most events share is ordered block by block in many tasks, by numbers only.
        """
        keys, at = stream(self.events), ("template_id", "stream_no", "block")
        before = self._groups.select(*at, "before")
        inner = F.row_number().over(Window.partitionBy(*at).orderBy("seq")) - 1
        values = F.transform("sig.arg_keys", lambda k: F.element_at("args", k))
        rows = _signed(self.events).select(*SIG, *keys, "block", "seq", "ts", "dur", "id", digit_runs("name").alias("digit_runs"), values.alias("arg_values"))
        numbered = rows.join(self._ids, [*SIG]).join(self.streams, [*keys]).withColumn("kind", F.col("sig.kind")).drop(*SIG)
        placed = numbered.withColumn("inner", inner).join(before, [*at])
        return placed.select("template_id", (F.col("before") + F.col("inner")).cast("bigint").alias("instance_id"), "kind", *keys, "seq", "ts", "dur", "id", "digit_runs", "arg_values")

    @property
    def assigned(self) -> DataFrame:
        """Events with their template_id."""
        return _signed(self.events).join(self._ids, [*SIG]).select("template_id", *(F.col(c) for c in self.events.columns))

    @property
    def load(self) -> DataFrame:
        """Durations by template, pid and lane: what the load balance is answered from."""
        return self._groups.groupBy("template_id", "kind", "pid", "tid").agg(F.sum("n").alias("n"), F.sum("dur_total").alias("dur_total"))

    @property
    def decoded(self) -> DataFrame:
        return decode(self.instance, self.template)


def encode(events: DataFrame, folder: str | None = None) -> Encoded:
    """Reads the events once and writes their totals to ``folder``, or to a new one in the shared folder."""
    return Encoded(events, folder or shared_dir(events.sparkSession, "encoded"))


def templates(events: DataFrame) -> DataFrame:
    return encode(events).template


def instances(events: DataFrame) -> DataFrame:
    return encode(events).instance


def load(events: DataFrame) -> DataFrame:
    return encode(events).load


def decode(instance: DataFrame, template: DataFrame) -> DataFrame:
    """The events again, times relative. The template table joins by id; Spark broadcasts it if it is small."""
    t = template.select("template_id", "name_pattern", "cat", "bp", "s", "arg_keys")
    args = F.when(F.size("arg_keys") > 0, F.map_from_arrays("arg_keys", "arg_values"))
    return instance.join(t, "template_id").select(
        *stream(instance), "seq", restore_digits("name_pattern", "digit_runs").alias("name"), "ts", "dur", "cat", "id", "bp", "s", args.alias("args"),
    )
