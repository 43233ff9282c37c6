"""Column functions over event names, lanes and fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of decimal digits of any script.
DIGITS = r"\p{Nd}+"
CPU, GPU = "cpu", "gpu"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_name(name: Column | str) -> Column:
    """Every digit run becomes one 0."""
    return F.regexp_replace(_c(name), DIGITS, "0")


def digit_runs(name: Column | str) -> Column:
    """The digit runs in order, leading zeros kept."""
    return F.regexp_extract_all(_c(name), F.lit(DIGITS), 0)


def restore_digits(pattern: Column | str, runs: Column | str) -> Column:
    """The i-th 0 of the pattern becomes the i-th run, or stays 0 if there is none."""
    pieces, runs = F.split(_c(pattern), "0", -1), _c(runs)
    filled = F.transform(pieces, lambda x, i: F.concat(x, F.when(i == F.size(pieces) - 1, "").otherwise(F.coalesce(F.get(runs, i), F.lit("0")))))
    return F.array_join(filled, "")


def is_gpu(tid: Column | str = "tid") -> Column:
    """Whether the lane's name contains ``stream`` (anywhere, case-sensitive)."""
    return F.contains(_c(tid), F.lit("stream"))


def kind(tid: Column | str = "tid") -> Column:
    return F.when(is_gpu(tid), GPU).otherwise(CPU)


def phase_default(ph: Column | str) -> Column:
    """The first character, X for none."""
    return F.coalesce(F.nullif(F.substring(_c(ph), 1, 1), F.lit("")), F.lit("X"))


def lane(tid: Column | str, cat: Column | str, stream: Column | str) -> Column:
    """The lane an event belongs to: its ``args.stream``, its annotation's stream, else its thread."""
    return (
        F.when(_c(stream).isNotNull(), F.concat(F.lit("stream "), _c(stream)))
        .when(_c(cat) == "gpu_user_annotation", F.concat(F.lit("stream "), _c(tid)))
        .otherwise(_c(tid))
    )


def lossy_long(x: Column | str) -> Column:
    """A long from text: integers as they are, other finite numbers in range cut towards zero, else null."""
    t = F.trim(_c(x))
    d = t.try_cast("double")
    cut = F.when(F.abs(d) < float(1 << 63), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)))
    return F.coalesce(t.try_cast("bigint"), cut)


def format_width(v: Column | str, width: Column | int) -> Column:
    """A number padded with zeros to ``width``; 0, or a longer number: as it is."""
    text, width = _c(v).cast("string"), F.lit(width) if isinstance(width, int) else width
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def arg_keys(args: Column | str = "args") -> Column:
    """The sorted keys of an argument map; empty for none."""
    return F.coalesce(F.array_sort(F.map_keys(_c(args))), F.array().cast("array<string>"))


def signature(name: str = "name") -> list[Column]:
    """The columns by which events share a template."""
    return [
        kind().alias("kind"), normalize_name(name).alias("name_pattern"), F.col("cat"), F.col("bp"), F.col("s"),
        F.col("dur").isNotNull().alias("has_dur"), F.col("id").isNotNull().alias("has_id"), arg_keys().alias("arg_keys"),
    ]


SIGNATURE = ("kind", "name_pattern", "cat", "bp", "s", "has_dur", "has_id", "arg_keys")


def args_text(args: Column | str = "args") -> Column:
    """``key=value;`` for each argument in order of keys; empty for none."""
    m = _c(args)
    return F.coalesce(F.array_join(F.transform(arg_keys(m), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(m, k), F.lit("null")), F.lit(";"))), ""), F.lit(""))


def fingerprint() -> Column:
    """All observable fields of an event as one text; null and '' are alike for text fields, no arguments and empty ones too."""
    fields = ["name", "ts", "dur", "ph", "pid", "tid", "cat", "id", "bp", "s"]
    return F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields), args_text())


def json_kind(text: Column | str) -> Column:
    """The kind of a canonical JSON value: null, bool, int, uint (beyond 64 signed bits), float, string, array or object."""
    t = _c(text)
    return (
        F.when(t == "null", "null").when(t.isin("true", "false"), "bool").when(t.startswith('"'), "string")
        .when(t.startswith("["), "array").when(t.startswith("{"), "object").when(t.rlike("[.eE]"), "float")
        .when(t.try_cast("bigint").isNotNull(), "int").otherwise("uint")
    )
