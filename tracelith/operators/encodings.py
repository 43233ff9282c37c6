"""Which physical encoding each column of each template would get: the decision as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import json_kind

I32_LOW, I32_HIGH = -(1 << 31), (1 << 31) - 1


def _integers(low: Column, high: Column) -> Column:
    return F.when((low >= I32_LOW) & (high <= I32_HIGH), "I32").otherwise("I64")


def numbers(instance: DataFrame, column: str) -> DataFrame:
    """Empty (no instance has a value), Constant, I32 or I64 for each template."""
    low, high = F.min(column), F.max(column)
    choice = F.when(F.count(column) == 0, "Empty").when(low == high, "Constant").otherwise(_integers(low, high))
    return instance.groupBy("template_id").agg(choice.alias("encoding"), F.count(column).alias("n"), low.alias("low"), high.alias("high"))


def texts(instance: DataFrame, column: str) -> DataFrame:
    """Constant or PerInstance for each GPU template (CPU templates don't store lanes and phases: Empty)."""
    choice = F.when(F.max("kind") == "cpu", "Empty").when(F.min(column) == F.max(column), "Constant").otherwise("PerInstance")
    return instance.groupBy("template_id").agg(choice.alias("encoding"), F.count("*").alias("n"))


def arguments(instance: DataFrame, template: DataFrame) -> DataFrame:
    """For each template and argument: ExactConstant, Bool, I32, I64, F64, StrDict, Str or Exact, in that order."""
    values = instance.join(template.select("template_id", "arg_keys"), "template_id").select("template_id", F.explode(F.arrays_zip("arg_keys", "arg_values")).alias("a"))
    rows = values.select("template_id", F.col("a.arg_keys").alias("arg_key"), F.coalesce("a.arg_values", F.lit("null")).alias("value"))
    # Each distinct value once, so that counting distinct ones needs no second shuffle of all rows.
    each = rows.groupBy("template_id", "arg_key", "value").agg(F.count("*").alias("c")).withColumn("kind", json_kind("value"))
    same, all_of = F.min("value") == F.max("value"), lambda k: (F.min("kind") == k) & (F.max("kind") == k)
    number = F.col("value").try_cast("bigint")
    choice = (
        F.when(same, "ExactConstant").when(all_of("bool"), "Bool").when(all_of("int"), _integers(F.min(number), F.max(number)))
        .when(all_of("float"), "F64").when(all_of("string"), F.when(F.count("*") * 2 <= F.sum("c"), "StrDict").otherwise("Str")).otherwise("Exact")
    )
    return each.groupBy("template_id", "arg_key").agg(choice.alias("encoding"), F.sum("c").alias("n"), F.count("*").alias("n_distinct"))


def digits(instance: DataFrame) -> DataFrame:
    """For each template and digit slot: Constant, I32 or I64 with a width (0: no leading zeros), or Strings."""
    rows = instance.select("template_id", F.posexplode("digit_runs").alias("slot", "run"))
    run, number = F.col("run"), F.col("run").try_cast("bigint")
    ascii_only, zero = run.rlike("^[0-9]+$"), (F.length("run") > 1) & run.startswith("0")
    even = F.min(F.length("run")) == F.max(F.length("run"))
    some = F.bool_or(zero)
    fits = F.bool_and(number.isNotNull())
    ints = _integers(F.min(number), F.max(number))
    choice = F.when(F.min("run") == F.max("run"), "Constant").when(~F.bool_and(ascii_only) | ~fits | (some & ~even), "Strings").otherwise(ints)
    width = F.when(choice.isin("I32", "I64"), F.when(some, F.max(F.length("run"))).otherwise(0))
    return rows.groupBy("template_id", "slot").agg(choice.alias("encoding"), width.cast("int").alias("width"), F.count("*").alias("n"))


def dictionary(instance: DataFrame, template: DataFrame) -> DataFrame:
    """Ids of the distinct values of each argument, by first appearance. Ordered within a template's argument only."""
    values = instance.join(template.select("template_id", "arg_keys"), "template_id").select("template_id", "instance_id", F.explode(F.arrays_zip("arg_keys", "arg_values")).alias("a"))
    first = values.groupBy("template_id", F.col("a.arg_keys").alias("arg_key"), F.col("a.arg_values").alias("value")).agg(F.min("instance_id").alias("first_instance"))
    w = Window.partitionBy("template_id", "arg_key").orderBy("first_instance")
    return first.select("template_id", "arg_key", "value", (F.dense_rank().over(w) - 1).cast("bigint").alias("value_id"))
