"""Argument constraints: one predicate of five kinds, and the shares built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def holds(value: Column, c: Column) -> Column:
    """Whether ``value`` (a string) meets constraint ``c`` (kind, gold, pattern, lo, hi, tolerance).

    A null value never does, a value that is no number fails a numeric kind, an unknown kind is an error.
    """
    whole = value.try_cast("long")
    number, gold = value.try_cast("double"), c["gold"].try_cast("double")
    fits = F.abs(number - gold) <= F.coalesce(c["tolerance"], F.lit(TOLERANCE))
    by_kind = (
        F.when(c["kind"] == "enum", value == c["gold"])
        .when(c["kind"] == "format", F.regexp_like(value, F.concat(F.lit(r"\A(?:"), c["pattern"], F.lit(r")\z"))))
        .when(c["kind"] == "range", whole.between(c["lo"], c["hi"]))
        .when(c["kind"] == "contains", F.contains(F.lower(value), F.lower(c["gold"])))
        .when(c["kind"] == "numeric_equals", fits)
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of constraint: "), F.coalesce(c["kind"], F.lit("null")))).cast("boolean"))
    )
    return F.coalesce(F.when(value.isNotNull(), by_kind), F.lit(False))


def satisfaction(calls: DataFrame, *keys: str) -> DataFrame:
    """(keys, share, all_hold) over the constraints of a call; a call without any is right."""
    e = calls.withColumn("c", F.explode_outer("constraints"))
    ok = F.when(F.col("c").isNotNull(), holds(F.element_at("args", F.col("c.param")), F.col("c")))
    g = e.withColumn("ok", ok).groupBy(*keys).agg(F.avg(F.col("ok").cast("double")).alias("share"), F.bool_and("ok").alias("all_hold"))
    return g.select(*keys, F.coalesce("share", F.lit(1.0)).alias("share"), F.coalesce("all_hold", F.lit(True)).alias("all_hold"))


def renamed(calls: DataFrame, renames: DataFrame) -> DataFrame:
    """Constraints on parameters that were renamed follow the new name; ``renames`` is (old, new), a map of bounded size."""
    m = renames.agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_m"))
    moved = F.transform("constraints", lambda c: c.withField("param", F.coalesce(F.try_element_at("_m", c["param"]), c["param"])))
    return calls.crossJoin(F.broadcast(m)).withColumn("constraints", moved).drop("_m")


def corrected(calls: DataFrame, renames: DataFrame, *keys: str) -> DataFrame:
    """(keys, score): the share of constraints that hold under the new names; 0 for calls that could not be read, chose another tool or failed.

    ``calls`` holds parse_failed, selected, target, success, args and constraints besides the keys; a null of the first four counts as the failure.
    """
    fine = ~F.coalesce("parse_failed", F.lit(True)) & F.coalesce(F.col("selected") == F.col("target"), F.lit(False)) & F.coalesce("success", F.lit(False))
    marked = calls.withColumn("_fine", fine)
    share = satisfaction(renamed(marked, renames), *keys, "_fine")
    return share.select(*keys, F.when(F.col("_fine"), F.col("share")).otherwise(0.0).alias("score"))
