"""Trials: outcome columns, decomposed rates, task means, pairing and covariate adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Steps
from .numbering import numbered


def selection_correct(selected: str = "selected", task: str = "task") -> Column:
    """Whether the right tool was selected; no selection is wrong."""
    return F.coalesce(F.col(selected) == F.col(task), F.lit(False))


def with_outcomes(trials: DataFrame) -> DataFrame:
    """Adds correct, argument_score (null unless correct) and joint (0 unless correct)."""
    right = selection_correct()
    cs = F.coalesce(F.col("cs"), F.lit(0.0))
    return trials.withColumns({"correct": right, "argument_score": F.when(right, cs), "joint": F.when(right, cs).otherwise(F.lit(0.0))})


def decomposed_rate(trials: DataFrame, *keys: str) -> DataFrame:
    """n, selection accuracy, argument accuracy given a right selection (null without any), joint rate."""
    t = with_outcomes(trials)
    return t.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("selection_accuracy"),
        F.avg("argument_score").alias("argument_accuracy"),
        F.coalesce(F.avg("joint"), F.lit(0.0)).alias("joint_rate"),
    )


def task_means(trials: DataFrame) -> DataFrame:
    """Mean joint outcome and trials of each server, arm and task."""
    return with_outcomes(trials).groupBy("server", "arm", "task").agg(F.avg("joint").alias("mean"), F.count("*").alias("n"))


def paired(trials: DataFrame) -> DataFrame:
    """One row for each task of either arm: before and after means (null if unmatched) and delta.

    Both arms come from one aggregation over (server, task), so trials are shuffled once.
    """
    t = with_outcomes(trials)

    def arm(name: str) -> Column:
        return F.when(F.col("arm") == name, F.col("joint"))

    means = t.groupBy("server", "task").agg(
        F.avg(arm("before")).alias("before_mean"),
        F.avg(arm("after")).alias("after_mean"),
        F.count(arm("before")).alias("n_before"),
        F.count(arm("after")).alias("n_after"),
    )
    return means.withColumn("delta", F.col("after_mean") - F.col("before_mean"))


def matched(pairs: DataFrame) -> DataFrame:
    return pairs.where("before_mean is not null and after_mean is not null")


def unmatched(pairs: DataFrame) -> DataFrame:
    """(server, task, arm) of the tasks that one arm alone has."""
    only = F.when(F.col("after_mean").isNull(), "before").otherwise("after")
    return pairs.where("before_mean is null or after_mean is null").select("server", "task", only.alias("arm"))


def cuped(pairs: DataFrame) -> DataFrame:
    """Matched pairs with the delta adjusted by the before mean; theta and the variance reduction in percent.

    Moments are population moments of the server; a constant before mean leaves the deltas as they are.
    """
    moments = pairs.groupBy("server").agg(
        F.count("*").alias("n_tasks"),
        F.avg("before_mean").alias("_bar"),
        F.var_pop("before_mean").alias("_var"),
        F.covar_pop("before_mean", "delta").alias("_cov"),
        F.var_pop("delta").alias("_raw"),
    )
    theta = F.when(F.col("_var") == 0, F.lit(0.0)).otherwise(F.try_divide("_cov", "_var"))
    joined = pairs.join(moments.withColumn("theta", theta), "server")
    adjusted = joined.withColumn("adjusted", F.col("delta") - F.col("theta") * (F.col("before_mean") - F.col("_bar")))
    after = adjusted.groupBy("server").agg(F.var_pop("adjusted").alias("_adj"))
    reduction = F.when((F.col("_var") == 0) | (F.col("_raw") <= 0), F.lit(0.0)).otherwise(100.0 * (1.0 - F.try_divide("_adj", "_raw")))
    return adjusted.join(after, "server").withColumn("reduction_pct", reduction).drop("_bar", "_var", "_cov", "_raw", "_adj")


def indexed(values: DataFrame, value: str, order: str, key: str = "server") -> DataFrame:
    """(key, i, n, x): values numbered from 0 in the order of ``order``; the position feeds the random stream.

    Groups are numbered over ranges of the order, so that a large one is not sorted in one task.
    """
    steps = Steps(values.sparkSession, "indexed")
    rows = values.select(key, F.col(value).alias("x"), F.col(order).alias("_order"))
    numbers = numbered(rows, ["_order", "x"], steps, [key], "_i", "n")
    return numbers.select(key, "x", (F.col("_i") - 1).cast("long").alias("i"), "n")
