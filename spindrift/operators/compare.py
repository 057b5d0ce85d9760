"""Two-arm comparisons with a verdict that may also be: not enough data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import resample, trials

FEW = 30  # matched tasks from which replicates give the interval themselves


def verdict(lo: Column, hi: Column, threshold: float) -> Column:
    """The width is judged first: a wide interval decides nothing. All comparisons are strict."""
    return (
        F.when(hi - lo > 2 * threshold, "insufficient_sensitivity")
        .when(hi < -threshold, "regression")
        .when(lo > threshold, "improvement")
        .otherwise("no_change")
    )


def exit_code(verdict: Column) -> Column:
    return (verdict == "regression").cast("int")


def server_diff(data: DataFrame, threshold: float = 0.05, use_cuped: bool = True, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """A row for each server with two matched tasks at least: delta, interval, theta, verdict.

    ``data`` holds trials (server, arm, task, selected, cs). Below 30 tasks the interval
    is the mean plus and minus Student's t times the spread of the replicate means, from
    30 on it is their order statistics; each server pays for one of the two only.
    """
    pairs = trials.matched(trials.paired(data))
    adjusted = trials.cuped(pairs).where("n_tasks >= 2")
    if not use_cuped:
        adjusted = adjusted.withColumns({"adjusted": F.col("delta"), "theta": F.lit(0.0), "reduction_pct": F.lit(0.0)})
    values = trials.indexed(adjusted, "adjusted", "task")
    means = resample.replicate_means(values, resamples, seed)
    place = resample.order_statistics(means, resamples)
    ci = place.join(resample.spread(means), "server")
    point = adjusted.groupBy("server").agg(F.count("*").alias("n_tasks"), F.avg("adjusted").alias("delta"), F.max("theta").alias("theta"), F.max("reduction_pct").alias("reduction_pct"))
    few = F.col("n_tasks") < FEW
    margin = resample.t_critical(F.col("n_tasks") - 1) * F.col("se")
    out = point.join(ci, "server").withColumns({"ci_lo": F.when(few, F.col("delta") - margin).otherwise(F.col("lo")), "ci_hi": F.when(few, F.col("delta") + margin).otherwise(F.col("hi")), "few_clusters": few})
    out = out.withColumn("verdict", verdict(F.col("ci_lo"), F.col("ci_hi"), threshold))
    return out.select("server", "n_tasks", "delta", "ci_lo", "ci_hi", "theta", "reduction_pct", "few_clusters", "verdict", exit_code(F.col("verdict")).alias("exit_code"))


def trial_diff(data: DataFrame, threshold: float = 0.05, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """A row for each server: difference of joint rates over trials, two-sample bootstrap interval, verdict.

    Trials are numbered by task and trial within their arm; the position feeds the stream.
    """
    t = trials.with_outcomes(data).withColumn("_o", F.struct("task", "trial"))
    before, after = (trials.indexed(t.where(F.col("arm") == arm), "joint", "_o") for arm in ("before", "after"))
    means = resample.difference_replicates(before, after, resamples, seed)
    ci = resample.order_statistics(means, resamples)
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("joint")))
    rates = t.groupBy("server").agg(mean("before").alias("before_rate"), mean("after").alias("after_rate"))
    out = rates.join(ci, "server").withColumn("delta", F.col("after_rate") - F.col("before_rate"))
    return out.select("server", "before_rate", "after_rate", "delta", F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"), verdict(F.col("lo"), F.col("hi"), threshold).alias("verdict"))
