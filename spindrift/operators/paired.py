"""Paired categorical tests, recovery fractions and regression screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL = 3.841  # chi-square, one degree of freedom, 5 %
FEW_DISCORDANT = 10


def mcnemar(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """b (a right, b wrong), c (the reverse), statistic, verdict.

    No discordant pair gives 0; fewer than ten give the plain difference b - c;
    otherwise the statistic is (|b - c| - 1)^2 / (b + c), cut at 3.841.
    """
    counts = df.groupBy(*keys).agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(~F.col(a) & F.col(b)).alias("c"))
    n, gap = F.col("b") + F.col("c"), F.col("b") - F.col("c")
    chi = F.try_divide((F.abs(gap) - 1).cast("double") ** 2, n)
    statistic = F.when(n == 0, F.lit(0.0)).when(n < FEW_DISCORDANT, gap.cast("double")).otherwise(chi)
    out = counts.withColumn("statistic", F.round(statistic, 4))
    verdict = F.when(n < FEW_DISCORDANT, "too_few").when(F.col("statistic") > CRITICAL, F.when(gap > 0, "a_better").otherwise("b_better")).otherwise("no_difference")
    return out.withColumn("verdict", verdict)


def sign_test(df: DataFrame, delta: str, *keys: str) -> DataFrame:
    """wins, losses (ties dropped) and the exact two-sided binomial p.

    The tail is summed through logarithms of binomial coefficients, so large counts do not overflow.
    """
    c = df.groupBy(*keys).agg(F.count_if(F.col(delta) > 0).alias("wins"), F.count_if(F.col(delta) < 0).alias("losses"))
    n, k = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    step = lambda a, i: F.struct(  # noqa: E731  log of C(n, i), and the sum so far
        (a["log"] + F.ln((F.col("_n") - i + 1).cast("double")) - F.ln(i.cast("double"))).alias("log"),
        (a["sum"] + F.exp(a["log"] + F.ln((F.col("_n") - i + 1).cast("double")) - F.ln(i.cast("double")) - F.col("_n") * F.lit(0.6931471805599453))).alias("sum"),
    )
    c = c.withColumns({"_n": n, "_k": k})
    start = F.struct(F.lit(0.0).alias("log"), F.exp(-F.col("_n") * F.lit(0.6931471805599453)).alias("sum"))
    tail = F.aggregate(F.when(F.col("_k") > 0, F.sequence(F.lit(1).cast("long"), F.col("_k"))).otherwise(F.array().cast("array<long>")), start, step)["sum"]
    return c.withColumn("p", F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 4))).drop("_n", "_k")


def accuracy(df: DataFrame, valid: str, correct: str, *keys: str) -> DataFrame:
    """Share of right answers among the valid ones; 0 without any. Also how many could not be parsed."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    share = F.try_divide(F.count_if(ok & F.col(correct)), F.count_if(ok))
    return df.groupBy(*keys).agg(F.coalesce(share, F.lit(0.0)).alias("accuracy"), F.count_if(~ok).alias("parse_failed"))


def contested(df: DataFrame, valid: str, correct: str, *keys: str) -> DataFrame:
    """Tasks with a valid answer and no right one."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(ok).alias("_v"), F.count_if(ok & F.col(correct)).alias("_c")).where("_v > 0 and _c = 0").drop("_v", "_c")


def recovery(fixed: Column, before: Column, oracle: Column) -> Column:
    """(fixed - before) / (oracle - before); null without headroom."""
    return F.when(F.abs(oracle - before) >= 1e-9, F.try_divide(fixed - before, oracle - before))


def stable(first: Column, second: Column) -> Column:
    """Whether two runs of a task differ by one success at most."""
    return F.abs(first - second) <= 1


def regression_flips(before: DataFrame, after: DataFrame, picks: DataFrame, key: str = "task") -> DataFrame:
    """Tasks at 0.6 or more before and below 0.4 after, with the most frequent wrong pick after (ties: the least)."""
    flipped = before.select(key, F.col("accuracy").alias("before")).join(after.select(key, F.col("accuracy").alias("after")), key).where("before >= 0.6 and after < 0.4")
    counted = picks.groupBy(key, "picked").count()
    best = Window.partitionBy(key).orderBy(F.desc("count"), "picked")
    top = counted.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, F.col("picked").alias("wrong_pick"))
    return flipped.join(top, key, "left")


def regime(df: DataFrame, ceiling: float = 0.85) -> DataFrame:
    """For each family: accuracies of arms a and b over tasks, whether the headroom gate aborts, whether it is in regime.

    ``df`` holds (family, task, arm, valid, correct). A task without a valid answer counts 0.
    """
    t = df.groupBy("family", "task", "arm").agg(F.coalesce(F.try_divide(F.count_if(F.col("valid") & F.col("correct")), F.count_if(F.col("valid"))), F.lit(0.0)).alias("acc"))
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("acc")))
    both = t.groupBy("family", "task").agg(side("a").alias("a"), side("b").alias("b"))
    g = both.groupBy("family").agg(F.count("*").alias("n_tasks"), F.avg("a").alias("a_accuracy"), F.avg("b").alias("b_accuracy"), F.coalesce(F.bool_or((F.col("a") < 1) & (F.col("b") == 1)), F.lit(False)).alias("_gain"))
    aborted = F.col("a_accuracy") >= ceiling
    return g.withColumns({"aborted": aborted, "in_regime": ~aborted & F.col("_gain")}).drop("_gain")
