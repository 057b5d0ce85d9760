"""Whole experiments over recorded runs: gates before the work, arms held against each other task by task, a verdict.

Runs are (key, task, trial, arm, correct); ``correct`` null counts as wrong. Every experiment is a key, and all keys go through
the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import compare, paired, trials

# From this share of right answers on there is nothing to gain; the level of significance; tasks that must be left.
CEILING, LEVEL, LEAST_TASKS = 0.85, 0.05, 30


def verdict(a: Column, b: Column, p: Column) -> Column:
    """``positive`` if b is better and significantly so, ``directional`` if it is just better, else ``null``."""
    return F.when((b > a) & (p < LEVEL), "positive").when(b > a, "directional").otherwise("null")


def _right(runs: DataFrame) -> DataFrame:
    return runs.withColumn("correct", F.coalesce("correct", F.lit(False)).cast("double"))


def _arms(runs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, task, a, b): the arms' shares of right runs of each task that both have."""
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct")))
    return runs.groupBy(key, "task").agg(side(a).alias("a"), side(b).alias("b")).where("a is not null and b is not null")


def gated_arms(runs: DataFrame, key: str, a: str = "a", b: str = "b", ceiling: float = CEILING) -> DataFrame:
    """(key, step1_rate, headroom, n_tasks, rate_a, rate_b, effect_pp, wins, losses, ties, p, verdict).

    The gate looks at the first run of every task in arm a: from ``ceiling`` on there is no headroom, the rest is null and the verdict
    ``no headroom`` (of two runs under one trial the worse counts). Else rates are over runs, the sign test over tasks that both arms have.
    """
    r = _right(runs)
    first = r.where(F.col("arm") == a).groupBy(key, "task").agg(F.min_by("correct", F.struct("trial", "correct")).alias("first"))
    gate = first.groupBy(key).agg(F.avg("first").alias("step1_rate")).withColumn("headroom", F.col("step1_rate") < ceiling)
    open_ = r.join(gate.where("headroom").select(key), key, "left_semi")
    rate = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct")))
    rates = open_.groupBy(key).agg(rate(a).alias("rate_a"), rate(b).alias("rate_b"))
    t = _arms(open_, key, a, b).withColumn("delta", F.col("b") - F.col("a"))
    test = paired.sign_test(t, "delta", key).join(t.groupBy(key).agg(F.count("*").alias("n_tasks")), key)
    out = gate.join(rates.join(test, key, "left"), key, "left").withColumn("ties", F.col("n_tasks") - F.col("wins") - F.col("losses"))
    out = out.withColumn("verdict", F.when(~F.col("headroom"), "no headroom").otherwise(verdict(F.col("rate_a"), F.col("rate_b"), F.coalesce("p", F.lit(1.0)))))
    return out.select(key, "step1_rate", "headroom", "n_tasks", "rate_a", "rate_b", (100 * (F.col("rate_b") - F.col("rate_a"))).alias("effect_pp"), "wins", "losses", "ties", "p", "verdict")


def screened_arms(runs: DataFrame, key: str, a: str = "a", b: str = "b", screens: tuple[str, str] = ("s1", "s2"), least: int = LEAST_TASKS) -> DataFrame:
    """(key, n_screened, n_stable, mean_a, mean_b, wins, losses, p, verdict) over the tasks that two screening arms agree on.

    A task is stable if its numbers of right runs in the screens differ by one at most; a task without runs in one of them is not. With fewer than
    ``least`` stable tasks the verdict is ``too few tasks`` and the rest null. Means are over tasks.
    """
    r = _right(runs)
    n = lambda arm: F.sum(F.when(F.col("arm") == arm, F.col("correct")))
    screen = r.where(F.col("arm").isin(*screens)).groupBy(key, "task").agg(n(screens[0]).alias("s1"), n(screens[1]).alias("s2"))
    screen = screen.withColumn("stable", F.coalesce(paired.stable(F.col("s1"), F.col("s2")), F.lit(False)))
    sizes = screen.groupBy(key).agg(F.count("*").alias("n_screened"), F.count_if("stable").alias("n_stable"))
    kept = screen.where("stable").select(key, "task").join(sizes.where(F.col("n_stable") >= least).select(key), key, "left_semi")
    t = _arms(r.join(kept, [key, "task"], "left_semi"), key, a, b).withColumn("delta", F.col("b") - F.col("a"))
    means = t.groupBy(key).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    out = sizes.join(means.join(paired.sign_test(t, "delta", key), key), key, "left")
    v = F.when(F.col("n_stable") < least, "too few tasks").otherwise(verdict(F.col("mean_a"), F.col("mean_b"), F.col("p")))
    return out.select(key, "n_screened", "n_stable", "mean_a", "mean_b", "wins", "losses", "p", v.alias("verdict"))


def contested_matrix(runs: DataFrame, key: str, family: str, contested: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """(key, family, n_tasks, a, fixed, oracle, recovery): arms by family over the contested tasks of the experiments that have headroom there.

    ``contested`` holds (key, task), set before the runs. The gate is arm a's share of right runs over contested tasks only, so that easy tasks do not hide
    headroom. Family null stands for all contested tasks of an experiment; experiments at or over ``ceiling`` have that row alone, with a only.
    """
    r = _right(runs).join(contested.select(key, "task").distinct(), [key, "task"], "left_semi")
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct")))
    both = [F.count_distinct("task").alias("n_tasks"), *[side(arm).alias(arm) for arm in ("a", "fixed", "oracle")]]
    whole = r.groupBy(key).agg(*both).withColumn("_open", F.coalesce(F.col("a") < ceiling, F.lit(False)))
    families = r.join(whole.where("_open").select(key), key, "left_semi").groupBy(key, family).agg(*both)
    later = lambda c: F.when(F.col("_open"), F.col(c)).alias(c)
    top = whole.select(key, F.lit(None).cast(runs.schema[family].dataType).alias(family), "n_tasks", "a", later("fixed"), later("oracle"))
    rows = top.unionByName(families.select(key, family, "n_tasks", "a", "fixed", "oracle"))
    return rows.withColumn("recovery", paired.recovery(F.col("fixed"), F.col("a"), F.col("oracle")))


def pooled_by_model(records: DataFrame, resamples: int = 2000) -> DataFrame:
    """A server-level diff for each model over all fixtures at once, with the arms' rates over runs and how many tasks only one arm has.

    ``records`` holds model, fixture, variant (bad, fixed), task, tool, selected, cs. Tasks of the same name in two fixtures are two tasks; a run is
    right if it selected ``tool``, whatever the task is called.
    """
    name = F.concat_ws("::", "fixture", "task")
    arm = F.when(F.col("variant") == "bad", "before").when(F.col("variant") == "fixed", "after")
    t = records.select(F.col("model").alias("server"), arm.alias("arm"), name.alias("task"), F.when(F.col("selected") == F.col("tool"), name).alias("selected"), "cs").where("arm is not null")
    pairs = trials.paired(t)
    lone = pairs.groupBy("server").agg(F.count_if(F.col("before_mean").isNull() | F.col("after_mean").isNull()).alias("n_unmatched"))
    rate = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("joint")))
    rates = trials.with_outcomes(t).groupBy("server").agg(rate("before").alias("before_rate"), rate("after").alias("after_rate"))
    return rates.join(lone, "server").join(compare.server_diff(t, resamples=resamples), "server").withColumnRenamed("server", "model")


def claims_against(description: Column, neighbours: Column) -> Column:
    """Whether a text sets a tool against one of its neighbours by name (unlike, whereas, while, compared to)."""
    one = lambda n: F.regexp_like(description, F.concat(F.lit(r"(?i)\b(?:unlike|whereas|while|compared to)\s+\Q"), n, F.lit(r"\E")))
    return F.coalesce(F.exists(neighbours, one), F.lit(False))


def other_family(agent: str, *taken: str) -> None:
    """Fail if the agent's model is of a family that judges or writes already (its name holds the family's, in any case)."""
    for family in taken:
        if family.lower() in agent.lower():
            raise ValueError(f"agent model {agent!r} is of the family {family!r}, which is taken")


def bands(score: Column) -> Column:
    """good from 75 on, fair from 50 on, else poor."""
    return F.when(score >= 75, "good").when(score >= 50, "fair").otherwise("poor")


def baseline_rate(log: DataFrame, rate: str = "task_success_rate") -> DataFrame:
    """One row: n and mean success of the records without an error."""
    return log.where("error is null").agg(F.count("*").alias("n"), F.avg(rate).alias("mean_rate"))
