"""Power: correlated task pairs, detectable effects by bisection, sequential looks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resample
from .rng import INCREMENT, MASK, MULTIPLIER, uniform

# Fixed values of the calibration: base rate, task spread, residual spread, correlation of the arms.
RATE, TASK_SD, RESIDUAL_SD, RHO = 0.7749, 0.3588, 0.1392, 0.881


def clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def task_pairs(spark: SparkSession, sims: int, tasks: int, delta: float, trials: int = 1, rate: float = RATE, seed: int = 42) -> DataFrame:
    """(server, i, n, before, after): simulated task means; ``server`` is the simulation with its own seed (seed + number).

    A task takes four normals of twelve draws each: task level, its independent part after, and a noise for each arm.
    Values are clamped at the true and at the observed level.
    """
    g = spark.range(sims * tasks).select((F.col("id") / tasks).cast("long").alias("server"), (F.col("id") % tasks).alias("i"))
    # One row a draw: the expression of a draw is long, and forty-eight in one row would be too much to compile.
    drawn = g.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("u", uniform(F.col("i") * 48 + F.col("j") + 1, F.col("server") + seed))
    z = [(F.sum(F.when(F.floor(F.col("j") / 12) == k, F.col("u"))) - 6.0).alias(f"z{k}") for k in range(4)]
    g = drawn.groupBy("server", "i").agg(*z)
    sd = RESIDUAL_SD / math.sqrt(trials)
    before = clamped(rate + TASK_SD * F.col("z0"))
    after = clamped(rate + delta + TASK_SD * (RHO * F.col("z0") + math.sqrt(1 - RHO * RHO) * F.col("z1")))
    return g.select("server", "i", F.lit(tasks).cast("long").alias("n"), clamped(before + sd * F.col("z2")).alias("before"), clamped(after + sd * F.col("z3")).alias("after"))


def detected(pairs: DataFrame, resamples: int = 200, seed: int = 42, paired: bool = True) -> DataFrame:
    """One row: share of simulations whose interval of the mean difference leaves 0."""
    values = pairs.withColumn("x", F.col("after") - F.col("before")).select("server", "i", "n", "x")
    means = resample.replicate_means(values, resamples, seed)
    ci = resample.order_statistics(means, resamples)
    return ci.agg(F.avg(((F.col("lo") > 0) | (F.col("hi") < 0)).cast("double")).alias("power"))


def detectable_effect(spark: SparkSession, tasks: int, power: float = 0.8, sims: int = 50, steps: int = 12, resamples: int = 200, seed: int = 42) -> tuple[float, float]:
    """(effect, power there): the least drop found with that power, by bisection; each step is one distributed job."""
    lo, hi, at = 0.0, 0.6, 0.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        got = detected(task_pairs(spark, sims, tasks, -mid, seed=seed), resamples, seed).first()["power"]
        if got >= power:
            hi, at = mid, got
        else:
            lo = mid
    return hi, at


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def spent(t: float, z: float = resample.Z_975) -> float:
    """Error spent after a share ``t`` of the data, by the O'Brien-Fleming rule."""
    return 2 * (1 - normal_cdf(z / math.sqrt(t)))


def sequential(spark: SparkSession, delta: float, looks: tuple[int, ...] = (20, 40, 80, 160), sims: int = 200, threshold: float = 0.05, seed: int = 42) -> DataFrame:
    """(sim, stopped_at, verdict): a look at each size; direction is judged first, width last.

    How many draws a simulation takes depends on where it stops, so every simulation has a stream of its own
    (seed + number) and runs through its looks in one row's task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sim in b["id"]:
                s = (int(sim) + seed) & MASK

                def draw() -> float:
                    nonlocal s
                    s = (MULTIPLIER * s + INCREMENT) & MASK
                    return s / MASK

                def gauss() -> float:
                    return sum(draw() for _ in range(12)) - 6

                sums = squares = 0.0
                n, verdict = 0, "unresolved"
                for look in looks:
                    while n < look:
                        z = gauss()
                        before = min(1.0, max(0.0, RATE + TASK_SD * z))
                        after = min(1.0, max(0.0, RATE + delta + TASK_SD * (RHO * z + math.sqrt(1 - RHO * RHO) * gauss())))
                        d = min(1.0, max(0.0, after + RESIDUAL_SD * gauss())) - min(1.0, max(0.0, before + RESIDUAL_SD * gauss()))
                        sums, squares, n = sums + d, squares + d * d, n + 1
                    mean = sums / n
                    se = math.sqrt(max(0.0, squares / n - mean * mean) / max(1, n - 1))
                    z = resample.Z_975 / math.sqrt(look / looks[-1])
                    lo, hi = mean - z * se, mean + z * se
                    if hi < -threshold:
                        verdict = "regression"
                    elif lo > threshold:
                        verdict = "improvement"
                    elif lo > -threshold and hi < threshold:
                        verdict = "no_change"
                    if verdict != "unresolved":
                        break
                rows.append((sim, n, verdict))
            yield pd.DataFrame(rows, columns=["sim", "stopped_at", "verdict"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, sims, 1, n).mapInPandas(run, "sim long, stopped_at int, verdict string")
