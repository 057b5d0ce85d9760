"""Bootstrap replicates and intervals on the reproducible stream.

The draw of replicate r and position j is draw number r * n + j + 1, so replicates
are made by any task in any order (see ``replicates``); draws are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trials
from .ranks import average_rank, correlation
from .replicates import replicate_sums
from .rng import pick

# Two-sided 97.5 % points of Student's t for 1 to 29 degrees of freedom, then the normal one.
T_975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045,
)
Z_975 = 1.959964


def t_critical(df: Column) -> Column:
    """The table's value; below one degree as for one, from 30 on the normal value."""
    table = F.array(*[F.lit(x) for x in T_975])
    return F.when(df >= 30, F.lit(Z_975)).otherwise(F.get(table, (F.greatest(df, F.lit(1)) - 1).cast("int")))


def bounds(resamples: int, ci: float = 0.95) -> tuple[int, int]:
    """Positions (from 0) of the lower and upper bound among sorted replicates."""
    return int((1 - ci) / 2 * resamples), min(int((1 + ci) / 2 * resamples) - 1, resamples - 1)


def replicate_means(values: DataFrame, resamples: int = 2000, seed: int = 42, key: str = "server") -> DataFrame:
    """(key, r, m): means of ``resamples`` draws with replacement of ``values`` (key, i, n, x)."""
    sums = replicate_sums(values, resamples, seed, (key,), F.col("n"), F.lit(0))
    return sums.select(key, "r", (F.col("s") / F.col("n")).alias("m"))


def flipped_means(values: DataFrame, resamples: int = 2000, seed: int = 42, key: str = "server") -> DataFrame:
    """(key, r, m): wild replicates, every deviation from the mean with a random sign."""
    point = values.groupBy(key).agg(F.avg("x").alias("point"))
    sums = replicate_sums(values.join(point, key), resamples, seed, (key,), F.col("n"), F.lit(0), F.col("point"))
    return sums.join(point, key).select(key, "r", (F.col("point") + F.col("s") / F.col("n")).alias("m"))


def order_statistics(replicates: DataFrame, resamples: int, ci: float = 0.95, key: str = "server") -> DataFrame:
    """(key, lo, hi): the sorted replicates at the bounds."""
    lo, hi = bounds(resamples, ci)
    place = F.row_number().over(Window.partitionBy(key).orderBy("m"))
    ranked = replicates.withColumn("_p", place)
    return ranked.where(F.col("_p").isin(lo + 1, hi + 1)).groupBy(key).agg(F.max(F.when(F.col("_p") == lo + 1, F.col("m"))).alias("lo"), F.max(F.when(F.col("_p") == hi + 1, F.col("m"))).alias("hi"))


def spread(replicates: DataFrame, key: str = "server") -> DataFrame:
    return replicates.groupBy(key).agg(F.stddev_samp("m").alias("se"))


def difference_replicates(before: DataFrame, after: DataFrame, resamples: int = 2000, seed: int = 42, key: str = "server") -> DataFrame:
    """(key, r, m): means of resampled ``after`` less those of resampled ``before``; before draws first, one stream."""
    sizes = before.select(key, F.col("n").alias("nb")).distinct().join(after.select(key, F.col("n").alias("na")).distinct(), key)

    def side(values: DataFrame, arm: int) -> DataFrame:
        both, offset = F.col("nb") + F.col("na"), F.col("nb") if arm else F.lit(0)
        sums = replicate_sums(values.join(sizes, key), resamples, seed, (key,), both, offset)
        return sums.select(key, "r", (F.col("s") / F.col("n") * (1 if arm else -1)).alias("m"))

    return side(before, 0).unionByName(side(after, 1)).groupBy(key, "r").agg(F.sum("m").alias("m"))


def spearman_interval(pairs: DataFrame, key: str, order: str, resamples: int = 2000, seed: int = 42, ci: float = 0.95) -> DataFrame:
    """(key, ci_lo, ci_hi, skipped): percentile interval of Spearman's rho of (x, y), pairs drawn together.

    Replicates with a constant side have no rho and are counted as skipped; fewer than
    two others give no interval. Pairs are numbered by ``order``; rows with a null in
    either are left out. Percentiles are interpolated.
    """
    known = pairs.where("x is not null and y is not null")
    values = trials.indexed(known.withColumn("_v", F.struct("x", "y")), "_v", order, key)
    drawn = values.select(key, "i", "n").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = drawn.select(key, "r", pick(F.col("r").cast("long") * F.col("n") + F.col("i") + 1, F.col("n"), seed).alias("i"))
    ranked = drawn.join(values.select(key, "i", F.col("x").alias("_v")), [key, "i"]).select(key, "r", "_v.x", "_v.y")
    ranked = ranked.withColumns({"x": average_rank("x", key, "r"), "y": average_rank("y", key, "r")})
    rho = ranked.groupBy(key, "r").agg(F.when((F.min("x") < F.max("x")) & (F.min("y") < F.max("y")), correlation("x", "y")).alias("rho"))
    low, high = (1 - ci) / 2, (1 + ci) / 2
    bound = lambda p: F.when(F.count("rho") >= 2, F.round(F.percentile("rho", F.lit(p)), 4))
    return rho.groupBy(key).agg(bound(low).alias("ci_lo"), bound(high).alias("ci_hi"), F.count_if(F.col("rho").isNull()).alias("skipped"))
