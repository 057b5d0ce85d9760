"""Ranks, correlations and variance decompositions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Steps

#: Rows that one task of a window over small groups holds.
ROWS = 1 << 19


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as its rows need, so that none of them grows with the table; groups must be small."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // ROWS)), *keys)


def value_places(df: DataFrame, value: str, keys: list[str], steps: Steps, weight: str | None = None) -> DataFrame:
    """(keys, value, k, before, n): how often each value stands in its group, how many lesser ones do, and the group's size; nulls count nothing.

    ``weight`` is a column of repeats. Distinct values are dealt out by ranges of their order, and what the ranges before hold of
    a group is added from a table of sums, so that no task sees a whole group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.when(F.col(value).isNull(), 0).otherwise(F.col(weight) if weight else F.lit(1)).cast("long")
    counts = df.groupBy(*keys, value).agg(F.sum(each).alias("k"))
    ranges = steps.keep(counts.repartitionByRange(parts, *keys, value).withColumn("_range", F.spark_partition_id()), "values")
    ranges = ranges.withColumn("_group", F.struct(F.lit(0).alias("any"), *[F.col(c).alias(f"key{i}") for i, c in enumerate(keys)]))  # equal to itself even where its fields are null
    whole = Window.partitionBy("_group")
    earlier = F.coalesce(F.sum("_sum").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range of a group
    sums = ranges.groupBy("_range", "_group").agg(F.sum("k").alias("_sum"))
    sums = steps.keep(sums.select("_range", "_group", earlier.alias("_earlier"), F.sum("_sum").over(whole).alias("n")), "sums")
    within = F.sum("k").over(Window.partitionBy("_range", "_group").orderBy(value))
    return ranges.join(sums, ["_range", "_group"]).select(*keys, value, "k", (F.col("_earlier") + within - F.col("k")).alias("before"), "n")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(keys, one column for each of ``shares``): percentiles interpolated between the two nearest values, as ``percentile`` does in one task a group."""
    places = value_places(df, value, list(keys), Steps(df.sparkSession, "percentiles"))
    found = {}
    for name, share in shares.items():
        at = (F.col("n") - 1) * share
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("before") <= place) & (place < F.col("before") + F.col("k"))
            found[f"_{name}_{end}"] = F.max(F.when(here, F.col(value)))
        found[f"_{name}_at"] = F.max(at)
    g = places.groupBy(*keys).agg(*[c.alias(n) for n, c in found.items()])

    def between(name: str) -> Column:
        lo, hi, at = (F.col(f"_{name}_{x}") for x in ("lo", "hi", "at"))
        return F.when(F.floor(at) == F.ceil(at), lo.cast("double")).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return g.select(*keys, *[between(name).alias(name) for name in shares])


def average_rank(value: str | Column, *keys: str, descending: bool = False) -> Column:
    """1-based rank within ``keys``; ties share the mean of their span."""
    value = F.col(value) if isinstance(value, str) else value
    order = value.desc() if descending else value.asc()
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def fractional_rank(value: str, key: str) -> Column:
    """0 for the largest of a case, 1 for the smallest, ties averaged; null for a case of one."""
    n = F.count("*").over(Window.partitionBy(key))
    return F.when(n > 1, (average_rank(value, key, descending=True) - 1) / (n - 1))


def unpivoted(df: DataFrame, key: str, against: str, fields: list[str]) -> DataFrame:
    """(field, key, x, y) of every field against one outcome; rows with a null in either are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields]))
    return df.select(key, F.col(against).cast("double").alias("y"), pairs.alias("p")).select("p.field", key, "p.x", "y").where("x is not null and y is not null")


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where either is constant (``corr`` would divide by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def pearson(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, r): correlation of x and y within [-1, 1]; 0 where either is constant."""
    r = F.coalesce(correlation("x", "y"), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"))


def spearman(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, r): rank correlation of x and y, ties averaged; 0 where either is constant. Rows with a null in either are left out.

    Equal pairs travel as one row with their number, and ranks come from ranges of the distinct values, so that a group may be of any size.
    """
    steps = Steps(df.sparkSession, "spearman")
    pairs = df.where("x is not null and y is not null").groupBy(*keys, "x", "y").agg(F.count("*").alias("_c"))
    pairs = steps.keep(pairs, "pairs")
    for c in ("x", "y"):
        # Ranks less their mean: sums of their squares stay exact for longer.
        rank = (F.col("before") + (F.col("k") + 1) / 2.0 - (F.col("n") + 1) / 2.0).alias(f"_r{c}")
        places = value_places(pairs, c, list(keys), steps, "_c").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(c).alias("_v"), rank)
        same = F.col(c) == F.col("_v")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        pairs = pairs.join(places, same).drop("_v", *[f"_k{i}" for i in range(len(keys))])
    product = lambda a, b: F.sum(F.col("_c") * F.col(a) * F.col(b))
    r = F.try_divide(product("_rx", "_ry"), F.sqrt(product("_rx", "_rx")) * F.sqrt(product("_ry", "_ry")))
    return pairs.groupBy(*keys).agg(F.sum("_c").alias("n"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))).alias("r"))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Simpson's rule on the substituted integrand."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    # t = x s^2 takes the singularity out of the integrand where a is one half.
    steps, total = 4000, 0.0
    for i in range(steps + 1):
        s = i / steps
        f = 2 * x**a * s ** (2 * a - 1) * (1 - x * s * s) ** (b - 1) if s > 0 or a >= 0.5 else 0.0
        total += f * (1 if i in (0, steps) else 4 if i % 2 else 2)
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return min(1.0, total / (3 * steps) / math.exp(log_beta))


def two_tailed(r: float, n: int) -> float:
    """P of a correlation ``r`` of ``n`` pairs, by Student's t; 1 below three pairs, 0 for a perfect one."""
    if n <= 2:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return _incomplete_beta(df / 2, 0.5, df / (df + t2))


def with_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Adds ``p``; meant for result rows, one for each field."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[two_tailed(x, int(k)) for x, k in zip(b[r], b[n])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, schema + ", p double")


def correlation_table(df: DataFrame, key: str, against: str, fields: list[str], least: int = 3) -> DataFrame:
    """field, n, status (ok, degenerate, insufficient_n), spearman (null unless ok), strength."""
    long = unpivoted(df, key, against, fields)
    listed = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    stats = long.groupBy("field").agg(F.count("*").alias("n"), F.min("x").alias("_a"), F.max("x").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"))
    rho = spearman(long, "field").select("field", F.col("r").alias("_r"))
    out = listed.join(stats, "field", "left").join(rho, "field", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    flat = (F.col("_a") == F.col("_b")) | (F.col("_c") == F.col("_d"))
    status = F.when(F.col("n") < least, "insufficient_n").when(flat, "degenerate").otherwise("ok")
    out = out.withColumn("status", status).withColumn("spearman", F.when(F.col("status") == "ok", F.col("_r")))
    return out.select("field", "n", "status", "spearman", strength(F.col("spearman")).alias("strength"))


def strength(rho: Column) -> Column:
    """Bands of an absolute correlation; the limits belong to the band below."""
    size = F.abs(rho)
    return F.when(rho.isNull(), None).when(size > 0.5, "large").when(size > 0.3, "medium").when(size > 0.1, "small").otherwise("negligible")


def partial_spearman(df: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """n, rho, df of the rank correlation of x and y with ``control`` held, as one row."""
    d = df.select(F.lit(0).alias("_all"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "a"), (y, "b"), (control, "c"))]).dropna()
    # Ranks of the whole table: counts of the distinct values, summed up in order, joined back.
    for c in ("a", "b", "c"):
        d = global_rank(d, c)
    r = d.agg(F.count("*").alias("n"), correlation("a", "b").alias("ab"), correlation("a", "c").alias("ac"), correlation("b", "c").alias("bc"))
    rho = F.try_divide(F.col("ab") - F.col("ac") * F.col("bc"), F.sqrt((1 - F.col("ac") ** 2) * (1 - F.col("bc") ** 2)))
    return r.select("n", F.coalesce(rho, F.lit(0.0)).alias("rho"), (F.col("n") - 3).alias("df"))


def global_rank(df: DataFrame, col: str) -> DataFrame:
    """``col`` replaced by its average rank in the whole table, by way of its distinct values.

    Distinct values are counted by range partition; each partition sums up after the
    totals of those before it, so no task sees all values.
    """
    values = df.groupBy(col).agg(F.count("*").alias("_k"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.repartitionByRange(n, col).withColumn("_p", F.spark_partition_id())
    totals = ranged.groupBy("_p").agg(F.sum("_k").alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).drop("_t")  # one row a partition
    within = F.sum("_k").over(Window.partitionBy("_p").orderBy(col))
    ranks = ranged.join(F.broadcast(before), "_p").select(F.col(col).alias("_v"), (F.col("_before") + within - F.col("_k") + (F.col("_k") + 1) / 2.0).alias("_rank"))
    return df.join(ranks, F.col(col) == F.col("_v")).withColumn(col, F.col("_rank")).drop("_v", "_rank")


def adjusted_p(df: DataFrame, p: str = "p", key: str | None = None) -> DataFrame:
    """Adds bonferroni and benjamini_hochberg to a table of tests."""
    keys = [key] if key else []
    m = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(p))
    raw = df.withColumns({"_m": m, "_i": i}).withColumn("_q", F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_i")))
    down = Window.partitionBy(*keys).orderBy(F.desc("_i"))
    return raw.withColumns({"bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("_m")), "benjamini_hochberg": F.min("_q").over(down)}).drop("_m", "_i", "_q")


def icc(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: ICC(1) of unbalanced one-way ANOVA, n0, effective n, design effect, share of groups without variance."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    total = g.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("mean")).alias("s"),
        F.sum(F.col("n") * F.col("mean") ** 2).alias("ss"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.sum(F.col("n").cast("double") ** 2).alias("n2"),
        F.avg((F.col("var") < 1e-9).cast("double")).alias("zero_variance_share"),
    )
    c = {n: F.col(n) for n in ("k", "total", "s", "ss", "within", "n2")}
    between = F.try_divide(c["ss"] - c["s"] ** 2 / c["total"], c["k"] - 1)
    within = F.try_divide(c["within"], c["total"] - c["k"])
    n0 = F.try_divide(c["total"] - c["n2"] / c["total"], c["k"] - 1)
    out = total.withColumns({"msb": between, "msw": within, "n0": n0})
    out = out.withColumn("icc", F.coalesce(F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("n0") - 1) * F.col("msw")), F.lit(0.0)))
    effect = design_effect(F.col("icc"), F.col("total") / F.col("k"))
    return out.select("k", "total", "n0", "icc", effect.alias("design_effect"), (F.col("total") / effect).alias("n_eff"), "zero_variance_share")


def design_effect(icc: Column, m: Column) -> Column:
    return 1 + (m - 1) * icc


def nested_shares(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """One row: shares of the total sum of squares between outer groups, between inner groups of one outer, and within."""
    cell = df.where(F.col(value).isNotNull()).groupBy(outer, inner).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mid = cell.groupBy(outer).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"))
    top = mid.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"), F.sum("w").alias("trial"), F.sum(F.col("q") - F.col("n") * F.col("m") ** 2).alias("task"))
    top = top.withColumn("set", F.col("q") - F.col("s") ** 2 / F.col("n")).withColumn("total", F.col("set") + F.col("task") + F.col("trial"))
    return top.select("total", *[F.coalesce(F.try_divide(c, "total"), F.lit(0.0)).alias(f"{c}_share") for c in ("set", "task", "trial")])


def tercile(df: DataFrame, value: str) -> DataFrame:
    """Adds ``tier``: high from the 67th percentile, mid from the 33rd, else low; ties share a tier."""
    cuts = percentiles(df, value, {"_p33": 0.33, "_p67": 0.67})  # one row
    tier = F.when(F.col(value) >= F.col("_p67"), "high").when(F.col(value) >= F.col("_p33"), "mid").otherwise("low")
    return df.crossJoin(F.broadcast(cuts)).withColumn("tier", tier).drop("_p33", "_p67")


def rescaled(value: str, *keys: str) -> Column:
    """0 to 100 between the least and the largest; a constant is 50."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.lit(50.0)).otherwise(100.0 * (F.col(value) - lo) / (hi - lo))


def several_culprits_guard(items: DataFrame) -> DataFrame:
    """One row: how far true items stand out by the size of their change, where a case may have several.

    ``items`` holds case_id, pos, size and truth. A case's largest change is its first largest. A true item is ranked among
    itself and the decoys of its case only (0: largest, 1: smallest, ties averaged; without a decoy not ranked); the mean rank is 0.5 where none is ranked. Cases
    without a true item count as cases.
    """
    true = F.coalesce("truth", F.lit(False))
    decoys = F.array_sort(F.collect_list(F.when(~true, F.col("size"))))  # a case's own items
    case = items.groupBy("case_id").agg(
        F.max_by(true, F.struct("size", (-F.col("pos")).alias("p"))).alias("top"), F.max(F.when(~true, F.col("size"))).alias("decoy"), F.min(F.when(true, F.col("size"))).alias("least"), decoys.alias("decoys"),
    )
    shares = case.agg(F.count("*").alias("n_cases"), F.coalesce(F.avg(F.col("top").cast("double")), F.lit(0.0)).alias("true_is_largest"), F.coalesce(F.avg(F.coalesce(F.col("decoy") > F.col("least"), F.lit(False)).cast("double")), F.lit(0.0)).alias("decoy_over_least_true"))
    one = items.where(true).join(case.select("case_id", "decoys"), "case_id")
    larger = F.size(F.filter("decoys", lambda d: d > F.col("size")))
    ties = F.size(F.filter("decoys", lambda d: d == F.col("size")))
    rank = F.when(F.size("decoys") > 0, (larger + ties / 2) / F.size("decoys"))
    each = one.agg(F.count("*").alias("n_true"), F.count_distinct("pos").alias("n_positions"), F.coalesce(F.avg(rank), F.lit(0.5)).alias("mean_fractional_rank"))
    return shares.crossJoin(each)  # one row each
