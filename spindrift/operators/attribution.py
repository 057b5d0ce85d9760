"""Which changed item moved the outcome: coalitions, contrasts, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rng import uniform


def ranked(scores: DataFrame, key: str, score: str, position: str) -> DataFrame:
    """Adds ``rank``: highest score first, ties in input order."""
    order = Window.partitionBy(key).orderBy(F.desc(score), position)
    return scores.withColumn("rank", F.row_number().over(order))


def ablation(items: DataFrame, probes: DataFrame) -> DataFrame:
    """Each item's own probe, ranked. ``probes`` holds (case_id, coalition, delta); a coalition is a sorted array."""
    alone = items.withColumn("coalition", F.array("item"))
    return ranked(alone.join(probes, ["case_id", "coalition"]), "case_id", "delta", "pos").select("case_id", "item", "delta", "rank")


def budget(n: Column) -> Column:
    """Half of the items, rounded up, at least two, but fewer than there are."""
    return F.greatest(F.lit(1), F.least(F.greatest(F.ceil(n / 2), F.lit(2)), n - 1)).cast("int")


def coalitions(items: DataFrame, rounds: Column | int, seed: int = 42) -> DataFrame:
    """(case_id, b, item, pos, inside): membership of every item in every drawn coalition.

    ``items`` holds (case_id, item, pos, n); round b of item i is draw b n + i + 1.
    """
    b = F.explode(F.sequence(F.lit(0), F.lit(rounds) - 1 if isinstance(rounds, int) else rounds - 1))
    drawn = items.withColumn("b", b)
    k = F.col("b").cast("long") * F.col("n") + F.col("pos") + 1
    return drawn.withColumn("inside", uniform(k, seed) < 0.5).select("case_id", "b", "item", "pos", "inside")


def sampled_shapley(items: DataFrame, effect: DataFrame, rounds: Column | int, seed: int = 42) -> DataFrame:
    """Mean outcome with an item less the mean without, over drawn coalitions; the empty one counts 0.

    ``effect`` holds (case_id, item, effect): the probe of a coalition is the sum of its items' effects.
    """
    m = coalitions(items, rounds, seed)
    probe = m.join(effect, ["case_id", "item"]).groupBy("case_id", "b").agg(F.sum(F.when(F.col("inside"), F.col("effect")).otherwise(0.0)).alias("v"), F.array_sort(F.collect_list(F.when(F.col("inside"), F.col("item")))).alias("coalition"))
    used = probe.where(F.size("coalition") > 0).groupBy("case_id").agg(F.countDistinct("coalition").alias("probes"))
    with_v = m.join(probe.select("case_id", "b", "v"), ["case_id", "b"])
    # The empty coalition stands once among those without the item.
    g = with_v.groupBy("case_id", "item", "pos").agg(
        F.avg(F.when(F.col("inside"), F.col("v"))).alias("inside"),
        (F.sum(F.when(~F.col("inside"), F.col("v")).otherwise(0.0)) / (F.count_if(~F.col("inside")) + 1)).alias("outside"),
    )
    g = g.withColumn("delta", F.coalesce("inside", F.lit(0.0)) - F.col("outside"))
    return ranked(g, "case_id", "delta", "pos").join(used, "case_id", "left").select("case_id", "item", "delta", "rank", F.coalesce("probes", F.lit(0).cast("long")).alias("probes"))


def largest_change(items: DataFrame, before: str, after: str) -> DataFrame:
    """Items ranked by the edit distance of their texts."""
    d = items.withColumn("distance", F.levenshtein(before, after))
    return ranked(d, "case_id", "distance", "pos").select("case_id", "item", "distance", "rank")


def bisection(items: DataFrame, effect: DataFrame, threshold: float, levels: int = 12, margin: float = 0.0) -> DataFrame:
    """(case_id, item, effect): one culprit of every case by halving, where there is one.

    The probe of a set of items is the sum of their effects, known to ``margin`` either
    way. The first half (rounded down) is kept if the lower bound of its probe is over
    ``threshold``, else the other. The last item is probed alone, and is a culprit only
    if its own lower bound is over ``threshold``. All cases advance one level at a time;
    ``levels`` halvings suffice for 2^levels items.
    """
    state = items.join(effect, ["case_id", "item"]).select("case_id", "item", "pos", "effect")
    w = Window.partitionBy("case_id")
    for _ in range(levels):
        half = F.row_number().over(w.orderBy("pos")) <= F.floor(F.count("*").over(w) / 2)
        marked = state.withColumns({"_h": half, "_n": F.count("*").over(w)})
        hit = F.sum(F.when(F.col("_h"), F.col("effect")).otherwise(0.0)).over(w) - F.lit(margin) > threshold
        state = marked.withColumn("_keep", (F.col("_n") == 1) | (F.col("_h") == hit)).where("_keep").select("case_id", "item", "pos", "effect")
    return state.where(F.col("effect") - F.lit(margin) > threshold).select("case_id", "item", "effect")


def greedy_bisection(items: DataFrame, effect: DataFrame, threshold: float, levels: int = 12, margin: float = 0.0, culprits: int = 3) -> DataFrame:
    """(case_id, found, item, effect): culprits one after the other, those found before being held fixed.

    A set's effect over what is found already is the sum of its own items' effects, so
    each search is a bisection of the rest; a case without a further culprit is done.
    """
    out, rest = None, items
    for k in range(1, culprits + 1):
        one = bisection(rest, effect, threshold, levels, margin).withColumn("found", F.lit(k))
        out = one if out is None else out.unionByName(one)
        rest = rest.join(one.select("case_id", "item"), ["case_id", "item"], "left_anti").join(one.select("case_id"), "case_id", "left_semi")
    return out.select("case_id", "found", "item", "effect")


def hits(ranks: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """For each case: whether all true items are among the first k, and the share that is."""
    joined = truth.join(ranks.select("case_id", "item", "rank"), ["case_id", "item"], "left")
    inside = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    return joined.groupBy("case_id").agg(*[F.bool_and(inside(k)).alias(f"top{k}") for k in ks], *[F.avg(inside(k).cast("double")).alias(f"recall{k}") for k in ks])


def random_hit(n: Column, k: int, m: Column | None = None) -> Column:
    """Chance that the first k of a random order hold one true item, or all m: C(n - m, k - m) / C(n, k)."""
    if m is None:
        return F.least(F.lit(float(k)), n.cast("double")) / n
    step = lambda a, i: a * F.greatest(F.lit(0.0), F.lit(float(k)) - i) / F.greatest(F.lit(1.0), n - i)
    return F.when(m > k, F.when(n <= k, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0), m.cast("int") - 1), F.lit(1.0), step)))


def shuffled(items: DataFrame, seed: int = 42) -> DataFrame:
    """A reproducible random order: sorted by the item's draw, ties by position."""
    drawn = items.withColumn("_u", uniform(F.col("pos") + 1, seed))
    order = Window.partitionBy("case_id").orderBy("_u", "pos")
    return drawn.withColumn("rank", F.row_number().over(order)).drop("_u")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
