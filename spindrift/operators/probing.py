"""Searches that ask for probes as they go, for all cases at once.

A probe says what comes of a coalition of a case's items: a function from (case_id, coalition) to the same
with delta, ci_lo and ci_hi; coalitions are sorted arrays. What has been asked is kept in a table of the
shared folder and carried from step to step, so no coalition of a case is asked for twice. A probe whose answers
follow from a few values of the case (``Additive``) has these put beside the case once; it then answers in
the case's own row, so a step neither shuffles nor reads what has been asked before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Steps
from .attribution import budget
from .rng import uniform

Probe = Callable[[DataFrame], DataFrame]
FOUND = "array<struct<item:string,delta:double,ci_lo:double,ci_hi:double>>"


class Memo:
    """Answers so far. Asking for nothing is answered with nothing: the empty coalition has no effect."""

    def __init__(self, probe: Probe, steps: Steps):
        self.probe, self.steps = probe, steps
        self.place, self.times = steps.place("probes"), 0

    def ask(self, wanted: DataFrame) -> DataFrame:
        """(case_id, coalition, delta, ci_lo, ci_hi) for the coalitions in ``wanted``; only new ones are probed."""
        wanted = wanted.select("case_id", "coalition").distinct()
        asked = wanted.where(F.size("coalition") > 0)
        if self.times:
            asked = asked.join(self.steps.parts(self.place, self.schema), ["case_id", "coalition"], "left_anti")
        numbers = [F.col(c).cast("double").alias(c) for c in ("delta", "ci_lo", "ci_hi")]
        self.schema = self.steps.add(self.probe(asked).select("case_id", "coalition", *numbers), self.place, self.times).schema
        self.times += 1
        answers = self.steps.parts(self.place, self.schema).join(wanted, ["case_id", "coalition"], "left_semi")
        nothing = [F.lit(0.0).alias(c) for c in ("delta", "ci_lo", "ci_hi")]
        return answers.unionByName(wanted.where(F.size("coalition") == 0).select("case_id", "coalition", *nothing))


class Additive:
    """Probes that add up the effects (case_id, item, effect) of a coalition's items, known to ``margin`` either way."""

    def __init__(self, effect: DataFrame, margin: float = 0.0):
        self.effect, self.margin = effect, margin

    def carried(self, cases: DataFrame) -> DataFrame:
        """``cases`` with their ``effects``, as ``answer`` needs them."""
        own = self.effect.where("item is not null").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("item", F.col("effect").cast("double").alias("effect")))).alias("effects"))
        return cases.join(own, "case_id", "left").withColumn("effects", F.coalesce("effects", F.array().cast("array<struct<item:string,effect:double>>")))

    def answer(self, coalition: Column) -> Column:
        """delta, ci_lo and ci_hi of a coalition of the row's case."""
        of = F.filter("effects", lambda e: F.array_contains(coalition, e["item"]))
        return self._bounds(F.aggregate(of, F.lit(0.0), lambda a, e: a + F.coalesce(e["effect"], F.lit(0.0))))

    def _bounds(self, delta: Column) -> Column:
        return F.struct(delta.alias("delta"), (delta - self.margin).alias("ci_lo"), (delta + self.margin).alias("ci_hi"))

    def __call__(self, wanted: DataFrame) -> DataFrame:
        each = wanted.select("case_id", "coalition", F.explode("coalition").alias("item")).join(self.effect.select("case_id", "item", "effect"), ["case_id", "item"], "left")
        total = each.groupBy("case_id", "coalition").agg(F.sum(F.coalesce("effect", F.lit(0.0))).alias("delta"))
        return total.select("case_id", "coalition", self._bounds(F.col("delta")).alias("a")).select("case_id", "coalition", "a.*")


additive = Additive


def _overlay(old: Column, new: Column) -> Column:
    """Both maps, the second one's values where both have a key."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def _constant(items: Column, value: Column) -> Column:
    return F.map_from_arrays(items, F.transform(items, lambda _: value))


def bisection_search(cases: DataFrame, probe: Probe, threshold: float, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Culprits of every case by halving, one after the other, until a search finds none.

    ``cases`` holds case_id and ``items``, an array in the order in which halves are taken. What is found is held
    in the coalition from then on, and effects count over and above it. The first half (rounded down) is kept
    if its lower bound is over ``threshold``, else the other; the last item is asked alone, and only if its own lower bound
    is over ``threshold`` is it a culprit. All cases go on step by step; the number of steps is that of the case that
    takes most.

    Result: the ranking (case_id, item, rank, delta, ci_lo, ci_hi, culprit, probes), culprits first by effect, then the others
    by the effect of the half that they were ruled out with (bounds null), ties in the order of ``items``; ``probes`` counts every
    question of the case, repeated ones too. And the decisions (case_id, step, probed, base, delta, ci_lo, significant).
    A case without items has no rows in either.
    """
    in_row = isinstance(probe, Additive)
    memo, values = None if in_row else Memo(probe, steps), ["effects"] if in_row else []
    cases = probe.carried(cases) if in_row else cases
    no_items, no_score, none = F.array().cast("array<string>"), F.create_map().cast("map<string,double>"), F.array().cast(FOUND)
    start = cases.where(F.size("items") > 0).select(
        "case_id", "items", F.col("items").alias("rest"), F.col("items").alias("open"), no_items.alias("base"), F.lit(0.0).alias("base_delta"),
        F.lit(0).cast("long").alias("probes"), no_score.alias("ruled_out"), none.alias("found"), F.lit(True).alias("active"), *values,
    )
    state, place, step = steps.keep(start, "start"), steps.place("steps"), 0
    if state.isEmpty():
        empty = start.select("case_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item", "string"), ("rank", "int"), ("delta", "double"), ("ci_lo", "double"), ("ci_hi", "double"), ("culprit", "boolean"), ("probes", "long"))])
        trace = start.select("case_id", F.lit(0).alias("step"), F.col("open").alias("probed"), "base", F.lit(0.0).alias("delta"), F.lit(0.0).alias("ci_lo"), F.lit(False).alias("significant"))
        return empty, trace
    while not state.isEmpty():
        step += 1
        n = F.size("open")
        probed = F.when(n > 1, F.slice("open", F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.col("open"))
        asked = state.withColumn("probed", probed).withColumn("coalition", F.array_sort(F.concat("base", "probed")))
        if in_row:
            answered = asked.withColumn("_answer", probe.answer(F.col("coalition"))).select("*", "_answer.*")
        else:
            answered = asked.join(memo.ask(asked), ["case_id", "coalition"])
        for c in ("delta", "ci_lo", "ci_hi"):
            answered = answered.withColumn(c, F.col(c) - F.col("base_delta"))
        answered = answered.withColumn("significant", F.col("ci_lo") > threshold)

        single, hit, gain = F.size("open") == 1, F.col("significant"), F.col("delta")
        other = F.array_except("open", "probed")
        ruled = F.when(single & hit, no_score).when(~single & hit, _constant(other, F.lit(0.0))).otherwise(_constant(F.col("probed"), gain))
        rest = F.when(single & hit, F.array_except("rest", "probed")).otherwise(F.col("rest"))
        culprit = F.array(F.struct(F.get("probed", F.lit(0)).alias("item"), "delta", "ci_lo", "ci_hi"))
        moved = answered.select(
            "case_id", "items", rest.alias("rest"),
            F.when(single, rest).when(hit, F.col("probed")).otherwise(other).alias("open"),
            F.when(single & hit, F.concat("base", "probed")).otherwise(F.col("base")).alias("base"),
            F.when(single & hit, gain + F.col("base_delta")).otherwise(F.col("base_delta")).alias("base_delta"),
            (F.col("probes") + 1).alias("probes"),
            _overlay(F.col("ruled_out"), ruled).alias("ruled_out"),
            F.when(single & hit, F.concat("found", culprit)).otherwise(F.col("found")).alias("found"),
            (~single | (hit & (F.size(rest) > 0))).alias("active"),
            F.struct(F.lit(step).alias("step"), "probed", "base", "delta", "ci_lo", "significant").alias("decision"),
            *values,
        )
        state = steps.add(moved, place, step).where("active")
    every = steps.parts(place, state.schema)
    return _ranking(every.where("not active")), every.select("case_id", "decision.*")


def _ranking(done: DataFrame) -> DataFrame:
    """Places within a case come from sorting its own arrays, which are as long as its items."""
    place = lambda x: F.array_position("items", x)
    culprits = F.transform("found", lambda f, i: F.struct(F.lit(0).alias("later"), (-f["delta"]).alias("by"), i.cast("long").alias("at"), f["item"].alias("item"), f["delta"].alias("delta"), f["ci_lo"].alias("ci_lo"), f["ci_hi"].alias("ci_hi")))
    others = F.array_except("items", F.transform("found", lambda f: f["item"]))
    score = lambda x: F.coalesce(F.try_element_at("ruled_out", x), F.lit(0.0))
    nothing = F.lit(None).cast("double")
    rest = F.transform(others, lambda x: F.struct(F.lit(1).alias("later"), (-score(x)).alias("by"), place(x).alias("at"), x.alias("item"), score(x).alias("delta"), nothing.alias("ci_lo"), nothing.alias("ci_hi")))
    rows = done.select("case_id", "probes", F.posexplode(F.array_sort(F.concat(culprits, rest))).alias("at", "r"))
    return rows.select("case_id", "r.item", (F.col("at") + 1).alias("rank"), "r.delta", "r.ci_lo", "r.ci_hi", (F.col("r.later") == 0).alias("culprit"), "probes")


def shapley_search(cases: DataFrame, probe: Probe, steps: Steps, seed: int = 42) -> DataFrame:
    """(case_id, item, rank, delta, ci_lo, ci_hi, probes): the mean outcome with an item less the mean without.

    ``cases`` holds case_id and ``items``. Half as many coalitions as items are drawn (rounded up, two at least, fewer than the
    items; one item: one), an item being in with chance one half: item i of round b is draw b n + i + 1. Only different coalitions that
    hold an item are asked for and counted in ``probes``; the empty one stands among those without an item once more. The interval
    is half the mean width of the probes with the item to either side. Ties are ranked in the order of ``items``.
    """
    n, in_row = F.size("items"), isinstance(probe, Additive)
    rounds = F.when(n <= 1, n).otherwise(budget(n))
    drawn = lambda b: F.array_sort(F.filter("items", lambda _, i: uniform(b.cast("long") * n + i + 1, seed) < 0.5))
    cases = (probe.carried(cases) if in_row else cases).where(n > 0)
    sets = steps.keep(cases.withColumn("sets", F.transform(F.sequence(F.lit(0), rounds - 1), drawn)), "coalitions")
    nothing = F.struct(*[F.lit(0.0).alias(c) for c in ("delta", "ci_lo", "ci_hi")])
    if in_row:
        found = probe.answer
    else:
        asked = sets.select("case_id", F.explode("sets").alias("coalition"))
        answers = Memo(probe, steps).ask(asked).groupBy("case_id").agg(F.collect_list(F.struct("coalition", "delta", "ci_lo", "ci_hi")).alias("known"))
        sets = sets.join(answers, "case_id")
        found = lambda s: F.transform(F.slice(F.filter("known", lambda k: k["coalition"] == s), 1, 1), lambda k: F.struct(*[k[c].alias(c) for c in ("delta", "ci_lo", "ci_hi")]))[0]
    answered = sets.withColumn("rounds", F.transform("sets", lambda s: F.struct(s.alias("coalition"), F.when(F.size(s) > 0, found(s)).otherwise(nothing).alias("a"))))

    def row(x: Column, pos: Column) -> Column:
        parts = ("inside", "n_inside", "outside", "n_outside", "width")

        def add(total: Column, r: Column) -> Column:
            inside = F.array_contains(r["coalition"], x)
            more = {"inside": r["a"]["delta"], "n_inside": F.lit(1.0), "width": r["a"]["ci_hi"] - r["a"]["ci_lo"]}
            less = {"outside": r["a"]["delta"], "n_outside": F.lit(1.0)}
            return F.struct(*[(total[p] + F.when(inside, more.get(p, F.lit(0.0))).otherwise(less.get(p, F.lit(0.0)))).alias(p) for p in parts])

        total = F.aggregate("rounds", F.struct(*[F.lit(0.0).alias(p) for p in parts]), add)
        return F.struct(x.alias("item"), pos.alias("pos"), total.alias("t"))

    def ranked(q: Column) -> Column:
        t = q["t"]
        per = lambda v: F.when(t["n_inside"] > 0, v / t["n_inside"]).otherwise(0.0)
        delta = per(t["inside"]) - t["outside"] / (t["n_outside"] + 1)
        return F.struct((-delta).alias("by"), q["pos"].alias("pos"), q["item"].alias("item"), delta.alias("delta"), (per(t["width"]) / 2).alias("half"))

    probes = F.size(F.array_distinct(F.filter("sets", lambda s: F.size(s) > 0))).cast("long")
    items = answered.select("case_id", probes.alias("probes"), F.transform("items", row).alias("totals"))
    rows = items.select("case_id", "probes", F.posexplode(F.array_sort(F.transform("totals", ranked))).alias("at", "r"))
    return rows.select("case_id", "r.item", (F.col("at") + 1).alias("rank"), "r.delta", (F.col("r.delta") - F.col("r.half")).alias("ci_lo"), (F.col("r.delta") + F.col("r.half")).alias("ci_hi"), "probes")


def traced(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Decisions of a search held against the true culprit (case_id, item) of their case.

    A half is rightly called significant if the culprit is in it and not in the base already. Adds ``truly`` and ``verdict``:
    ``correct``, ``lack of power`` (an effect that was there was not seen) or ``false positive``. Cases without a known culprit are left out.
    """
    joined = decisions.join(truth.select("case_id", F.col("item").alias("_true")).distinct(), "case_id")
    joined = joined.withColumn("truly", F.array_contains("probed", F.col("_true")) & ~F.array_contains("base", F.col("_true")))
    verdict = F.when(F.col("truly") == F.col("significant"), "correct").when(F.col("truly"), "lack of power").otherwise("false positive")
    return joined.withColumn("verdict", verdict).drop("_true")


def bucket_scores(rankings: DataFrame, truth: DataFrame) -> DataFrame:
    """(bucket, strategy, n_cases, top1, top3, recall_at_m, mean_probes) of rankings (bucket, strategy, case_id, item, rank, probes).

    Strict: all culprits of a case among the first 1 or 3; recall at the number m of its culprits. ``truth`` holds (case_id, item).
    """
    m = truth.groupBy("case_id").agg(F.count_distinct("item").alias("m"))
    marked = rankings.join(truth.select("case_id", "item", F.lit(1).alias("_true")).distinct(), ["case_id", "item"], "left").join(m, "case_id")
    within = lambda k: F.sum(F.when((F.col("_true") == 1) & (F.col("rank") <= k), 1).otherwise(0))
    case = marked.groupBy("bucket", "strategy", "case_id").agg(F.first("m").alias("m"), within(1).alias("in1"), within(3).alias("in3"), within(F.col("m")).alias("inm"), F.max("probes").alias("probes"))
    hit = lambda c: F.avg((F.col(c) == F.col("m")).cast("double"))
    return case.groupBy("bucket", "strategy").agg(F.count("*").alias("n_cases"), hit("in1").alias("top1"), hit("in3").alias("top3"), F.avg(F.col("inm") / F.col("m")).alias("recall_at_m"), F.avg("probes").alias("mean_probes"))
