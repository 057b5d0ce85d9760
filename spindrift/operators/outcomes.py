"""Outcomes of recorded runs: how answers are classed, and rates over tasks, families and arms.

A run is (server, arm, task, trial, gold, selected, success); ``gold`` is the right tool.
Shares are 0 where nothing counts, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paired import mcnemar

CORRECT, WRONG, ABSTAINED = "correct", "wrong", "abstained"
FEW_CONTESTED = 6  # contested tasks below which a sign test decides nothing


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def loose_outcome(selected: Column, gold: Column, known: tuple[str, ...]) -> Column:
    """Case and surrounding space do not count; a null or an unknown tool is an abstention."""
    name = F.lower(F.regexp_replace(selected, r"^\s+|\s+$", ""))
    return F.when(name == F.lower(gold), CORRECT).when(name.isin(*[k.lower() for k in known]), WRONG).otherwise(ABSTAINED)


def strict_outcome(raw: Column, gold: Column, known: tuple[str, ...]) -> Column:
    """The first word of an answer, without marks at its end, decides; an unknown one is an abstention."""
    word = F.regexp_replace(F.regexp_extract(raw, r"^\s*(\S+)", 1), "[.,;:!?]+$", "")
    return F.when(~F.coalesce(word.isin(*known), F.lit(False)), ABSTAINED).when(word == gold, CORRECT).otherwise(WRONG)


def percentages(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, selection_accuracy, call_correctness): percent of runs, one place, halves to even."""
    percent = lambda hit: F.bround(100 * F.try_divide(F.count_if(hit), F.count("*")), 1)
    return runs.groupBy(*keys).agg(percent(F.col("selected") == F.col("gold")).alias("selection_accuracy"), percent(F.col("success")).alias("call_correctness"))


def parse_failed(runs: DataFrame, valid: DataFrame, *keys: str) -> DataFrame:
    """(keys, parse_failed): runs whose choice is none of ``valid`` (selected); null is none."""
    marked = runs.join(valid.select("selected", F.lit(True).alias("_valid")).distinct(), "selected", "left")
    return marked.groupBy(*keys).agg(F.count_if(F.col("_valid").isNull()).alias("parse_failed"))


def answered_accuracy(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_correct, n_answered, accuracy): abstentions are left out of both."""
    g = runs.groupBy(*keys).agg(F.count_if(F.col("outcome") == CORRECT).alias("n_correct"), F.count_if(F.col("outcome") != ABSTAINED).alias("n_answered"))
    return g.withColumn("accuracy", share(F.col("n_correct"), F.col("n_answered")))


def outcome_counts(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in (CORRECT, WRONG, ABSTAINED)])


def wrong_destructive(runs: DataFrame, destructive: tuple[str, ...], valid: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, n_wrong, n_answered, rate): destructive choices where the right tool destroys nothing."""
    r = runs.where(~F.col("gold").isin(*destructive) & F.col("selected").isin(*valid))
    g = r.groupBy(*keys).agg(F.count_if(F.col("selected").isin(*destructive)).alias("n_wrong"), F.count("*").alias("n_answered"))
    return g.withColumn("rate", share(F.col("n_wrong"), F.col("n_answered")))


def decomposed(trials: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, n_right_tool, wrong_tool_rate, argument_score): the score is null where no run chose the right tool."""
    right = F.coalesce(F.col("selected") == F.col("task"), F.lit(False))
    return trials.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(right).alias("n_right_tool"), (F.count_if(~right) / F.count("*")).alias("wrong_tool_rate"), F.avg(F.when(right, F.col("cs"))).alias("argument_score"))


def paired_arms(runs: DataFrame, key: str = "server", a: str = "a", b: str = "b", noise: str = "a_noise", strict: bool = False) -> DataFrame:
    """For each key: what arm b gains over a in points, the noise floor of a second run of a, and McNemar's test of selection and of correctness.

    Runs of both arms pair by task and trial. ``problem`` says what speaks against comparing them: an arm is missing, the arms
    a and b have other tool names (``gold``), or the three arms differ in their number of runs; null if nothing does. With ``strict``
    such a key fails the job. Figures that lack an arm are null.
    """
    p = percentages(runs, key, "arm")
    side = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    axes = {"selection": "selection_accuracy", "correctness": "call_correctness"}
    arms = (a, b, noise)
    wide = p.groupBy(key).agg(*[side(arm, c).alias(f"_{n}_{k}") for n, c in axes.items() for k, arm in enumerate(arms)])
    deltas = [F.bround(F.col(f"_{n}_1") - F.col(f"_{n}_0"), 1).alias(f"{n}_delta") for n in axes]
    floors = [F.bround(F.abs(F.col(f"_{n}_2") - F.col(f"_{n}_0")), 1).alias(f"{n}_floor") for n in axes]

    of_arm = lambda x: F.col("arm") == x
    sizes = runs.groupBy(key).agg(*[F.count_if(of_arm(x)).alias(f"_n{k}") for k, x in enumerate(arms)], *[F.array_sort(F.collect_set(F.when(of_arm(x), F.col("gold")))).alias(f"_names{k}") for k, x in enumerate((a, b))])
    counts = [F.col(f"_n{k}") for k in range(3)]
    problem = F.when(F.least(*counts) == 0, "arm missing").when(F.col("_names0") != F.col("_names1"), "names differ").when(F.least(*counts) != F.greatest(*counts), "counts differ")
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(F.col(key).cast("string"), F.lit(": "), problem)).cast("string"))
    out = wide.select(key, *deltas, *floors).join(sizes.select(key, problem.alias("problem")), key)

    hits = {"selection": F.coalesce(F.col("selected") == F.col("gold"), F.lit(False)), "correctness": F.coalesce("success", F.lit(False))}
    of = lambda arm: runs.where(of_arm(arm)).select(key, "task", "trial", *[h.alias(f"_{n}_{arm}") for n, h in hits.items()])
    pairs = of(a).join(of(b), [key, "task", "trial"])
    for n in axes:
        test = mcnemar(pairs, f"_{n}_{a}", f"_{n}_{b}", key)
        out = out.join(test.select(key, *[F.col(c).alias(f"{n}_{c}") for c in test.columns if c != key]), key, "left")
    return out


def effect_errors(effects: DataFrame) -> DataFrame:
    """``effects`` with ``errors``: names of the invariants that a row breaks, empty if it holds.

    A row has arm_a_accuracy, arm_b_accuracy, effect_pp, n_contested, n_plus, n_minus, n_ties, n_stable, aborted, headroom_gated.
    """
    outside = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    rules = {
        "few_contested": F.col("n_contested") < FEW_CONTESTED,
        "no_headroom_not_aborted": ~F.col("aborted") & ~F.col("headroom_gated"),
        "effect_mismatch": F.abs(F.col("effect_pp") - (F.col("arm_b_accuracy") - F.col("arm_a_accuracy")) * 100) > 0.05,
        "counts_mismatch": F.col("n_plus") + F.col("n_minus") + F.col("n_ties") != F.col("n_stable"),
        "arm_a_outside": outside("arm_a_accuracy"),
        "arm_b_outside": outside("arm_b_accuracy"),
    }
    return effects.withColumn("errors", F.filter(F.array(*[F.when(broken, name) for name, broken in rules.items()]), lambda e: e.isNotNull()))


def json_object(response: Column) -> Column:
    """The JSON object in an answer as text, null if there is none: fences are taken off, then the whole, then first to last brace."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = F.regexp_replace(trim(response), r"(?i)^```(?:json)?\s*\n?", "")
    bare = trim(F.regexp_replace(trim(bare), r"\n?```\s*$", ""))
    braced = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    end = "end of the answer"  # the parser stops after the first value, so one is put behind it that must be the second

    def is_object(c: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f', "{end}"]')))
        return c.startswith("{") & F.coalesce(F.try_variant_get(listed, "$[1]", "string") == end, F.lit(False))

    return F.when(is_object(bare), bare).when(is_object(braced), braced)
