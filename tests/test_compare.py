"""Edge cases of outcomes, pairing, adjustment, bootstrap and verdicts."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import attribution, compare, paired, ranks, resample, rng, trials

SCHEMA = "server string, arm string, task string, selected string, cs double, trial int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA)


def sequential(seed, n):
    s, out = seed & rng.MASK, []
    for _ in range(n):
        s = (rng.MULTIPLIER * s + rng.INCREMENT) & rng.MASK
        out.append(s / rng.MASK)
    return out


@pytest.mark.parametrize("seed", [0, 42, 2**31 + 5])
def test_stream_is_the_sequential_one(spark, seed):
    got = [r[0] for r in spark.range(1, 3000).orderBy("id").select(rng.uniform(F.col("id"), seed)).collect()]
    assert got == sequential(seed, 2999)


def test_pick_of_a_draw_of_one_is_the_last(spark):
    n = F.lit(7).cast("long")
    assert spark.range(1).select(F.least(F.floor(F.lit(1.0) * n), n - 1)).first()[0] == 6


def test_outcomes(spark):
    rows = trials.with_outcomes(frame(spark, [("s", "before", "t", "x", 1.0), ("s", "before", "t", None, 1.0), ("s", "before", "t", "t", 0.5), ("s", "before", "t", "t", None)])).orderBy("trial").collect()
    assert [(r.correct, r.argument_score, r.joint) for r in rows] == [(False, None, 0.0), (False, None, 0.0), (True, 0.5, 0.5), (True, 0.0, 0.0)]


def test_rate_of_nothing_and_of_wrong_selections(spark):
    assert trials.decomposed_rate(frame(spark, []).where("false")).first()[:] == (0, 0.0, None, 0.0)
    assert trials.decomposed_rate(frame(spark, [("s", "a", "t", "x", 1.0)])).first()[:] == (1, 0.0, None, 0.0)


def test_unmatched_tasks_are_listed(spark):
    p = trials.paired(frame(spark, [("s", "before", "a", "a", 1.0), ("s", "after", "b", "b", 1.0), ("s", "before", "c", "c", 1.0), ("s", "after", "c", "c", 0.5)]))
    assert {tuple(r) for r in trials.unmatched(p).collect()} == {("s", "a", "before"), ("s", "b", "after")}
    assert [(r.task, r.delta) for r in trials.matched(p).collect()] == [("c", -0.5)]


def test_constant_before_means_are_not_adjusted(spark):
    rows = [("s", arm, f"t{k}", f"t{k}", 1.0 if arm == "before" else k / 4) for k in range(4) for arm in ("before", "after")]
    out = trials.cuped(trials.matched(trials.paired(frame(spark, rows)))).collect()
    assert all(r.theta == 0 and r.reduction_pct == 0 and r.adjusted == r.delta for r in out)


def test_one_matched_task_gives_no_diff(spark):
    assert compare.server_diff(frame(spark, [("s", "before", "a", "a", 1.0), ("s", "after", "a", "a", 1.0)]), resamples=20).count() == 0


@pytest.mark.parametrize("n", [29, 30])
def test_interval_switches_at_thirty_tasks(spark, n):
    """Against a sequential model of both intervals."""
    r = random.Random(n)
    values = {f"t{k:02d}": (r.random(), r.random()) for k in range(n)}
    rows = [("s", arm, t, t, v[i]) for t, v in values.items() for i, arm in enumerate(("before", "after"))]
    got = compare.server_diff(frame(spark, rows), use_cuped=False, resamples=200).first()
    xs = [values[t][1] - values[t][0] for t in sorted(values)]
    draws = iter(sequential(42, 200 * n))
    means = sorted(sum(xs[min(int(next(draws) * n), n - 1)] for _ in range(n)) / n for _ in range(200))
    point = sum(xs) / n
    if n < 30:
        bar = sum(means) / 200
        se = (sum((m - bar) ** 2 for m in means) / 199) ** 0.5
        expect = (point - resample.T_975[n - 2] * se, point + resample.T_975[n - 2] * se)
    else:
        expect = (means[5], means[194])
    assert got.few_clusters == (n < 30)
    assert (got.delta, got.ci_lo, got.ci_hi) == pytest.approx((point, *expect))


@pytest.mark.parametrize(
    ("lo", "hi", "expected"),
    [(-0.3, -0.1, "insufficient_sensitivity"), (-0.1, -0.06, "regression"), (0.06, 0.1, "improvement"), (-0.05, 0.05, "no_change"), (-0.09, -0.05, "no_change")],
)
def test_verdict_judges_the_width_first(spark, lo, hi, expected):
    assert spark.range(1).select(compare.verdict(F.lit(lo), F.lit(hi), 0.05)).first()[0] == expected


@pytest.mark.parametrize("partitions", [1, 2, 8])
def test_same_result_on_any_partitioning(spark, partitions):
    rows = [("s", arm, f"t{k}", f"t{k}" if k % 3 else "x", (k * 7 % 10) / 10) for k in range(40) for arm in ("before", "after")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = compare.server_diff(frame(spark, rows).repartition(partitions), resamples=100).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got.n_tasks, got.delta, got.verdict) == (40, 0.0, "no_change")


def test_bounds():
    assert [resample.bounds(r) for r in (2000, 500, 300, 200)] == [(50, 1949), (12, 486), (7, 291), (5, 194)]


@pytest.mark.parametrize(("b", "c", "statistic", "verdict"), [(0, 0, 0.0, "too_few"), (6, 3, 3.0, "too_few"), (20, 4, 9.375, "a_better"), (7, 8, 0.0, "no_difference")])
def test_mcnemar(spark, b, c, statistic, verdict):
    rows = [(True, False)] * b + [(False, True)] * c + [(True, True)]
    got = paired.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean"), "a", "b").first()
    assert (got.b, got.c, got.statistic, got.verdict) == (b, c, statistic, verdict)


def test_sign_test(spark):
    p = lambda xs: paired.sign_test(spark.createDataFrame([(float(x),) for x in xs], "d double"), "d").first()[:]
    assert p([0, 0]) == (0, 0, 1.0)
    assert p([1] * 5) == (5, 0, 0.0625)
    assert p([1] * 3 + [-1] * 3 + [0]) == (3, 3, 1.0)
    assert p([1] * 3000 + [-1] * 2900)[2] == pytest.approx(0.1975, abs=2e-3)


def test_recovery_without_headroom(spark):
    assert spark.range(1).select(paired.recovery(F.lit(0.5), F.lit(0.4), F.lit(0.4))).first()[0] is None


def test_regime_gate_at_the_ceiling(spark):
    rows = [("f", f"t{k}", "a", True, k < 17) for k in range(20)] + [("f", f"t{k}", "b", True, True) for k in range(20)]
    got = paired.regime(spark.createDataFrame(rows, "family string, task string, arm string, valid boolean, correct boolean")).first()
    assert got.a_accuracy == pytest.approx(0.85) and got.aborted and not got.in_regime


def test_the_stream_does_not_wrap(spark):
    """Draws beyond 2^22 and 2^26, and positions beyond the period."""
    s, at, want = 42 & rng.MASK, 0, {}
    for k in (5, (1 << 22) + 5, (1 << 22) + 70_001):
        while at < k:
            s, at = (rng.MULTIPLIER * s + rng.INCREMENT) & rng.MASK, at + 1
        want[k] = s
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in want], "k long").select("k", rng.state(F.col("k")).alias("s")).collect()}
    assert got == want and len(set(want.values())) == 3
    far = spark.createDataFrame([(7,), (7 + (1 << 31),), (7 + (1 << 26),)], "k long").select(rng.state(F.col("k")).alias("s")).collect()
    assert far[0].s == far[1].s != far[2].s


def test_bisection_confirms_the_last_item(spark):
    rows = [("one", f"t{k}", k, 0.3 if k == 4 else 0.0) for k in range(7)] + [("none", f"t{k}", k, 0.01) for k in range(5)] + [("two", f"t{k}", k, 0.2 if k in (1, 5) else -0.01) for k in range(6)]
    items = spark.createDataFrame(rows, "case_id string, item string, pos long, effect double")
    effect = items.select("case_id", "item", "effect")
    assert {tuple(r) for r in attribution.bisection(items.drop("effect"), effect, 0.05, 3).select("case_id", "item").collect()} == {("one", "t4"), ("two", "t1")}
    found = attribution.greedy_bisection(items.drop("effect"), effect, 0.05, 3)
    assert {(r.case_id, r.found, r.item) for r in found.collect()} == {("one", 1, "t4"), ("two", 1, "t1"), ("two", 2, "t5")}
    assert attribution.bisection(items.drop("effect"), effect, 0.05, 3, margin=0.2).select("item").collect() == [("t4",)]


def test_correlation_states(spark):
    df = spark.createDataFrame([(k, float(k), 1.0, None if k > 1 else 2.0, float(k * k)) for k in range(6)], "k int, a double, flat double, few double, y double")
    got = {r.field: (r.status, r.spearman) for r in ranks.correlation_table(df, "k", "y", ["a", "flat", "few"]).collect()}
    assert got == {"a": ("ok", 1.0), "flat": ("degenerate", None), "few": ("insufficient_n", None)}


@pytest.mark.parametrize(("r", "n", "p"), [(0.417, 44, 0.0048), (0.371, 44, 0.0132), (0.0, 10, 1.0), (1.0, 5, 0.0), (0.5, 2, 1.0)])
def test_p_of_a_correlation(r, n, p):
    assert ranks.two_tailed(r, n) == pytest.approx(p, abs=1e-4)
