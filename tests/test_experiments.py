"""Whole experiments on runs with known outcomes."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import experiments as ex

RUN = "key string, task string, trial int, arm string, correct boolean"


def runs(spark, spec):
    """``spec``: (key, task, arm) to the outcomes of its trials."""
    return spark.createDataFrame([(k, t, n, a, ok) for (k, t, a), outcomes in spec.items() for n, ok in enumerate(outcomes)], RUN)


def by_key(df):
    return {r.key: r for r in df.collect()}


def test_gate_sign_test_and_verdict(spark):
    spec = {}
    for k in range(8):
        spec |= {("up", f"t{k}", "a"): [False, False], ("up", f"t{k}", "b"): [True, False]}  # every task better: p = 0.0078
        spec |= {("easy", f"t{k}", "a"): [True, False], ("easy", f"t{k}", "b"): [True, True]}  # first runs all right: no headroom
        spec |= {("bit", f"t{k}", "a"): [False], ("bit", f"t{k}", "b"): [k == 0]}
        spec |= {("down", f"t{k}", "a"): [k != 0], ("down", f"t{k}", "b"): [None]}
    spec |= {("up", "lone", "a"): [False]}
    got = by_key(ex.gated_arms(runs(spark, spec).withColumnRenamed("key", "key"), "key", ceiling=0.9))
    up = got["up"]
    assert (up.headroom, up.n_tasks, up.wins, up.losses, up.ties, up.p, up.verdict) == (True, 8, 8, 0, 0, 0.0078, "positive")
    assert (up.rate_a, up.rate_b, up.effect_pp) == (0.0, 0.5, 50.0)
    assert (got["easy"].step1_rate, got["easy"].headroom, got["easy"].verdict, got["easy"].rate_a, got["easy"].p) == (1.0, False, "no headroom", None, None)
    assert (got["bit"].verdict, got["bit"].p, got["bit"].ties) == ("directional", 1.0, 7)
    assert (got["down"].verdict, got["down"].losses) == ("null", 7)
    assert ex.gated_arms(runs(spark, spec).where("false"), "key").count() == 0


def test_screen_keeps_stable_tasks(spark):
    spec = {}
    for k in range(4):
        spec |= {("s", f"t{k}", "s1"): [True, True, True], ("s", f"t{k}", "s2"): [True, True, k != 3 and True], ("s", f"t{k}", "a"): [False], ("s", f"t{k}", "b"): [True]}
    spec |= {("s", "odd", "s1"): [True] * 3, ("s", "odd", "s2"): [False] * 3, ("s", "odd", "a"): [True], ("s", "odd", "b"): [False], ("s", "half", "s1"): [True]}
    (r,) = ex.screened_arms(runs(spark, spec), "key", least=4).collect()
    assert (r.n_screened, r.n_stable, r.mean_a, r.mean_b, r.wins, r.losses, r.p, r.verdict) == (6, 4, 0.0, 1.0, 4, 0, 0.125, "directional")
    (few,) = ex.screened_arms(runs(spark, spec), "key").collect()
    assert (few.verdict, few.n_stable, few.mean_a) == ("too few tasks", 4, None)


def test_contested_matrix(spark):
    rows = []
    for key, right_a in (("open", 0), ("full", 2)):
        for task, family in (("t1", "f1"), ("t2", "f2"), ("control", "f1")):
            for arm, n in (("a", 2 if task == "control" else right_a), ("fixed", 1), ("oracle", 2)):
                rows += [(key, task, k, arm, k < n, family) for k in range(2)]
    r = spark.createDataFrame(rows, RUN + ", family string")
    contested = spark.createDataFrame([(k, t) for k in ("open", "full") for t in ("t1", "t2")], "key string, task string")
    got = {(x.key, x.family): (x.n_tasks, x.a, x.fixed, x.oracle, x.recovery) for x in ex.contested_matrix(r, "key", "family", contested).collect()}
    assert got == {("open", None): (2, 0.0, 0.5, 1.0, 0.5), ("open", "f1"): (1, 0.0, 0.5, 1.0, 0.5), ("open", "f2"): (1, 0.0, 0.5, 1.0, 0.5), ("full", None): (2, 1.0, None, None, None)}


def test_tasks_of_two_fixtures_are_two(spark):
    rows = [(fixture, v, "create", "x", "x", 1.0 if v == "fixed" else 0.0) for fixture in ("github", "jira") for v in ("bad", "fixed") for _ in range(3)]
    rows += [("jira", "bad", "lone", "x", "x", 1.0), ("jira", "other", "create", "x", "x", 1.0), ("github", "bad", "create", "x", "create", 1.0)]
    d = spark.createDataFrame([("m", *r) for r in rows], "model string, fixture string, variant string, task string, tool string, selected string, cs double")
    (r,) = ex.pooled_by_model(d, resamples=200).collect()
    assert (r.model, r.n_tasks, r.n_unmatched, r.delta, r.verdict, r.after_rate) == ("m", 2, 1, 1.0, "improvement", 1.0)
    assert r.before_rate == pytest.approx(1 / 8)


@pytest.mark.parametrize(
    ("text", "hit"),
    [("Unlike find_all, this", True), ("COMPARED TO  Find_all it", True), ("whereas others", False), ("while a.b runs", True), ("while axb runs", False), ("finds like find_all", False), ("unlikefind_all", False), (None, False)],
)
def test_comparative_claims(spark, text, hit):
    d = spark.createDataFrame([(text, ["find_all", "a.b"])], "t string, n array<string>")
    assert d.select(ex.claims_against(F.col("t"), F.col("n"))).first()[0] is hit
    assert d.select(ex.claims_against(F.col("t"), F.array().cast("array<string>"))).first()[0] is False


def test_families_and_bands(spark):
    ex.other_family("gemma2:9b", "llama3.1", "qwen3")
    with pytest.raises(ValueError, match="llama3.1"):
        ex.other_family("Llama3.1:8b", "llama3.1", "qwen3")
    d = spark.createDataFrame([(75.0,), (74.9,), (50.0,), (49.9,)], "s double")
    assert [r[0] for r in d.select(ex.bands(F.col("s"))).collect()] == ["good", "fair", "fair", "poor"]
    log = spark.createDataFrame([(0.5, None), (1.0, None), (0.0, "x"), (None, None)], "task_success_rate double, error string")
    assert tuple(ex.baseline_rate(log).first()) == (3, 0.75)
