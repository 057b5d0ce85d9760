"""Axes, guards and the whole audit on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import audit, axes, constraints, linting, probes, ranks

ANSWER = "server string, tool string, label string, answer string"


def answers(spark, *texts, server="s"):
    return spark.createDataFrame([(server, f"t{k % 2}", "l", t) for k, t in enumerate(texts)], ANSWER)


@pytest.mark.parametrize(
    ("text", "first", "told"),
    [
        ("8", 8.0, 8.0), ("I'd say 7.5/10", 7.5, 10.0), ("12", 10.0, 10.0), ("x9", None, None), ("none", None, None), ("", None, None), (None, None, None),
        ("CLARITY: 8\nDISTINGUISH: 4", 8.0, 4.0), ("distinguish 3.5, clarity 9", 3.5, 3.5), ("first 2 then 6", 2.0, 6.0), ("DISTINGUISH: 40", 10.0, 10.0),
    ],
)
def test_grades(spark, text, first, told):
    row = spark.createDataFrame([(text,)], "a string").select(axes.grade(F.col("a")), axes.distinguish_grade(F.col("a"))).first()
    assert tuple(row) == (first, told)


def test_judged_axes(spark):
    a = answers(spark, "8", "6", "no", "7").unionByName(answers(spark, "no", server="mute"))
    servers = spark.createDataFrame([("s", True), ("mute", True), ("unfetched", None)], "server string, fetched boolean")
    of = lambda df: {r[0]: tuple(r)[1:] for r in df.collect()}
    assert of(axes.description_quality(a)) == {"s": (70.0,), "mute": (0.0,)}
    assert of(axes.error_legibility(a)) == {"s": (72.5, 0.125), "mute": (0.0, 0.0)}  # cases: 8; 6 and 7
    assert of(axes.docs_manifest(servers, a)) == {"s": (76.0,), "mute": (20.0,), "unfetched": (20.0,)}
    judged = axes.judged_discoverability(servers, a)
    assert of(judged) == {"s": (70.0,), "mute": (50.0,), "unfetched": (50.0,)}
    heuristic = spark.createDataFrame([("s", 100.0), ("mute", 0.0)], "server string, score double")
    assert of(axes.discoverability(heuristic, judged)) == {"s": (88.0,), "mute": (20.0,)}
    calls = spark.createDataFrame([("s", False), ("s", False), ("s", True), ("s", None)], "server string, success boolean")
    assert of(axes.robustness(calls)) == {"s": (2, 1, 1, 50.0)}
    assert axes.robustness(calls.where("false")).count() == 0
    with pytest.raises(ValueError, match="no such axis"):
        axes.together(charm=heuristic)


def test_overall_of_an_exact_half(spark):
    """The weighted sum is 48.45, which doubles miss by a hair."""
    scores = dict(zip(linting.WEIGHTS, (98.3, 34.3, 47.2, 19.2, 7.4, 59.3, 47.5, 10.5)))
    # Whatever the order of the sum; in this one it is 48.449999999999996.
    rows = spark.createDataFrame([("s", d, x) for d, x in scores.items()], "server string, dim string, score double").coalesce(1)
    assert [tuple(r) for r in linting.overall(rows).collect()] == [("s", 48.5)]


def test_flagged_cases(spark):
    schema = "name string, tier string, task_success_rate double, baseline_desc_length double, baseline_single_prompt double, axis double"
    rows = [
        ("caught", "t", 0.2, 100.0, 60.0, 30.0), ("wider", "t", 0.5, 200.0, None, 10.0), ("fine", "t", 0.9, 200.0, 90.0, 10.0), ("rated well", "t", 0.1, 0.0, 20.0, 80.0),
        ("no axis", "t", 0.1, 0.0, 20.0, None), ("no rate", "t", None, 0.0, 20.0, 1.0), ("no length", "t", 0.1, None, None, 0.0),
    ]
    got = axes.flagged_cases(spark.createDataFrame(rows, schema), "axis").collect()
    assert [(r.name, r.gap, r.baseline_desc_length_rescaled) for r in got] == [("wider", 90.0, 100.0), ("caught", 30.0, 50.0)]
    assert axes.flagged_cases(spark.createDataFrame(rows, schema), "axis", most=1).count() == 1


def test_corrected_scores(spark):
    con = "struct<param:string,kind:string,gold:string,pattern:string,lo:long,hi:long,tolerance:double>"
    one = [("mode", "enum", "x", None, None, None, None)]
    rows = [(1, False, "t", True, {"mode_v2": "x"}), (2, False, "t", True, {"mode": "x"}), (3, True, "t", True, {"mode_v2": "x"}), (4, False, "u", True, {"mode_v2": "x"}), (5, False, "t", False, {"mode_v2": "x"}), (6, None, "t", True, {"mode_v2": "x"}), (7, False, None, True, {})]
    calls = spark.createDataFrame([(k, p, s, "t", ok, a, one) for k, p, s, ok, a in rows], f"id int, parse_failed boolean, selected string, target string, success boolean, args map<string,string>, constraints array<{con}>")
    names = spark.createDataFrame([("mode", "mode_v2")], "old string, new string")
    assert {r.id: r.score for r in constraints.corrected(calls, names, "id").collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}


def test_several_culprits_guard(spark):
    rows = [("a", 0, 9, True), ("a", 1, 5, True), ("a", 2, 7, False), ("a", 3, 5, False), ("b", 0, 1, True), ("c", 0, 4, False), ("c", 1, 4, True)]
    (r,) = ranks.several_culprits_guard(spark.createDataFrame(rows, "case_id string, pos int, size int, truth boolean")).collect()
    assert (r.n_cases, r.n_true, r.n_positions) == (3, 4, 2)
    assert r.true_is_largest == pytest.approx(2 / 3)  # of c the decoy comes first
    assert r.decoy_over_least_true == pytest.approx(1 / 3)
    assert r.mean_fractional_rank == pytest.approx((0 + 0.75 + 0.5) / 3)


def test_listing_lines(spark):
    schema = "tool string, description string, props array<struct<name:string,type:string>>"
    rows = [("a", "first\nsecond", [("p", "string"), ("q", None)]), ("b", None, []), ("c", "", [("z", "")])]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(probes.listing_line()).collect()]
    assert got == ["a — first | p:string, q", "b — (no description) | (no params)", "c — (no description) | z"]


def test_the_audit_checks_what_it_is_given(spark):
    tasks = spark.createDataFrame([("find", "use Find now"), ("make", " ")], "tool string, text string")
    cons = spark.createDataFrame([("find", "mode", "enum", "x"), ("find", "mode", "enum", "w"), ("find", "lost", "format", None), ("gone", "p", "enum", "y")], "tool string, param string, kind string, gold string")
    catalog = lambda rows: spark.createDataFrame(rows, "tool string, description string, params array<struct<name:string,has_choices:boolean>>")
    before, after = catalog([("find", "d", [("mode", False)]), ("make", "d", []), ("other", None, [])]), catalog([("find", "d", [("mode", True), ("lost", None)])])
    got = {(r.check, r.severity, r.subject, r.detail, r.variant) for r in audit.measured(tasks=tasks, constraints=cons, before=before, after=after).collect()}
    assert got == {
        ("leaked_name", "block", "find", "find", None), ("blank_text", "block", "make", "", None), ("missing_param", "block", "find", "lost", "before"), ("unlisted_value", "warn", "find/mode", "w", "before"),
        ("no_params", "warn", "make", "", "before"), ("catalog_size", "warn", "catalog", "3/1", None),
    }
    trials = spark.createDataFrame([("t", 1.0), ("t", 1.0)], "task string, joint double")
    assert {(r.check, r.variant) for r in audit.measured(before_trials=trials).collect()} == {("extreme_rate", "before"), ("no_variance", "before")}
    with pytest.raises(ValueError):
        audit.measured()
