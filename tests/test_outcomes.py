"""Outcome classes, rates, JSON answers, probes and intervals on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import outcomes, probes, resample

RUN = "server string, arm string, task string, trial long, gold string, selected string, success boolean"
PROPS = "array<struct<name:string,type:string,described:boolean,has_default:boolean,choices:array<string>>>"
TOOL = f"server string, tool string, description string, props {PROPS}, required array<string>"


def test_loose_and_strict_outcomes(spark):
    rows = [(" Add ", "correct", "abstained"), ("add, please", "abstained", "correct"), ("sub.", "abstained", "wrong"), ("sub", "wrong", "wrong"), ("other", "abstained", "abstained"), ("  ", "abstained", "abstained"), (None, "abstained", "abstained"), ("\n add", "correct", "correct")]
    df = spark.createDataFrame([(a, "add", *rest) for a, *rest in rows], "answer string, gold string, loose string, strict string")
    known = ("add", "sub")
    got = df.select("loose", "strict", outcomes.loose_outcome(F.col("answer"), F.col("gold"), known).alias("l"), outcomes.strict_outcome(F.col("answer"), F.col("gold"), known).alias("s")).collect()
    assert [(r["l"], r["s"]) for r in got] == [(r["loose"], r["strict"]) for r in got]


def test_percentages_round_halves_to_even_and_count_nulls_as_wrong(spark):
    rows = [("s", "a", "t", k, "x", "x" if k < 5 else None, k < 3) for k in range(16)]
    got = outcomes.percentages(spark.createDataFrame(rows, RUN), "server").first()
    assert (got["selection_accuracy"], got["call_correctness"]) == (31.2, 18.8)
    assert outcomes.percentages(spark.createDataFrame([], RUN), "server").count() == 0


def test_parse_failed_counts_null(spark):
    valid = spark.createDataFrame([("x",), ("x",)], "selected string")
    rows = [("s", "a", "t", k, "x", v, True) for k, v in enumerate(["x", None, "y", "x"])]
    assert outcomes.parse_failed(spark.createDataFrame(rows, RUN), valid, "server").first()["parse_failed"] == 2


def test_paired_arms(spark):
    rows = []
    for arm, right in (("a", 12), ("b", 2), ("a_noise", 13)):
        rows += [("s", arm, f"t{k % 4}", k, "x", "x" if k < right else "y", True) for k in range(20)]
    rows += [("lone", "a", "t", 0, "x", "x", True)]
    got = {r.server: r for r in outcomes.paired_arms(spark.createDataFrame(rows, RUN)).collect()}
    s = got["s"]
    assert (s.selection_delta, s.selection_floor, s.correctness_delta, s.problem) == (-50.0, 5.0, 0.0, None)
    assert (s.selection_b, s.selection_c, s.selection_statistic, s.selection_verdict) == (10, 0, 8.1, "a_better")
    assert (s.correctness_b, s.correctness_c, s.correctness_statistic, s.correctness_verdict) == (0, 0, 0.0, "too_few")
    assert got["lone"].problem == "arm missing" and got["lone"].selection_delta is None
    with pytest.raises(Exception, match="lone: arm missing"):
        outcomes.paired_arms(spark.createDataFrame(rows, RUN), strict=True).collect()
    uneven = [("c", arm, "t", k, "x", "x", True) for arm, n in (("a", 2), ("b", 2), ("a_noise", 1)) for k in range(n)]
    names = [("n", arm, "t", 0, "y" if arm == "b" else "x", "x", True) for arm in ("a", "b", "a_noise")]
    assert {r.server: r.problem for r in outcomes.paired_arms(spark.createDataFrame(uneven + names, RUN)).collect()} == {"c": "counts differ", "n": "names differ"}


def test_effect_errors(spark):
    good = dict(arm_a_accuracy=0.5, arm_b_accuracy=0.7, effect_pp=20.0, n_contested=8, n_plus=3, n_minus=1, n_ties=4, n_stable=8, aborted=False, headroom_gated=True)
    bad = {**good, "arm_a_accuracy": -0.1, "arm_b_accuracy": 1.1, "n_contested": 5, "n_stable": 9, "headroom_gated": False}
    got = outcomes.effect_errors(spark.createDataFrame([good, bad])).select("errors").collect()
    assert got[0]["errors"] == []
    assert got[1]["errors"] == ["few_contested", "no_headroom_not_aborted", "effect_mismatch", "counts_mismatch", "arm_a_outside", "arm_b_outside"]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('``` \n{"a": 1}```', '{"a": 1}'),
        ('Sure! Here: {"a": {"b": 2}} so.', '{"a": {"b": 2}}'),
        ('[{"a": 1}]', '{"a": 1}'),
        ("[1, 2]", None),
        ('{"a": 1} and {"b": 2}', None),
        ('{"a": ', None),
        ("", None),
        (None, None),
    ],
)
def test_json_object(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(outcomes.json_object(F.col("t")).alias("o")).first()["o"] == want


def test_probes_and_samples(spark):
    tool = ("s", "add", "", [("a", "integer", True, False, []), ("b", "", True, True, ["u", "v"]), ("c", "thing", True, False, [])], ["a", "b"])
    bare = ("s", "none", None, [], [])
    df = spark.createDataFrame([tool, bare], TOOL)
    made = {r["tool"]: (r["task"], r["args"]) for r in probes.tasks(df).collect()}
    assert made == {"add": ("Call the 'add' tool.", ["a=0", 'b="u"', "c=null"]), "none": ("Call the 'none' tool.", [])}
    errors = {(r["tool"], r["label"]): r["args"] for r in probes.error_probes(df).collect()}
    assert errors == {("add", "missing_required"): "{}", ("add", "wrong_type_a"): '{"a": "not_a_number"}', ("none", "unknown_param"): '{"__bad_field__": true}'}
    robust = {(r["tool"], r["label"]): r["args"] for r in probes.robustness_probes(df).collect()}
    assert robust[("add", "null_value")] == '{"a": null}' and robust[("none", "null_value")] == '{"__null__": null}' and robust[("none", "all_nulls")] == '{"__all_nulls__": null}'
    assert len(robust) == 6
    odd = df.where("tool = 'add'").withColumn("required", F.array(F.lit("c")))  # a type that is none
    assert {r["label"]: r["args"] for r in probes.error_probes(odd).collect()}["wrong_type_c"] == '{"c": null}'
    assert {r["label"]: r["args"] for r in probes.robustness_probes(odd).collect()}["wrong_type_c"] == '{"c": 99999}'
    kept = df.where("tool = 'add'").select(probes.guarded_required(F.col("required"), F.col("props")).alias("g")).first()["g"]
    assert kept == ["a"]


def test_grounding_and_types(spark):
    names = {"get_a": 0, "del_b": 0, "set_data": 0, "transform_scale": 1, "compute_median": 1, "search_products": 2, "getUserName": 2, "": 0}
    df = spark.createDataFrame([(n, k) for n, k in names.items()], "name string, n int")
    assert df.where(probes.grounding_tokens(F.col("name")) != F.col("n")).count() == 0
    kinds = spark.createDataFrame([("list[int]", "array"), ("dict", "object"), ("Optional[str]", "string"), (" bool ", "boolean")], "a string, t string")
    assert kinds.where(probes.json_type(F.col("a")) != F.col("t")).count() == 0


def test_spearman_interval_skips_constant_replicates(spark):
    df = spark.createDataFrame([("k", i, float(i), float(i)) for i in range(3)] + [("k", 9, None, 1.0), ("one", 0, 1.0, 1.0)], "key string, i long, x double, y double")
    got = {r["key"]: r for r in resample.spearman_interval(df, "key", "i", 200).collect()}
    assert got["k"]["ci_lo"] == got["k"]["ci_hi"] == 1.0 and got["k"]["skipped"] > 0
    assert got["one"]["ci_lo"] is None and got["one"]["skipped"] == 200
