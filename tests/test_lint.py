"""Constraints, consistency checks, planted defects, recorded runs and the log stream."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import attribution, audit, constraints, linting
from spindrift.sources import records
from spindrift.streaming import logs

CONSTRAINT = "struct<param:string,kind:string,gold:string,pattern:string,lo:long,hi:long,tolerance:double>"


@pytest.mark.parametrize(
    ("value", "c", "ok"),
    [
        ("a", {"kind": "enum", "gold": "a"}, True),
        ("A", {"kind": "enum", "gold": "a"}, False),
        (None, {"kind": "enum", "gold": "a"}, False),
        ("2024-01-02", {"kind": "format", "pattern": r"\d{4}-\d\d-\d\d"}, True),
        ("x2024-01-02", {"kind": "format", "pattern": r"\d{4}-\d\d-\d\d"}, False),
        ("5", {"kind": "range", "lo": 5, "hi": 6}, True),
        ("five", {"kind": "range", "lo": 5, "hi": 6}, False),
        ("5", {"kind": "range", "lo": 5}, False),
        ("The CAT", {"kind": "contains", "gold": "cat"}, True),
        ("cat", {"kind": "contains"}, False),
        ("1.0000001", {"kind": "numeric_equals", "gold": "1"}, True),
        ("1.1", {"kind": "numeric_equals", "gold": "1"}, False),
        ("1.1", {"kind": "numeric_equals", "gold": "1", "tolerance": 0.2}, True),
        ("x", {"kind": "numeric_equals", "gold": "1"}, False),
    ],
)
def test_constraint(spark, value, c, ok):
    row = spark.createDataFrame([(value, json.dumps(c))], "v string, c string").select("v", F.from_json("c", CONSTRAINT).alias("c"))
    assert row.select(constraints.holds(F.col("v"), F.col("c"))).first()[0] is ok


def test_unknown_kind_is_an_error(spark):
    row = spark.createDataFrame([("v", '{"kind": "odd"}')], "v string, c string").select("v", F.from_json("c", CONSTRAINT).alias("c"))
    with pytest.raises(Exception, match="unknown kind"):
        row.select(constraints.holds(F.col("v"), F.col("c"))).collect()


def test_no_constraints_and_missing_arguments(spark):
    calls = spark.createDataFrame([(1, {"a": "x"}, None), (2, {"a": "x"}, []), (3, {}, [("a", "enum", "x", None, None, None, None)])], f"id int, args map<string,string>, constraints array<{CONSTRAINT}>")
    assert {r.id: (r.share, r.all_hold) for r in constraints.satisfaction(calls, "id").collect()} == {1: (1.0, True), 2: (1.0, True), 3: (0.0, False)}


TOOLS = "server string, tool string, description string, props array<struct<name:string,type:string,described:boolean,has_default:boolean,choices:array<string>>>, required array<string>"


def tool(name, description, props=(), required=()):
    return ("s", name, description, [(p, t, True, False, []) if isinstance(t, str) else (p, "string", True, False, t) for p, t in props], list(required))


def found(spark, *tools):
    return {(r.tool, r.check, r.detail) for r in linting.lint(spark.createDataFrame(list(tools), TOOLS)).collect()}


@pytest.mark.parametrize(
    "text",
    ["There is no risk for user.", "Uses user.\nReturns:\n  user_record", "Uses user.\nExamples: a_b", "Takes user and returns a status_code.", "Not the internal `account_id`, but user.", "user one of: a_b, c_d, e_f", "user (e.g., a_b)", "Takes user after other_tool.", "user: who (past_hour, past_day)", "Not for `a_b`, user.", "User: MRR_rate."],
)
def test_silent_descriptions(spark, text):
    assert found(spark, tool("find", text, [("user", "string")], ["user"]), tool("other_tool", "Makes x.", [("x", "string")])) == set()


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("Set count to true.", False), ("Set count. Other is true or false.", False), ("Enable the flag of count.", False), ("count: yes/no", True),
        ("A boolean count.", True), ("If true, the count is kept as it was; false drops it.", False), ("True for count, else false.", True), ("Set mode to yes or no! Uses count.", False),
    ],
)
def test_yes_and_no_in_the_sentence_of_the_parameter(spark, text, hit):
    assert (("find", "boolean_language", "count") in found(spark, tool("find", text, [("count", "integer")]))) == hit


def test_findings(spark):
    got = found(
        spark,
        tool("find", "Takes `account_id`. Set count to true or false.", [("count", "integer"), ("mode", ["a", "b"])], ["ghost"]),
        tool("finds", "Uses mode 'c'.", [("mode", ["a", "b"])]),
    )
    assert got == {
        ("find", "undeclared_mention", "account_id"),
        ("find", "boolean_language", "count"),
        ("find", "undeclared_required", "ghost"),
        ("find", "unmentioned_required", "ghost"),
        ("finds", "foreign_value", "mode=c"),
        ("find", "name_collision", "finds"),
    }


@pytest.mark.parametrize(
    ("text", "prop", "word"),
    [
        ("Pages the qury.", "query", None), ("The querys text.", "query", None), ("Takes customerId here.", "customer_id_v2", "customerId"), ("The customer to find.", "customer_id", None),
        ("Sets the limits.", "limitss", "limits"), ("Sets lim.", "limit", None), ("The names.", "name", None), ("The page.", "name", None), ("Uses modes and mode_s.", "modesx", "mode_s"), ("Sets limit_v.", "limit_v2", "limit_v"),
    ],
)
def test_parameters_that_may_have_been_renamed(spark, text, prop, word):
    got = {(c, d) for _, c, d in found(spark, tool("find", text, [(prop, "string")])) if c == "possibly_renamed"}
    assert got == ({("possibly_renamed", f"{prop}={word}")} if word else set())


def test_severities(spark):
    df = spark.createDataFrame([tool("find", "Takes `account_id`. Set count to true or false. Limits.", [("count", "integer"), ("limitss", "string")], ["ghost"])], TOOLS)
    assert {r.check: r.severity for r in linting.lint(df).collect()} == {"undeclared_mention": "advisory", "boolean_language": "blocking", "undeclared_required": "info", "unmentioned_required": "info", "possibly_renamed": "advisory"}


def test_rates_leave_information_out(spark):
    quiet, loud, blank = tool("find", "Nothing.", (), ["ghost"]), tool("make", "Takes `account_id`."), tool("name", "Text.")
    rows = [quiet, loud, blank, ("other", *quiet[1:])]
    (got,) = linting.finding_rates(spark.createDataFrame(rows, TOOLS)).collect()
    assert got.asDict() == {"n_tool_sets": 2, "n_tools": 4, "n_flagged_tools": 1, "pct_flagged_tools": 25.0, "n_flagged_sets": 1, "pct_flagged_sets": 50.0}


def test_new_findings_rank_the_tool_that_got_worse(spark):
    before = [tool("set_flag", "Set the mode.", [("mode", "string")]), tool("get_flag", "Get the mode.", [("mode", "string")])]
    after = [tool("set_flag", "Set the mode to true/false as needed.", [("mode", "integer")]), tool("get_flag", "Get the mode.", [("mode", "string")])]
    frame = lambda rows: spark.createDataFrame(rows, TOOLS)
    changed = spark.createDataFrame([("s", "get_flag", 0), ("s", "set_flag", 1)], "server string, tool string, pos int")
    got = linting.new_findings(frame(before), frame(after), changed).orderBy("rank").collect()
    assert [(r.tool, r.delta) for r in got] == [("set_flag", 1), ("get_flag", 0)]
    twice = [tool("set_flag", "Set the mode to 'x' or 'x'.", [("mode", ["a"])]), before[1]]
    assert [(r.tool, r.delta) for r in linting.new_findings(frame(twice), frame(before), changed).orderBy("rank").collect()] == [("get_flag", 0), ("set_flag", -2)]


def test_renamed_recall_by_shape(spark):
    rows = [tool("a", "Uses `user_name`.", [("user_name", "string")]), tool("b", "Uses limit.", [("limit", "string")]), tool("c", "No name.", [("zzz", "string")])]
    got = {r["shape"]: tuple(r)[1:] for r in linting.renamed_recall(spark.createDataFrame(rows, TOOLS)).collect()}
    assert got == {"several words": (1, 1, 1, 1, 1), "one word": (1, 0, 1, 1, 0)}


@pytest.mark.parametrize(("defect", "check"), [("renamed", "unmentioned_required"), ("flipped", "boolean_language"), ("foreign", "foreign_value"), ("ghost", "undeclared_required"), ("forgotten", "unmentioned_required")])
def test_planted_defects_are_found(spark, defect, check):
    clean = spark.createDataFrame([tool("find", "Looks up user.", [("user", "string")], ["user"])], TOOLS)
    assert linting.lint(clean).count() == 0
    assert check in {r.check for r in linting.lint(linting.DEFECTS[defect](clean)).collect()}


def test_scores_without_parameters(spark):
    df = spark.createDataFrame([tool("x", None)], TOOLS)
    assert linting.schema_completeness(df).first()[:] == ("s", 0.0)


def test_audit_of_nothing_passes(spark):
    none = spark.createDataFrame([], "check string, severity string, subject string, detail string")
    assert audit.passed(none).first()[:] == (True, 0, 0)


def test_replay_file(spark, tmp_path):
    path = tmp_path / "replay.json"
    path.write_text(json.dumps([{"task_tool_name": "a", "selected_tool": "a", "constraint_satisfaction": 0.5}, {"task_tool_name": "b"}]))
    assert sorted(map(tuple, records.read_replay(spark, str(path)).collect()), key=str) == [("a", "a", 0.5), ("b", None, 0.0)]


def test_replay_miss_is_an_error(spark):
    tape = spark.createDataFrame([("k1", "yes")], "key string, response string")
    calls = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert [r.response for r in records.replayed(calls.where("key = 'k1'"), tape).collect()] == ["yes"]
    with pytest.raises(Exception, match="no recorded answer"):
        records.replayed(calls, tape).collect()


def test_log_stream_keeps_the_last_record(spark, tmp_path):
    log, target, checkpoint = (str(tmp_path / x) for x in ("log", "out", "check"))
    records_of = lambda rows: spark.read.schema(records.STUDY).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))

    def run(number, rows):
        logs.append_once(records_of(rows), log, number)
        logs.keep_latest(logs.read_log(spark, log), "name", "seq", target, checkpoint)
        return logs.current(spark, target, "name")

    run(0, [{"name": "a", "seq": 1, "tier": "x"}, {"name": "b", "seq": 2, "error": "boom"}])
    last = run(1, [{"name": "a", "seq": 3, "tier": "y"}])
    assert {(r.name, r.tier) for r in last.collect()} == {("a", "y"), ("b", None)}
    assert [r.name for r in records.finished(last).collect()] == ["a"]


def test_attribution_finds_the_planted_item(spark):
    items = spark.createDataFrame([(c, f"i{k}", k, 5) for c in range(3) for k in range(5)], "case_id int, item string, pos long, n long")
    effect = items.select("case_id", "item", F.when(F.col("pos") == F.col("case_id"), 0.5).otherwise(0.0).alias("effect"))
    assert {(r.case_id, r.item) for r in attribution.bisection(items, effect, 0.1).collect()} == {(c, f"i{c}") for c in range(3)}
    top = attribution.sampled_shapley(items, effect, 16).where("rank = 1").collect()
    assert {(r.case_id, r.item) for r in top} == {(c, f"i{c}") for c in range(3)}


@pytest.mark.parametrize(("n", "expected"), [(2, 1), (3, 2), (4, 2), (10, 5), (40, 20)])
def test_budget(spark, n, expected):
    assert spark.range(1).select(attribution.budget(F.lit(n))).first()[0] == expected


def test_benchmark_defects_and_decoys(spark):
    rows = [tool("a", "Text.", [("n", "integer"), ("mode", "string"), ("name", "string")]), tool("b", None, [("n", "integer")])]
    df = spark.createDataFrame(rows, TOOLS)
    assert [r.tool for r in linting.eligible_culprits(df).collect()] == ["a"]
    bad = {r.tool: r for r in linting.camouflaged_defect(df, " Note.").collect()}
    assert bad["a"].description == "Text. Set mode to true/false as needed. Note." and [p.type for p in bad["a"].props] == ["integer", "integer", "string"]
    assert bad["b"].description is None
    assert ("a", "boolean_language", "mode") in {(r.tool, r.check, r.detail) for r in linting.lint(linting.camouflaged_defect(df)).collect()}
    harmless = linting.decoy(df, "small")
    assert {r.tool: r.description for r in harmless.collect()} == {"a": "Text. This value is supplied by the caller. Note.", "b": " This value is supplied by the caller. Note."}


def test_first_hints(spark):
    rows = [("s", 1, k, "late", f"h{k}", None) for k in range(9)] + [("s", 0, 1, "first", "x", True), ("s", 0, 0, "off", "y", False), ("s", 0, 0, "first", "w", True)]
    got = linting.first_hints(spark.createDataFrame(rows, "server string, dim_at int, hint_at int, dim string, hint string, implemented boolean")).orderBy("place").collect()
    assert [(r.place, r.dim, r.hint) for r in got][:3] == [(1, "first", "w"), (2, "first", "x"), (3, "late", "h0")] and len(got) == 10


def test_fields_pools_and_corpora(spark, tmp_path):
    rows = [
        {"name": "a", "task_success_rate": 0.5, "dimension_scores": {"robustness": 70.0, "discoverability": None}, "run_results": [{"task_tool_name": "t", "selected_tool": "t", "constraint_satisfaction": 0.5}, {"task_tool_name": "t", "selected_tool": "u"}, {"task_tool_name": "u", "selected_tool": "u"}, {"task_tool_name": "t"}]},
        {"name": "b", "error": "boom", "run_results": [{"task_tool_name": "t", "selected_tool": "t", "constraint_satisfaction": 1.0}] * 5},
    ]
    (tmp_path / "log.json").write_text("\n".join(json.dumps(r) for r in rows))
    log = records.read_study(spark, str(tmp_path / "log.json"))
    got = log.orderBy("name").select(*[records.field(log, f).alias(f) for f in ("task_success_rate", "robustness", "discoverability", "overall_score", "other")]).collect()
    assert [tuple(r) for r in got] == [(0.5, 70.0, None, None, None), (None,) * 5]
    assert [tuple(r) for r in records.pools(log).collect()] == [("a", "t", 3)]
    assert [tuple(r) for r in records.pools_by_set(log).collect()] == [("a", 4, 0.125)]
    corpus = spark.createDataFrame([(2, "x", ["b", "a"]), (1, "x", ["a", "b"]), (3, "y", ["a", "b"]), (0, "x", ["a"]), (4, "z", ["a", "b"])], "position int, tier string, names array<string>")
    assert sorted(r.position for r in records.distinct_catalogs(corpus, 2).collect()) == [1, 3, 4]
    assert sorted(r.position for r in records.distinct_catalogs(corpus, tiers=["x"]).collect()) == [0, 1]


def test_description_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a": "text é", "b": 3}, indent=2))
    assert {tuple(r) for r in records.descriptions(spark, str(tmp_path / "d.json")).collect()} == {("a", "text é"), ("b", "3")}
    assert records.descriptions(spark, str(tmp_path / "none.json")).count() == 0
