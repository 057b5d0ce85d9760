"""Nested files, keys, tapes, trees, reports and the streaming log, against Python's own JSON and plain loops."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import gates, json_text, trees, versions
from spindrift.sources import nested, reports
from spindrift.sources.shared import Steps
from spindrift.streaming import logs

ODD = ['a"b', "back\\slash", "\\u001B is text", "\x1b\x00\x7f", "é 😀  ", "\t\n\r\b\f/", "", "日本"]


def texts(spark, values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, t string")


def test_quoted_and_ascii_like_python(spark):
    d = texts(spark, ODD).select("k", json_text.quoted(F.col("t")).alias("q"), json_text.ascii_only(json_text.quoted(F.col("t"))).alias("a"))
    got = {r.k: (r.q, r.a) for r in d.collect()}
    assert got == {k: (json.dumps(t, ensure_ascii=False), json.dumps(t)) for k, t in enumerate(ODD)}
    assert texts(spark, [None]).select(json_text.quoted(F.col("t"))).first()[0] == "null"


def test_call_key_is_the_documented_formula(spark):
    def key(provider, model, seed, messages):
        payload = {"provider_name": provider, "model": model, "seed": seed, "messages": [{"role": r, "content": c} for r, c in messages]}
        return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()[:16]

    calls = [("ollama", "llama3.2", 42, [("user", "hello")]), ("a", "m é", 7, [("user", t) for t in ODD]), ("a", "m", -1, [])]
    d = spark.createDataFrame([(k, p, m, s, [{"role": r, "content": c} for r, c in ms]) for k, (p, m, s, ms) in enumerate(calls)], "k long, p string, m string, s long, ms array<struct<role:string,content:string>>")
    got = [r[0] for r in d.orderBy("k").select(json_text.call_key(F.col("p"), F.col("m"), F.col("s"), F.col("ms"))).collect()]
    assert got == [key(*c) for c in calls]


def test_canonical_is_one_for_all_spellings(spark):
    value = {"b": [1, None, {"z": "é", "a": [True, {}]}], "A": {"k": {"y": 2.5, "x": "\u001b"}}, "n": 10}

    def shuffled(v, rng):
        if isinstance(v, dict):
            keys = list(v)
            rng.shuffle(keys)
            return {k: shuffled(v[k], rng) for k in keys}
        return [shuffled(x, rng) for x in v] if isinstance(v, list) else v

    spellings = [json.dumps(shuffled(value, random.Random(s)), indent=s % 4 or None, ensure_ascii=bool(s % 2)) for s in range(12)]
    got = {r[0] for r in texts(spark, spellings).select(json_text.canonical(F.col("t"))).collect()}
    assert got == {json.dumps(value, sort_keys=True, separators=(",", ":"))}


def test_task_files(spark, tmp_path):
    tasks = [
        {"tool_name": "a", "description": "d1", "constraints": [{"param": "p", "kind": "enum", "gold_value": "x"}, {"param": "q", "kind": "range", "min_val": 1, "max_val": 3}]},
        {"tool_name": "b", "description": "d2"},
    ]
    (tmp_path / "t.json").write_text(json.dumps(tasks, indent=2))
    read = nested.read_tasks(spark, str(tmp_path / "t.json"))
    rows = {(r.tool_name, r.param, r.kind, r.gold_value, r.min_val, r.max_val) for r in nested.constraints_of(read).collect()}
    assert rows == {("a", "p", "enum", "x", None, None), ("a", "q", "range", None, 1, 3), ("b", None, None, None, None, None)}
    nested.write_tasks(read, str(tmp_path / "again"), per_line=1)
    again = nested.read_tasks(spark, str(tmp_path / "again"), whole_files=False)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, read.collect()))
    calls = spark.createDataFrame([("a", "d1", 1), ("a", "other", 2)], "tool_name string, description string, n int")
    assert {(r.n, r.constraints is None) for r in nested.constraint_lookup(calls, read).collect()} == {(1, False), (2, True)}
    (tmp_path / "bad.json").write_text('[{"tool_name": "a"}]')
    with pytest.raises(Exception, match="a task without description"):
        nested.read_tasks(spark, str(tmp_path / "bad.json")).collect()


def test_mirror_document_and_defaults(spark, tmp_path):
    whole = {
        "server_id": "s1", "source_repo": "o/r", "language": "python", "stars": 7, "stratum": "high", "notes": ODD[3] + ODD[4],
        "tools": [
            {"name": "t", "docstring": ODD[0], "source_hash": "x", "return_annotation": "int", "params": [{"name": "p", "annotation": "str", "default": None}, {"name": "q", "annotation": "int", "default": "1"}]},
            {"name": "u", "docstring": ODD[2], "source_hash": "y", "return_annotation": "None", "params": []},
        ],
    }
    scant = {"server_id": "s2", "source_repo": "o/q", "tools": [{"name": "t", "docstring": "d", "source_hash": "h"}]}
    filled = {"server_id": "s2", "source_repo": "o/q", "language": "unknown", "stars": 0, "stratum": "unknown", "notes": "", "tools": [{"name": "t", "docstring": "d", "source_hash": "h", "return_annotation": "None", "params": []}]}
    bare = {"server_id": "s3", "source_repo": "o/p"}
    for k, m in enumerate((whole, scant, bare)):
        (tmp_path / f"{k}.json").write_text(json.dumps(m, indent=2, ensure_ascii=False), encoding="utf-8")
    read = nested.read_mirrors(spark, str(tmp_path / "*.json"), whole_files=True)
    documents = {r.server_id: r.d for r in read.select("server_id", nested.mirror_document().alias("d")).collect()}
    dump = lambda m: json.dumps(m, indent=2, ensure_ascii=False)
    assert documents == {"s1": dump(whole), "s2": dump(filled), "s3": dump({**{k: v for k, v in filled.items() if k != "tools"}, "server_id": "s3", "source_repo": "o/p", "tools": []})}
    nested.write_mirrors(read, str(tmp_path / "lines"))
    again = nested.read_mirrors(spark, str(tmp_path / "lines"))
    assert {r.d for r in again.select(nested.mirror_document().alias("d")).collect()} == set(documents.values())


def test_verbatim_docstrings(spark):
    digest = hashlib.sha256("same".encode()).hexdigest()[:12]
    tools = [("same", "same", digest), ("stale", "same", "0" * 12), ("other", "mine", hashlib.sha256(b"mine").hexdigest()[:12]), ("lost", "x", "y")]
    m = spark.createDataFrame([("s", [{"name": n, "docstring": d, "source_hash": h} for n, d, h in tools])], "server_id string, tools array<struct<name:string,docstring:string,source_hash:string>>")
    source = spark.createDataFrame([("s", "same", "same"), ("s", "stale", "same"), ("s", "other", "yours")], "server_id string, tool string, docstring string")
    got = {(r.tool, r.violation) for r in nested.verbatim_violations(m, source).collect()}
    assert got == {("stale", "hash differs"), ("other", "docstring differs"), ("lost", "not in the source")}


def test_tapes(spark, tmp_path):
    rows = [("00ab", 'é"x', 1, None), ("00aa", "y", None, 2), ("ff00", "z", 3, 4), ("ff00", "z", 3, 4)]
    a = spark.createDataFrame(rows, "key string, response string, tokens_in long, tokens_out long")
    nested.write_tape(a, str(tmp_path / "tape"))
    assert {tuple(r) for r in nested.read_tape(spark, str(tmp_path / "tape")).collect()} == set(rows)
    (tmp_path / "one.json").write_text(json.dumps({"entries": {"k1": {"response": "hello", "tokens_in": 10}, "k2": {"response": "b"}}}, indent=2))
    assert {tuple(r) for r in nested.read_tape(spark, str(tmp_path / "one.json"), whole_files=True).collect()} == {("k1", "hello", 10, None), ("k2", "b", None, None)}


def merge(old, new):
    out = dict(old)
    for k, v in new.items():
        out[k] = merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def some_tree(rng, depth=3):
    leaf = lambda: rng.choice([1, None, "é\"x", [1, {"z": None}], {}, True, 2.5])
    return {k: some_tree(rng, depth - 1) if depth > 1 and rng.random() < 0.6 else leaf() for k in rng.sample(["a", "b", "c.d", "é", '"'], rng.randrange(4))}


def test_merged_trees_like_a_recursive_merge(spark):
    rng = random.Random(4)
    pairs = [(some_tree(rng), some_tree(rng)) for _ in range(120)]
    frame = lambda side: spark.createDataFrame([(k, json.dumps(p[side])) for k, p in enumerate(pairs) if k % 10 != 3 + side], "key long, tree string")
    out = trees.merged_trees(frame(0), frame(1), "key", "tree", Steps(spark, "test"))
    got = {r.key: json.loads(r.tree) for r in out.collect()}
    expect = {k: b if k % 10 == 3 else a if k % 10 == 4 else merge(a, b) for k, (a, b) in enumerate(pairs)}
    assert got == expect
    empty = frame(0).where("false")
    assert trees.merged_trees(empty, empty, "key", "tree", Steps(spark, "test")).count() == 0


def test_reverted_catalog(spark):
    schema = "case string, name string, text string, size int"
    before = spark.createDataFrame([("c", "a", "old a", 1), ("c", "b", None, None)], schema)
    after = spark.createDataFrame([("c", "a", "new a", 2), ("c", "b", "new b", 3), ("c", "n", "new n", 4)], schema)
    chosen = lambda *names: spark.createDataFrame([("c", n) for n in names], "case string, name string")
    got = trees.reverted(after, before, chosen("a", "b", "b", "gone"), ["case", "name"], "text", "size")
    assert {tuple(r) for r in got.select("name", "text", "size", "restored").collect()} == {("a", "old a", 1, True), ("b", None, None, True), ("n", "new n", 4, False)}
    with pytest.raises(Exception, match="nothing to restore for c/n"):
        trees.reverted(after, before, chosen("n"), ["case", "name"], "text").collect()


def test_version_order(spark):
    rising = [None, "", "0.0.1", "0.9", "1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-rc.2", "1.0.0-rc.10", "1.0.0", "1.0.1", "1.2", "1.10.0", "v2.0", "10"]
    d = texts(spark, rising).orderBy(F.rand(1)).orderBy(versions.version_order(F.col("t")))
    assert [r.t for r in d.collect()] == rising
    same = texts(spark, ["1", "1.0", "v1.0.0", "1.0+build.7"]).select(versions.version_order(F.col("t")).alias("v")).distinct()
    assert same.count() == 1


def test_registry_servers(spark):
    rows = [
        (1, "late", "d", "github", "https://github.com/o/r.git", True, "active"), (0, "first", None, "github", "https://github.com/o/r", True, "active"),
        (2, "old", "d", "github", "https://github.com/o/x", False, "active"), (3, "dead", "d", "github", "https://github.com/o/y", True, "deleted"),
        (4, "lab", "d", "gitlab", "https://gitlab.com/o/z", True, "active"), (5, "bare", "d", "github", None, True, "active"), (6, "none", "d", "github", "https://github.com/o/w", None, "active"),
    ]
    d = spark.createDataFrame(rows, "position long, name string, description string, source string, url string, is_latest boolean, status string")
    assert [tuple(r) for r in versions.registry_servers(d).collect()] == [("o-r", "o/r", "first", "", "https://github.com/o/r")]


def test_a_gate_that_blocks_never_plans_the_work(spark):
    f = lambda *severities: spark.createDataFrame([("c", s, "x", "y") for s in severities], "check string, severity string, subject string, detail string")
    asked = []

    def work():
        asked.append(1)
        return spark.range(3)

    shut = gates.gated(f("warn", "block"), work)
    assert (shut.result, shut.status, shut.blocking.count(), asked) == (None, 2, 1, [])
    open_ = gates.gated(f("warn"), work)
    assert (open_.result.count(), open_.status, asked) == (3, 0, [1])


def test_a_report_is_the_same_file_however_it_is_dealt_out(spark, tmp_path):
    rows = [(k % 50, f"line {k % 7}\nof é") for k in range(500)] + [(None, "first")]
    files = []
    for parts in (1, 7):
        d = spark.createDataFrame(rows, "k int, t string").repartition(parts).orderBy(F.rand(parts))
        reports.write_in_order(d, ["k"], "t", f"file://{tmp_path}/r{parts}.txt", Steps(spark, "test"), head="<", between="|\n", tail=">")
        files.append((tmp_path / f"r{parts}.txt").read_text())
    expect = "<" + "|\n".join(t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))) + ">"
    assert files == [expect, expect]
    reports.write_in_order(spark.createDataFrame([], "k int, t string"), ["k"], "t", f"file://{tmp_path}/empty.txt", Steps(spark, "test"), head="[", tail="]")
    assert (tmp_path / "empty.txt").read_text() == "[]"


def test_report_document_like_python(spark):
    d = spark.createDataFrame([(81.5, [{"name": 'a"b', "score": 75.0, "weight": 0.25}, {"name": "é", "score": 0.1, "weight": 0.02}]), (None, [])], "o double, d array<struct<name:string,score:double,weight:double>>")
    got = [r[0] for r in d.select(reports.report_document(F.col("o"), F.col("d"))).collect()]
    dump = lambda o, d: json.dumps({"schema_version": "1.0", "overall_score": o, "dimensions": d}, indent=2, ensure_ascii=False)
    assert got == [dump(81.5, [{"name": 'a"b', "score": 75.0, "weight": 0.25}, {"name": "é", "score": 0.1, "weight": 0.02}]), dump(None, [])]


def test_the_log_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "name string, seq long, error string"
    log, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("log", "latest", "checkpoint"))

    def append(number, *rows):
        logs.append_once(spark.createDataFrame(rows, schema).repartition(3), log, number)

    def run():
        logs.keep_latest(logs.read_log(spark, log, schema, files_at_a_time=2), "name", "seq", target, checkpoint)
        return {tuple(r) for r in logs.current(spark, target, "name").collect()}

    append(0, ("a", 1, "e"), ("b", 2, None), ("c", 9, None), (None, 3, "x"))
    assert run() == {("a", 1, "e"), ("b", 2, None), ("c", 9, None), (None, 3, "x")}
    assert len(list((tmp_path / "latest").iterdir())) > 1  # several micro-batches
    append(1, ("a", 4, None), ("c", 5, "late"), ("d", 6, "y"), ("d", 6, "z"))  # c's record is older than the one in the state
    expect = {("a", 4, None), ("b", 2, None), ("c", 9, None), ("d", 6, "z"), (None, 3, "x")}
    assert run() == expect
    assert run() == expect  # nothing new
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver was lost after the last batch was written and before it was committed
    for crc in (tmp_path / "checkpoint" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    assert run() == expect
    append(1, ("a", 4, None), ("c", 5, "late"), ("d", 6, "y"), ("d", 6, "z"))  # the append made again
    assert spark.read.schema(schema).parquet(f"{log}/append-*").count() == 8


def test_mirrors_shuffle_bare_fields_and_are_written_compressed(spark, tmp_path):
    from spindrift.plans import nested_queries

    m = nested_queries.order_mirrors(spark, "/root/testdata/sf0.001")
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan.split("Join")[0] and "sha2" not in plan.split("Join")[1]  # texts are made after the shuffle
    nested.write_mirrors(m, str(tmp_path / "m"))
    parts = [p.name for p in (tmp_path / "m").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.endswith(".json.gz") for p in parts)
    assert nested.read_mirrors(spark, str(tmp_path / "m")).count() == m.count()
