"""Searches by probes against loops over single cases, numbering against Python's sort."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import numbering, probing
from spindrift.sources.shared import Steps

THRESHOLD = 0.05


def stream(seed):
    s = seed & 0x7FFFFFFF
    while True:
        s = (1103515245 * s + 12345) & 0x7FFFFFFF
        yield s / 0x7FFFFFFF


def half_search(open_, probe, base, base_delta, threshold):
    open_, used, ruled, trace = list(open_), 0, {}, []
    while len(open_) > 1:
        a, b = open_[: len(open_) // 2], open_[len(open_) // 2 :]
        d, lo, _ = probe(base | set(a))
        used += 1
        hit = lo - base_delta > threshold
        trace.append((tuple(a), hit))
        ruled |= {t: 0.0 for t in b} if hit else {t: d - base_delta for t in a}
        open_ = a if hit else b
    d, lo, hi = probe(base | {open_[0]})
    trace.append(((open_[0],), lo - base_delta > threshold))
    if lo - base_delta <= threshold:
        return None, used + 1, ruled | {open_[0]: d - base_delta}, trace
    return (open_[0], d - base_delta, lo - base_delta, hi - base_delta), used + 1, ruled, trace


def whole_search(items, probe, threshold):
    rest, base, base_delta, found, used, ruled, trace = list(items), set(), 0.0, [], 0, {}, []
    while rest:
        one, n, r, t = half_search(rest, probe, base, base_delta, threshold)
        used, trace = used + n, trace + t
        ruled.update(r)
        if one is None:
            break
        found.append(one)
        rest.remove(one[0])
        base |= {one[0]}
        base_delta += one[1]
    found.sort(key=lambda f: -f[1])
    others = sorted((t for t in items if t not in base), key=lambda t: -ruled.get(t, 0.0))
    return [(t, round(d, 9), True) for t, d, _, _ in found] + [(t, round(ruled.get(t, 0.0), 9), False) for t in others], used, trace


def contrasts(items, probe, seed=42):
    n = len(items)
    rounds = n if n <= 1 else min(max(2, -(-n // 2)), n - 1)
    u, cache, sets, used = stream(seed), {frozenset(): (0.0, 0.0, 0.0)}, [], 0
    for _ in range(rounds):
        s = frozenset(t for t in items if next(u) < 0.5)
        sets.append(s)
        if s not in cache:
            cache[s], used = probe(s), used + 1
    out = []
    for t in items:
        inside = [cache[s] for s in sets if t in s]
        outside = [cache[s][0] for s in sets if t not in s] + [0.0]
        delta = (sum(x[0] for x in inside) / len(inside) if inside else 0.0) - sum(outside) / len(outside)
        half = sum(x[2] - x[1] for x in inside) / len(inside) / 2 if inside else 0.0
        out.append((t, round(delta, 9), round(delta - half, 9), round(delta + half, 9)))
    return sorted(out, key=lambda r: -r[1]), used


def plain_probe(effects, margin):
    def probe(s):
        d = sum(effects.get(t, 0.0) for t in sorted(s))
        return d, d - margin, d + margin

    return probe


def made(n_cases=40, seed=1):
    """Cases with effects that are multiples of 1/64, so sums are exact in any order."""
    rng = random.Random(seed)
    cases = {}
    for c in range(n_cases):
        items = [f"t{k}" for k in rng.sample(range(20), rng.choice([0, 1, 2, 3, 5, 8, 13]))]
        cases[c] = (items, {t: rng.choice([0, 0, 0, 0, 0, 1, 2, 5, 8, -3]) / 64 for t in items})
    return cases


def frames(spark, cases):
    c = spark.createDataFrame([(k, items) for k, (items, _) in cases.items()], "case_id int, items array<string>")
    e = spark.createDataFrame([(k, t, v) for k, (_, effects) in cases.items() for t, v in effects.items()], "case_id int, item string, effect double")
    return c, e


def test_bisection_search_like_a_loop(spark):
    cases = made()
    c, e = frames(spark, cases)
    ranking, decisions = probing.bisection_search(c, probing.additive(e, 1 / 128), THRESHOLD, Steps(spark, "test"))
    got, traces = {}, {}
    for r in ranking.orderBy("case_id", "rank").collect():
        got.setdefault(r.case_id, ([], r.probes))[0].append((r.item, round(r.delta, 9), r.culprit))
        assert r.rank == len(got[r.case_id][0]) and (r.ci_lo is not None) == r.culprit
    for r in decisions.orderBy("case_id", "step").collect():
        traces.setdefault(r.case_id, []).append((tuple(r.probed), r.significant))
    for k, (items, effects) in cases.items():
        if items:
            rows, used, trace = whole_search(items, plain_probe(effects, 1 / 128), THRESHOLD)
            assert (got[k][0], got[k][1], traces[k]) == (rows, used, trace), k
        else:
            assert k not in got
    nothing, trace = probing.bisection_search(c.where("false"), probing.additive(e), THRESHOLD, Steps(spark, "test"))
    assert nothing.count() == trace.count() == 0 and nothing.columns == ranking.columns and trace.columns == decisions.columns


# Cases with known outcomes.
KNOWN = {
    "one of sixteen": ([f"t{i}" for i in range(16)], {"t5": 0.20}, 0.05, ["t5"]),
    "two of six": ([f"t{i}" for i in range(6)], {"t1": 0.15, "t4": 0.15}, 0.05, ["t1", "t4"]),
    "none": (["a", "b", "c"], {}, 0.05, []),
    "below": (["t0", "t1", "t2", "t3"], {"t0": 0.01, "t1": 0.01, "t2": 0.04, "t3": 0.03}, 0.05, []),
    "below, turned": (["t3", "t2", "t1", "t0"], {"t0": 0.01, "t1": 0.01, "t2": 0.04, "t3": 0.03}, 0.05, []),
}


def test_known_cases(spark):
    names = list(KNOWN)
    c = spark.createDataFrame([(k, KNOWN[k][0]) for k in names], "case_id string, items array<string>")
    e = spark.createDataFrame([(k, t, v) for k in names for t, v in KNOWN[k][1].items()], "case_id string, item string, effect double")
    ranking, _ = probing.bisection_search(c, probing.additive(e), THRESHOLD, Steps(spark, "test"))
    got = {k: list(g) for k, g in itertools.groupby(ranking.orderBy("case_id", "rank").collect(), key=lambda r: r.case_id)}
    for k, (items, _, _, culprits) in KNOWN.items():
        assert sorted(r.item for r in got[k] if r.culprit) == culprits
        assert sorted(r.item for r in got[k]) == sorted(items)
    assert got["one of sixteen"][0].probes < 16
    assert all(r.delta == 0 for r in got["none"])
    assert [r.item for r in got["below"]][:2] == ["t2", "t3"] and [r.item for r in got["below, turned"]][:2] == ["t2", "t3"]


def test_no_coalition_is_asked_for_twice(spark):
    cases = made(12, seed=9)
    c, e = frames(spark, cases)
    asked = []
    answer = probing.additive(e, 1 / 128)

    def probe(wanted):
        asked.extend((r.case_id, tuple(r.coalition)) for r in wanted.select("case_id", "coalition").collect())
        return answer(wanted)

    probing.bisection_search(c, probe, THRESHOLD, Steps(spark, "test"))
    assert asked and len(asked) == len(set(asked))


def test_a_step_of_additive_probes_shuffles_nothing(spark, monkeypatch):
    cases = made(12, seed=9)
    c, e = frames(spark, cases)
    plans, add = [], Steps.add

    def watched(self, df, place, number):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return add(self, df, place, number)

    monkeypatch.setattr(Steps, "add", watched)
    ranking, _ = probing.bisection_search(c, probing.additive(e, 1 / 128), THRESHOLD, Steps(spark, "test"))
    assert ranking.count() and plans and not any("Exchange" in p or "Join" in p for p in plans)
    contrasts_ = probing.shapley_search(c, probing.additive(e, 1 / 128), Steps(spark, "test"))
    assert "Exchange" not in contrasts_._jdf.queryExecution().executedPlan().toString()


def test_answers_in_a_row_are_those_of_the_table(spark):
    cases = made(40, seed=5)
    c, e = frames(spark, cases)
    e = e.unionByName(e.where("item = 't3'"))  # effects of one item add up
    probe = probing.additive(e, 1 / 128)
    table = lambda wanted: probe(wanted)
    for search in (lambda p: probing.bisection_search(c, p, THRESHOLD, Steps(spark, "test"))[0], lambda p: probing.shapley_search(c, p, Steps(spark, "test"))):
        rows = [sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in search(p).collect()), key=repr) for p in (probe, table)]
        assert rows[0] and rows[0] == rows[1]


def test_contrasts_like_a_loop(spark):
    cases = made(80, seed=3)
    c, e = frames(spark, cases)
    got = {}
    for r in probing.shapley_search(c, probing.additive(e, 1 / 128), Steps(spark, "test")).orderBy("case_id", "rank").collect():
        got.setdefault(r.case_id, ([], r.probes))[0].append((r.item, round(r.delta, 9), round(r.ci_lo, 9), round(r.ci_hi, 9)))
    for k, (items, effects) in cases.items():
        if items:
            rows, used = contrasts(items, plain_probe(effects, 1 / 128))
            assert got[k][1] == used and sorted(got[k][0]) == sorted(rows)
            assert [r[1] for r in got[k][0]] == [r[1] for r in rows]


def test_trace_verdicts(spark):
    rows = [(1, 1, ["a"], [], True), (1, 2, ["a"], ["a"], True), (2, 1, ["a", "b"], [], False), (2, 2, ["c"], [], False), (3, 1, ["x"], [], True)]
    d = spark.createDataFrame(rows, "case_id int, step int, probed array<string>, base array<string>, significant boolean")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, item string")
    assert {(r.case_id, r.step, r.verdict) for r in probing.traced(d, t).collect()} == {(1, 1, "correct"), (1, 2, "false positive"), (2, 1, "lack of power"), (2, 2, "correct")}


@pytest.mark.parametrize("seed", range(2))
def test_numbers_within_groups(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), k) for k in range(700)]
    d = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    got = numbering.numbered(d, ["x", "id"], Steps(spark, "test"), ["g"]).collect()
    expect = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        expect |= {r[2]: k + 1 for k, r in enumerate(own)}
    assert {r.id: r.number for r in got} == expect
    assert numbering.numbered(d.where("false"), ["x"], Steps(spark, "test")).count() == 0


def test_zip_stops_with_the_shorter_side(spark):
    a, b = spark.range(5).withColumnRenamed("id", "x"), spark.range(10, 13).withColumnRenamed("id", "x")
    z = numbering.zipped(a, b.orderBy(F.rand(1)), ["x"], Steps(spark, "test")).collect()
    assert sorted((r.number, r.left.x, r.right.x) for r in z) == [(1, 0, 10), (2, 1, 11), (3, 2, 12)]
