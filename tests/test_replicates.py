"""Bootstrap replicates made in blocks, against the generator run one draw after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import compare, replicates, resample, trials


def draws(n, seed=42):
    s = seed
    for _ in range(n):
        s = (1103515245 * s + 12345) % 2**31
        yield s / (2**31 - 1)


def looped(x, resamples, seed=42):
    n, u = len(x), list(draws(len(x) * resamples, seed))
    return np.array([sum(x[min(int(u[r * n + i] * n), n - 1)] for i in range(n)) / n for r in range(resamples)])


@pytest.mark.parametrize("n,held", [(1, 10), (7, 10), (25, 10), (30, 10), (29, 1000)])
def test_blocks_of_any_size_give_the_same_sums(spark, n, held):
    x = [float(v % 11) for v in range(n)]
    values = spark.createDataFrame([("s", i, n, v) for i, v in enumerate(x)], "server string, i long, n long, x double")
    sums = replicates.replicate_sums(values, 50, 42, ("server",), F.col("n"), F.lit(0), held=held)
    got = [r["s"] / n for r in sums.orderBy("r").collect()]
    assert np.allclose(got, looped(x, 50))


def test_draws_wider_than_one_step_table():
    n = (1 << 16) + 1000
    x = np.arange(n, dtype=float)
    got = replicates.drawn_sums(x, n, 0, n, 0, 1, 2, 42, None)[0]
    u = np.array(list(draws(2 * n)))[n:]
    assert got == np.minimum((u * n).astype(int), n - 1).sum()
    signs = replicates.drawn_sums(x[40_000:], n, 40_000, n, 0, 1, 2, 42, 5.0)[0]
    assert np.isclose(signs, (np.where(u >= 0.5, 1, -1) * (x - 5))[40_000:].sum())


def test_positions_count_modulo_the_period():
    x = np.arange(100, dtype=float)
    assert replicates.drawn_sums(x, 100, 0, 100, 2**31, 0, 3, 42, None).tolist() == replicates.drawn_sums(x, 100, 0, 100, 0, 0, 3, 42, None).tolist()


def test_no_values_no_replicates(spark):
    empty = spark.createDataFrame([], "server string, i long, n long, x double")
    assert resample.replicate_means(empty, 10).count() == 0


def test_trial_diff_against_a_loop(spark):
    rows = [(s, arm, f"t{k % 5}", f"t{k % 5}" if k % 4 else "x", (k * 37 % 10) / 10, k) for s in ("p", "q") for arm, m in (("before", 23), ("after", 31)) for k in range(m)]
    data = spark.createDataFrame(rows, "server string, arm string, task string, selected string, cs double, trial long")
    resamples = 200
    got = {r["server"]: r for r in compare.trial_diff(data, resamples=resamples).collect()}
    low, high = resample.bounds(resamples)
    for s in ("p", "q"):
        sides = [[c if t == p else 0.0 for _, _, t, p, c, _ in sorted((r for r in rows if r[:2] == (s, arm)), key=lambda r: (r[2], r[5]))] for arm in ("before", "after")]
        stream, means = draws(54 * resamples), []
        for _ in range(resamples):
            b, a = ([x[min(int(next(stream) * len(x)), len(x) - 1)] for _ in x] for x in sides)
            means.append(sum(a) / len(a) - sum(b) / len(b))
        means.sort()
        assert np.isclose(got[s]["ci_lo"], means[low]) and np.isclose(got[s]["ci_hi"], means[high])
        assert np.isclose(got[s]["delta"], np.mean(sides[1]) - np.mean(sides[0]))
    assert trials.with_outcomes(data).count() == len(rows)


def test_states_of_a_block_find_its_draws():
    """A block's range of states against all draws, with replicates that overlap, lie apart and run past the end of the period."""
    rng = np.random.default_rng(2)
    n, low = 300_000, 12_345
    x = rng.random(100)
    a, z = replicates.first_state(low, n), replicates.first_state(low + len(x), n)
    for stride, offset, resamples in ((n, 0, 7), (n + 17, 5, 5), (n // 3, 0, 9), (3 * n, 2**31 - 4 * n, 4), (2**31 - n // 2, 1, 6)):
        parts = [replicates.state_sums(x, n, low, stride, offset, resamples, p, q, 42) for p, q in ((a, a + 1000), (a + 1000, z))]
        assert np.allclose(sum(parts), replicates.drawn_sums(x, n, low, stride, offset, 0, resamples, 42, None), rtol=1e-9)
    # More draws than the period has: every state counts once a lap, and then the rest.
    k = 2**31 + n
    again = ((replicates.draw_of(np.arange(50), 7) - 1) % 2**31 < n).sum()
    assert replicates.state_sums(np.ones(100), k, 0, k, 0, 1, 0, 50, 7)[0] == 50 + again


def test_large_groups_cost_one_period(spark, monkeypatch):
    """Groups whose blocks go through states give the sums of the draws; the work of all blocks is one period."""
    x = [float(k % 7) for k in range(4000)]
    values = spark.createDataFrame([("s", i, len(x), v) for i, v in enumerate(x[:3])], "server string, i long, n long, x double")
    # Three of 4,000 values are there: the block's share of the period is small.
    args = (values, 30, 42, ("server",), F.col("n"), F.lit(0))
    one = {r.r: r.s for r in replicates.replicate_sums(*args, held=3, dear=0.0).collect()}
    two = [replicates.drawn_sums(np.array(x[:3]), 4000, 0, 4000, 0, r, r + 1, 42, None)[0] for r in range(30)]
    assert sorted(one) == list(range(30)) and np.allclose([one[r] for r in range(30)], two)


def test_blocks_are_cut_from_sorted_rows(spark):
    """Blocks that begin and end anywhere in a batch, and a null key; no aggregation holds the values of its blocks as objects."""
    rows = [(s, i, n, float(i * 3 % 11)) for s, n in (("p", 23), ("q", 5), (None, 31)) for i in range(n)]
    values = spark.createDataFrame(rows, "server string, i long, n long, x double").repartition(3)
    placed = values.withColumn("_b", F.floor(F.col("i") / 8).cast("int"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        got = {(r["server"], r["_b"]): (r["n"], r["_x"]) for r in replicates.value_blocks(placed, ("server",), 2).collect()}
    finally:
        spark.conf.set(key, before)
    expect = {(s, b): (n, [float(i * 3 % 11) for i in range(8 * b, min(8 * b + 8, n))]) for s, n in (("p", 23), ("q", 5), (None, 31)) for b in range(-(-n // 8))}
    assert got == expect
    plan = replicates.replicate_sums(values, 5, 42, ("server",), F.col("n"), F.lit(0))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
