"""Ranks, correlations and percentiles of groups of any size, against Python and Spark's own."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from spindrift.operators import ranks


def mean_ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(g, rng.choice((None, "a", "b")) if g else "a", rng.randrange(9) / 4 if k % 19 else None, rng.gauss(0, 1) if k % 3 else 0.5) for g in (0, 1) for k in range(150)]
    return out + [(2, None, 1.0, float(k)) for k in range(4)] + [(3, "only nulls", None, 1.0)]


def test_spearman_by_ranges(spark, rows):
    df = spark.createDataFrame(rows, "g int, h string, x double, y double")
    got = ranks.spearman(df, "g", "h")
    expect = {}
    for key in {r[:2] for r in rows}:
        x, y = zip(*[r[2:] for r in rows if r[:2] == key and r[2] is not None]) if any(r[:2] == key and r[2] is not None for r in rows) else ((), ())
        if x:
            expect[key] = (len(x), statistics.correlation(mean_ranks(x), mean_ranks(y)) if len(set(x)) > 1 else 0.0)
    found = {(r.g, r.h): (r.n, r.r) for r in got.collect()}
    assert found.keys() == expect.keys()
    assert all(found[k][0] == n and math.isclose(found[k][1], r, abs_tol=1e-9) for k, (n, r) in expect.items())
    # No window, so no task, holds a whole group.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_percentiles_by_ranges(spark, rows):
    df = spark.createDataFrame(rows, "g int, h string, x double, y double")
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.975, "e": 1.0}
    for keys in ((), ("g",), ("g", "h")):
        got = ranks.percentiles(df, "x", shares, *keys)
        own = df.groupBy(*keys).agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in shares.items()])
        assert sorted(map(repr, got.collect())) == sorted(map(repr, own.collect()))
    assert ranks.tercile(df.where("false"), "y").count() == 0
    plan = ranks.tercile(df, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_windows_over_small_groups_take_more_tasks_as_rows_grow(spark, monkeypatch):
    from spindrift.plans import statistics as plans

    monkeypatch.setattr(ranks, "ROWS", 500, raising=False)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert plans.wn1_average_rank(spark, sf).rdd.getNumPartitions() >= n // 500
