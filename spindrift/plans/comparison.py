"""Queries: decomposed rates, pairing, adjustment, bootstrap intervals and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, resample, rng, trials
from ..sources.tables import EVENT_TRIALS_SQL, LINE_TRIALS_SQL, event_trials, line_trials
from .registry import query, rounded

PAIRS_SQL = """
means AS (
  SELECT server, task, avg(joint) FILTER (arm = 'before') AS before_mean, avg(joint) FILTER (arm = 'after') AS after_mean,
         count(*) FILTER (arm = 'before') AS n_before, count(*) FILTER (arm = 'after') AS n_after
  FROM trials GROUP BY server, task),
pairs AS (SELECT *, after_mean - before_mean AS delta FROM means WHERE n_before > 0 AND n_after > 0)
"""
CUPED_SQL = """
moments AS (
  SELECT server, count(*) AS n_tasks, avg(before_mean) AS bar, var_pop(before_mean) AS v, covar_pop(before_mean, delta) AS c, var_pop(delta) AS raw
  FROM pairs GROUP BY server),
adjusted AS (
  SELECT p.server, p.task, m.n_tasks, p.delta, CASE WHEN m.v = 0 THEN 0.0 ELSE m.c / m.v END AS theta, m.v, m.raw,
         p.delta - CASE WHEN m.v = 0 THEN 0.0 ELSE m.c / m.v END * (p.before_mean - m.bar) AS adjusted
  FROM pairs p JOIN moments m USING (server) WHERE m.n_tasks >= 2),
reduced AS (
  SELECT server, any_value(n_tasks) AS n_tasks, avg(adjusted) AS delta, any_value(theta) AS theta,
         CASE WHEN any_value(v) = 0 OR any_value(raw) <= 0 THEN 0.0 ELSE 100 * (1 - var_pop(adjusted) / any_value(raw)) END AS reduction_pct
  FROM adjusted GROUP BY server)
"""
T_SQL = "[" + ", ".join(map(str, resample.T_975)) + "]"
VERDICT_SQL = """CASE WHEN ci_hi - ci_lo > 2 * {t} THEN 'insufficient_sensitivity' WHEN ci_hi < -{t} THEN 'regression'
  WHEN ci_lo > {t} THEN 'improvement' ELSE 'no_change' END"""


def replicates_sql(values: str, resamples: int, seed: int = 42) -> str:
    """CTEs rep (server, r, m), ci (server, lo, hi) and se of the table ``values`` (server, i, n, x)."""
    lo, hi = resample.bounds(resamples)
    u = rng.uniform_sql("r * n + i + 1", str(seed))
    return f"""
drawn AS (SELECT server, r, least(floor({u} * n)::BIGINT, n - 1) AS at FROM {values}, range({resamples}) AS g(r)),
rep AS (SELECT d.server, d.r, avg(v.x) AS m FROM drawn d JOIN {values} v ON v.server = d.server AND v.i = d.at GROUP BY d.server, d.r),
placed AS (SELECT server, m, row_number() OVER (PARTITION BY server ORDER BY m) AS p FROM rep),
ci AS (SELECT server, max(m) FILTER (p = {lo + 1}) AS lo, max(m) FILTER (p = {hi + 1}) AS hi, stddev_samp(m) AS se FROM placed GROUP BY server)
"""


INDEXED_SQL = """
vals AS (
  SELECT server, adjusted AS x, row_number() OVER (PARTITION BY server ORDER BY task) - 1 AS i, count(*) OVER (PARTITION BY server) AS n FROM adjusted)
"""


def server_diff_sql(source: str, threshold: float, resamples: int) -> str:
    return f"""
WITH {source}, {PAIRS_SQL}, {CUPED_SQL}, {INDEXED_SQL}, {replicates_sql('vals', resamples)},
out AS (
  SELECT r.*, r.n_tasks < 30 AS few_clusters,
         CASE WHEN r.n_tasks < 30 THEN r.delta - ({T_SQL})[greatest(r.n_tasks - 1, 1)::INT] * se ELSE lo END AS ci_lo,
         CASE WHEN r.n_tasks < 30 THEN r.delta + ({T_SQL})[greatest(r.n_tasks - 1, 1)::INT] * se ELSE hi END AS ci_hi
  FROM reduced r JOIN ci USING (server)),
judged AS (SELECT *, {VERDICT_SQL.format(t=threshold)} AS verdict FROM out)
SELECT server, n_tasks, round(delta, 6) AS delta, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(theta, 6) AS theta,
       round(reduction_pct, 6) AS reduction_pct, few_clusters, verdict, (verdict = 'regression')::INT AS exit_code FROM judged
"""


@query("df2_server_diff", server_diff_sql(EVENT_TRIALS_SQL, 0.05, 2000))
def df2_server_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.server_diff(event_trials(spark, sf_dir)))


@query("df2_server_diff_tight", server_diff_sql(EVENT_TRIALS_SQL, 0.01, 2000))
def df2_server_diff_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.server_diff(event_trials(spark, sf_dir), threshold=0.01, resamples=2000))


@query("df2_server_diff_lines", server_diff_sql(LINE_TRIALS_SQL, 0.05, 2000))
def df2_server_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.server_diff(line_trials(spark, sf_dir), resamples=2000))


@query("df2_unadjusted", server_diff_sql(EVENT_TRIALS_SQL, 0.05, 2000).replace("CASE WHEN m.v = 0 THEN 0.0 ELSE m.c / m.v END", "0.0").replace("CASE WHEN any_value(v) = 0 OR any_value(raw) <= 0 THEN 0.0 ELSE 100 * (1 - var_pop(adjusted) / any_value(raw)) END", "0.0"))
def df2_unadjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.server_diff(event_trials(spark, sf_dir), use_cuped=False, resamples=2000))


@query("prj_outcomes", f"WITH {EVENT_TRIALS_SQL} SELECT server, trial, correct, round(argument_score, 6) AS argument_score, round(joint, 6) AS joint FROM trials WHERE server = 'all'")
def prj_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials.with_outcomes(event_trials(spark, sf_dir)).where("server = 'all'")
    return rounded(t.select("server", "trial", "correct", "argument_score", "joint"))


@query("ag1_decomposed_rate", f"""WITH {EVENT_TRIALS_SQL} SELECT server, arm, count(*) AS n, round(avg(correct::INT), 6) AS selection_accuracy,
  round(avg(argument_score), 6) AS argument_accuracy, round(avg(joint), 6) AS joint_rate FROM trials GROUP BY server, arm""")
def ag1_decomposed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trials.decomposed_rate(event_trials(spark, sf_dir), "server", "arm"))


@query("ag2_task_means", f"WITH {EVENT_TRIALS_SQL} SELECT server, arm, task, round(avg(joint), 6) AS mean, count(*) AS n FROM trials GROUP BY server, arm, task")
def ag2_task_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trials.task_means(event_trials(spark, sf_dir)))


@query("jn1_paired_tasks", f"""WITH {EVENT_TRIALS_SQL}, {PAIRS_SQL} SELECT server, task, round(before_mean, 6) AS before_mean, round(after_mean, 6) AS after_mean,
  n_before, n_after, round(delta, 6) AS delta FROM pairs""")
def jn1_paired_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trials.matched(trials.paired(event_trials(spark, sf_dir))))


@query("jn1_unmatched_tasks", f"""WITH {LINE_TRIALS_SQL}, {PAIRS_SQL} SELECT server, task, CASE WHEN n_after = 0 THEN 'before' ELSE 'after' END AS arm
  FROM means WHERE n_before = 0 OR n_after = 0""")
def jn1_unmatched_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.unmatched(trials.paired(line_trials(spark, sf_dir)))


@query("ag3_cuped", f"WITH {EVENT_TRIALS_SQL}, {PAIRS_SQL}, {CUPED_SQL} SELECT server, n_tasks, round(theta, 6) AS theta, round(reduction_pct, 6) AS reduction_pct FROM reduced")
def ag3_cuped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials.cuped(trials.matched(trials.paired(event_trials(spark, sf_dir)))).where("n_tasks >= 2")
    return rounded(t.groupBy("server").agg(F.max("n_tasks").alias("n_tasks"), F.max("theta").alias("theta"), F.max("reduction_pct").alias("reduction_pct")))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = trials.matched(trials.paired(event_trials(spark, sf_dir)))
    return trials.indexed(pairs, "delta", "task")


DELTAS_SQL = "vals AS (SELECT server, delta AS x, row_number() OVER (PARTITION BY server ORDER BY task) - 1 AS i, count(*) OVER (PARTITION BY server) AS n FROM pairs)"


@query("bs2_cluster_bootstrap", f"WITH {EVENT_TRIALS_SQL}, {PAIRS_SQL}, {DELTAS_SQL}, {replicates_sql('vals', 2000)} SELECT server, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi FROM ci")
def bs2_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = resample.replicate_means(_deltas(spark, sf_dir), 2000)
    return rounded(resample.order_statistics(means, 2000).select("server", F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi")))


@query("bs3_wild_bootstrap", f"""WITH {EVENT_TRIALS_SQL}, {PAIRS_SQL}, {DELTAS_SQL},
point AS (SELECT server, avg(x) AS point FROM vals GROUP BY server),
rep AS (SELECT server, r, any_value(point) + sum(CASE WHEN {rng.uniform_sql('r * n + i + 1')} >= 0.5 THEN 1.0 ELSE -1.0 END * (x - point)) / any_value(n) AS m
  FROM vals JOIN point USING (server), range(2000) AS g(r) GROUP BY server, r),
placed AS (SELECT server, m, row_number() OVER (PARTITION BY server ORDER BY m) AS p FROM rep)
SELECT server, round(max(m) FILTER (p = 51), 6) AS ci_lo, round(max(m) FILTER (p = 1950), 6) AS ci_hi FROM placed GROUP BY server""")
def bs3_wild_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = resample.flipped_means(_deltas(spark, sf_dir), 2000)
    return rounded(resample.order_statistics(means, 2000).select("server", F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi")))


@query("bs4_t_adjusted", f"""WITH {EVENT_TRIALS_SQL}, {PAIRS_SQL}, {DELTAS_SQL}, {replicates_sql('vals', 2000)},
p AS (SELECT server, avg(x) AS point, count(*) AS n FROM vals GROUP BY server)
SELECT server, round(point, 6) AS point, round(se, 6) AS se,
  round(point - CASE WHEN n > 30 THEN 1.959964 ELSE ({T_SQL})[greatest(n - 1, 1)::INT] END * se, 6) AS ci_lo,
  round(point + CASE WHEN n > 30 THEN 1.959964 ELSE ({T_SQL})[greatest(n - 1, 1)::INT] END * se, 6) AS ci_hi FROM p JOIN ci USING (server)""")
def bs4_t_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _deltas(spark, sf_dir)
    se = resample.spread(resample.replicate_means(values, 2000))
    point = values.groupBy("server").agg(F.avg("x").alias("point"), F.count("*").alias("n"))
    margin = resample.t_critical(F.col("n") - 1) * F.col("se")
    return rounded(point.join(se, "server").select("server", "point", "se", (F.col("point") - margin).alias("ci_lo"), (F.col("point") + margin).alias("ci_hi")))


@query("df1_trial_diff")
def df1_trial_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All servers with 2,000 replicates: too slow for SQL, held against a loop in the tests."""
    return rounded(compare.trial_diff(event_trials(spark, sf_dir)))


@query("rng1_draws", f"SELECT range AS k, {rng.state_sql('range')} AS state, round({rng.normal_sql('range + 1')}, 9) AS normal FROM range(1, 5001)")
def rng1_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.range(1, 5001).withColumnRenamed("id", "k")
    return k.select("k", rng.state(F.col("k")).alias("state"), F.round(rng.normal(F.col("k") + 1), 9).alias("normal"))
