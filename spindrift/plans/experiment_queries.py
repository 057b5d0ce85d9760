"""Queries: whole experiments over recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments
from ..sources.tables import table
from .comparison import server_diff_sql
from .registry import query, rounded

#: A line is a run: its supplier the task, twenty sets of suppliers the experiments, arms by line number.
LINES_SQL = """r AS (SELECT l_suppkey % 20 AS experiment, l_suppkey AS task, l_orderkey * 10 + l_linenumber AS trial, ['s1', 's2', 'a', 'b', 'fixed', 'oracle', 'a'][l_linenumber] AS arm, l_suppkey % 3 AS family,
  l_discount < CASE WHEN l_linenumber IN (1, 2, 3, 7) THEN 0.031 + (l_suppkey % 20) * 0.003 WHEN l_linenumber = 4 THEN 0.061 ELSE 0.04 + 0.006 * l_linenumber END AS correct FROM lineitem)"""
SIGN_SQL = "CASE WHEN w + l = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(w, l) + 1), lambda i: exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2))))), 4) END"


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("l_suppkey"), F.col("l_linenumber")
    limit = F.when(line.isin(1, 2, 3, 7), 0.031 + (k % 20) * 0.003).when(line == 4, 0.061).otherwise(0.04 + 0.006 * line)
    arm = F.get(F.array(*map(F.lit, ("s1", "s2", "a", "b", "fixed", "oracle", "a"))), line - 1)
    return table(spark, sf_dir, "lineitem").select((k % 20).alias("experiment"), k.alias("task"), (F.col("l_orderkey") * 10 + line).alias("trial"), arm.alias("arm"), (k % 3).alias("family"), (F.col("l_discount") < limit).alias("correct"))


@query("pl7_gated_arms", f"""WITH {LINES_SQL},
f AS (SELECT experiment, task, min(correct::INT) AS first FROM (SELECT *, rank() OVER (PARTITION BY experiment, task ORDER BY trial) AS k FROM r WHERE arm = 'a') WHERE k = 1 GROUP BY ALL),
gate AS (SELECT experiment, avg(first) AS step1 FROM f GROUP BY experiment),
rate AS (SELECT experiment, avg(correct::INT) FILTER (arm = 'a') AS ra, avg(correct::INT) FILTER (arm = 'b') AS rb FROM r GROUP BY experiment),
t AS (SELECT experiment, task, avg(correct::INT) FILTER (arm = 'a') AS a, avg(correct::INT) FILTER (arm = 'b') AS b FROM r GROUP BY experiment, task),
s AS (SELECT experiment, count(*) AS n, count(*) FILTER (b > a) AS w, count(*) FILTER (b < a) AS l FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY experiment),
x AS (SELECT *, {SIGN_SQL} AS p FROM gate LEFT JOIN rate USING (experiment) LEFT JOIN s USING (experiment))
SELECT experiment, round(step1, 6) AS step1_rate, step1 < 0.85 AS headroom, CASE WHEN step1 < 0.85 THEN n END AS n_tasks, CASE WHEN step1 < 0.85 THEN round(ra, 6) END AS rate_a, CASE WHEN step1 < 0.85 THEN round(rb, 6) END AS rate_b,
  CASE WHEN step1 < 0.85 THEN round(100 * (rb - ra), 6) END AS effect_pp, CASE WHEN step1 < 0.85 THEN w END AS wins, CASE WHEN step1 < 0.85 THEN l END AS losses, CASE WHEN step1 < 0.85 THEN n - w - l END AS ties, CASE WHEN step1 < 0.85 THEN p END AS p,
  CASE WHEN step1 >= 0.85 THEN 'no headroom' WHEN rb > ra AND p < 0.05 THEN 'positive' WHEN rb > ra THEN 'directional' ELSE 'null' END AS verdict FROM x""")
def pl7_gated_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.gated_arms(line_runs(spark, sf_dir), "experiment"))


@query("pl5_screened_arms", f"""WITH {LINES_SQL},
c AS (SELECT experiment, task, count(*) FILTER (arm = 's1' AND correct) AS s1, count(*) FILTER (arm = 's2' AND correct) AS s2, count(*) FILTER (arm = 's1') AS n1, count(*) FILTER (arm = 's2') AS n2 FROM r WHERE arm IN ('s1', 's2') GROUP BY experiment, task),
st AS (SELECT *, n1 > 0 AND n2 > 0 AND abs(s1 - s2) <= 1 AS stable FROM c), z AS (SELECT experiment, count(*) AS n_screened, count(*) FILTER (stable) AS n_stable FROM st GROUP BY experiment),
t AS (SELECT r.experiment, r.task, avg(correct::INT) FILTER (arm = 'a') AS a, avg(correct::INT) FILTER (arm = 'b') AS b FROM r JOIN st ON st.experiment = r.experiment AND st.task = r.task AND st.stable GROUP BY r.experiment, r.task),
s AS (SELECT experiment, avg(a) AS ma, avg(b) AS mb, count(*) FILTER (b > a) AS w, count(*) FILTER (b < a) AS l FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY experiment),
x AS (SELECT *, {SIGN_SQL} AS p, n_stable >= 3 AS enough FROM z LEFT JOIN s USING (experiment))
SELECT experiment, n_screened, n_stable, CASE WHEN enough THEN round(ma, 6) END AS mean_a, CASE WHEN enough THEN round(mb, 6) END AS mean_b, CASE WHEN enough THEN w END AS wins, CASE WHEN enough THEN l END AS losses, CASE WHEN enough AND ma IS NOT NULL THEN p END AS p,
  CASE WHEN NOT enough THEN 'too few tasks' WHEN mb > ma AND p < 0.05 THEN 'positive' WHEN mb > ma THEN 'directional' ELSE 'null' END AS verdict FROM x""")
def pl5_screened_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stable tasks at least, as an experiment has a few suppliers only in small tables."""
    return rounded(experiments.screened_arms(line_runs(spark, sf_dir), "experiment", least=3))


@query("pl3_contested_matrix", f"""WITH {LINES_SQL}, c AS (SELECT * FROM r WHERE task % 5 < 3),
w AS (SELECT experiment, NULL::BIGINT AS family, count(DISTINCT task) AS n, avg(correct::INT) FILTER (arm = 'a') AS a, avg(correct::INT) FILTER (arm = 'fixed') AS f, avg(correct::INT) FILTER (arm = 'oracle') AS o FROM c GROUP BY experiment),
m AS (SELECT experiment, family, count(DISTINCT task) AS n, avg(correct::INT) FILTER (arm = 'a') AS a, avg(correct::INT) FILTER (arm = 'fixed') AS f, avg(correct::INT) FILTER (arm = 'oracle') AS o FROM c WHERE experiment IN (SELECT experiment FROM w WHERE a < 0.85) GROUP BY experiment, family),
u AS (SELECT experiment, family, n, a, CASE WHEN a < 0.85 THEN f END AS f, CASE WHEN a < 0.85 THEN o END AS o FROM w UNION ALL SELECT * FROM m)
SELECT experiment, family, n AS n_tasks, round(a, 6) AS a, round(f, 6) AS fixed, round(o, 6) AS oracle, round(CASE WHEN abs(o - a) >= 1e-9 THEN (f - a) / (o - a) END, 6) AS recovery FROM u""")
def pl3_contested_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = line_runs(spark, sf_dir)
    return rounded(experiments.contested_matrix(runs, "experiment", "family", runs.where("task % 5 < 3").select("experiment", "task")))


MODEL_TRIALS_SQL = """
raw_trials AS (
  SELECT o_orderstatus AS server, CASE WHEN o_orderkey % 2 = 0 THEN 'before' ELSE 'after' END AS arm, left(o_orderpriority, 1) || '::' || (o_custkey % 40) AS task,
         CASE WHEN o_custkey % 7 <> 0 THEN left(o_orderpriority, 1) || '::' || (o_custkey % 40) END AS selected, (o_orderkey % 11) / 10.0 + CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 0.05 END AS cs, o_orderkey AS trial FROM orders),
trials AS (
  SELECT *, coalesce(selected = task, false) AS correct, CASE WHEN selected = task THEN cs END AS argument_score,
         CASE WHEN selected = task THEN cs ELSE 0.0 END AS joint FROM raw_trials)
"""


@query("pl12_pooled_by_model", f"""WITH d AS ({server_diff_sql(MODEL_TRIALS_SQL, 0.05, 2000)}), {MODEL_TRIALS_SQL},
k AS (SELECT server, avg(joint) FILTER (arm = 'before') AS b, avg(joint) FILTER (arm = 'after') AS a FROM trials GROUP BY server),
u AS (SELECT server, count(*) FILTER (arms = 1) AS n FROM (SELECT server, task, count(DISTINCT arm) AS arms FROM trials GROUP BY server, task) GROUP BY server)
SELECT d.server AS model, d.* EXCLUDE (server), round(k.b, 6) AS before_rate, round(k.a, 6) AS after_rate, u.n AS n_unmatched FROM d JOIN k ON k.server = d.server JOIN u ON u.server = d.server""")
def pl12_pooled_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recorded runs: the status is the model, the priority the fixture, sets of customers the tasks."""
    o, even = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 0
    task = (F.col("o_custkey") % 40).cast("string")
    records = o.select(
        F.col("o_orderstatus").alias("model"), F.substring("o_orderpriority", 1, 1).alias("fixture"), F.when(even, "bad").otherwise("fixed").alias("variant"), task.alias("task"),
        F.lit("tool").alias("tool"), F.when(F.col("o_custkey") % 7 != 0, "tool").otherwise("other").alias("selected"), ((F.col("o_orderkey") % 11) / 10.0 + F.when(even, 0.0).otherwise(0.05)).alias("cs"),
    )
    return rounded(experiments.pooled_by_model(records))


@query("pl16_baseline_rate", "SELECT count(*) AS n, round(avg(value), 6) AS mean_rate FROM events WHERE event_type <> 'error'")
def pl16_baseline_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "error").alias("error"), F.col("value").alias("task_success_rate"))
    return rounded(experiments.baseline_rate(log))


@query("fn16_comparative_claims", """WITH n AS (SELECT lang, list(DISTINCT source) AS names FROM documents GROUP BY lang),
d AS (SELECT doc_id, d.lang, CASE doc_id % 4 WHEN 0 THEN 'Unlike ' || source || ' it ' WHEN 1 THEN 'While  other, ' WHEN 2 THEN 'as ' || source || ' does ' ELSE 'x compared to ' || upper(source) || '_v2 ' END || left(text, 50) AS text, names FROM documents d JOIN n ON n.lang = d.lang)
SELECT doc_id, len(list_filter(names, lambda s: regexp_matches(text, '(?i)\\b(?:unlike|whereas|while|compared to)\\s+' || regexp_escape(s)))) > 0 AS claims FROM d""")
def fn16_comparative_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that set their text against a source of their language by name."""
    d = table(spark, sf_dir, "documents")
    names = d.groupBy("lang").agg(F.collect_set("source").alias("names"))  # sources, not rows
    k = F.col("doc_id") % 4
    head = F.when(k == 0, F.concat(F.lit("Unlike "), "source", F.lit(" it "))).when(k == 1, "While  other, ").when(k == 2, F.concat(F.lit("as "), "source", F.lit(" does "))).otherwise(F.concat(F.lit("x compared to "), F.upper("source"), F.lit("_v2 ")))
    return d.join(F.broadcast(names), "lang").select("doc_id", experiments.claims_against(F.concat(head, F.substring("text", 1, 50)), F.col("names")).alias("claims"))
