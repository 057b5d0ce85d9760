"""Queries: outcomes of runs made from events, arms against each other, answers in JSON, probes from schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import outcomes, paired, probes, ranks, resample, rng, trials
from ..sources.tables import EVENT_TRIALS_SQL, event_trials, table
from .comparison import DELTAS_SQL, PAIRS_SQL, T_SQL, replicates_sql
from .lint_queries import TOOLS_SQL, tools
from .registry import query, rounded

KNOWN = ("click", "view", "purchase", "signup")
DESTRUCTIVE = ("purchase", "signup")
#: A run is an event: the user's tool is right, the answer names the event's type in one of several forms.
RUNS_SQL = """runs AS (
  SELECT event_id, user_id % 10 AS server, user_id AS task, event_id // 3 AS trial, ['a', 'b', 'a_noise'][(event_id % 3)::INT + 1] AS arm, ['click', 'view', 'purchase'][(user_id % 3)::INT + 1] AS gold,
         event_type AS selected, value <= 20 AS success,
         CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN ' ' || upper(event_type) || ' ' WHEN 2 THEN event_type || '!, please' WHEN 3 THEN '  ' END AS answer FROM events)"""
LOOSE = "CASE WHEN lower(trim(answer)) = gold THEN 'correct' WHEN lower(trim(answer)) IN ('click', 'view', 'purchase', 'signup') THEN 'wrong' ELSE 'abstained' END"
STRICT = "CASE WHEN coalesce(w NOT IN ('click', 'view', 'purchase', 'signup'), true) THEN 'abstained' WHEN w = gold THEN 'correct' ELSE 'wrong' END"
ANSWERED_SQL = f"{RUNS_SQL}, o AS (SELECT *, {STRICT} AS outcome FROM (SELECT *, rtrim(string_split(trim(answer), ' ')[1], '.,;:!?') AS w FROM runs))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    answer = F.when(k % 5 == 0, kind).when(k % 5 == 1, F.concat(F.lit(" "), F.upper(kind), F.lit(" "))).when(k % 5 == 2, F.concat(kind, F.lit("!, please"))).when(k % 5 == 3, F.lit("  "))
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), at.cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", (user % 10).alias("server"), user.alias("task"), F.floor(k / 3).alias("trial"), pick(("a", "b", "a_noise"), k % 3).alias("arm"),
        pick(("click", "view", "purchase"), user % 3).alias("gold"), kind.alias("selected"), (F.col("value") <= 20).alias("success"), answer.alias("answer"),
    )


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).withColumn("outcome", outcomes.strict_outcome(F.col("answer"), F.col("gold"), KNOWN))


@query("prj11_loose_outcomes", f"WITH {RUNS_SQL} SELECT event_id, {LOOSE} AS outcome FROM runs")
def prj11_loose_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("event_id", outcomes.loose_outcome(F.col("answer"), F.col("gold"), KNOWN).alias("outcome"))


@query("prj12_strict_outcomes", f"WITH {ANSWERED_SQL} SELECT event_id, outcome FROM o")
def prj12_strict_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("event_id", "outcome")


@query("ag4_selection_accuracy", f"WITH {RUNS_SQL} SELECT server, arm, round_even(100.0 * avg((selected = gold)::INT), 1) AS selection_accuracy FROM runs GROUP BY server, arm")
def ag4_selection_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.percentages(runs(spark, sf_dir), "server", "arm").drop("call_correctness")


@query("ag5_call_correctness", f"WITH {RUNS_SQL} SELECT server, arm, round_even(100.0 * avg(success::INT), 1) AS call_correctness FROM runs GROUP BY server, arm")
def ag5_call_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.percentages(runs(spark, sf_dir), "server", "arm").drop("selection_accuracy")


@query("ag16_parse_failed", f"WITH {RUNS_SQL} SELECT server, arm, count(*) FILTER (coalesce(answer NOT IN ('click', 'view', 'purchase', 'signup'), true)) AS parse_failed FROM runs GROUP BY server, arm")
def ag16_parse_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = spark.createDataFrame([(k,) for k in KNOWN], "selected string")
    return outcomes.parse_failed(runs(spark, sf_dir).withColumn("selected", F.col("answer")), valid, "server", "arm")


@query("ag19_task_accuracy", f"WITH {RUNS_SQL} SELECT arm, task, round(avg((answer IS NOT NULL AND answer = gold)::INT), 6) AS accuracy FROM runs GROUP BY arm, task")
def ag19_task_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that could not be read count as wrong."""
    return rounded(runs(spark, sf_dir).groupBy("arm", "task").agg(F.avg(F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).cast("int")).alias("accuracy")))


@query("ag20_constraint_accuracy", f"WITH {EVENT_TRIALS_SQL} SELECT server, arm, task, round(avg((correct AND cs >= 1)::INT), 6) AS accuracy FROM trials GROUP BY server, arm, task")
def ag20_constraint_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right tool with every constraint satisfied."""
    right = F.coalesce((F.col("selected") == F.col("task")) & (F.col("cs") >= 1), F.lit(False))
    return rounded(event_trials(spark, sf_dir).groupBy("server", "arm", "task").agg(F.avg(right.cast("int")).alias("accuracy")))


COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in (outcomes.CORRECT, outcomes.WRONG, outcomes.ABSTAINED))


@query("ag21_outcome_counts", f"WITH {ANSWERED_SQL} SELECT arm, {COUNTS} FROM o GROUP BY arm")
def ag21_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.outcome_counts(answered(spark, sf_dir), "arm")


@query("ag22_task_correct_rate", f"WITH {ANSWERED_SQL} SELECT arm, task, round(avg((outcome = 'correct')::INT), 6) AS rate FROM o GROUP BY arm, task")
def ag22_task_correct_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(answered(spark, sf_dir).groupBy("arm", "task").agg(F.avg((F.col("outcome") == "correct").cast("int")).alias("rate")))


ANSWERED_SELECT = "count(*) FILTER (outcome = 'correct') AS n_correct, count(*) FILTER (outcome <> 'abstained') AS n_answered, round(coalesce(count(*) FILTER (outcome = 'correct') / nullif(count(*) FILTER (outcome <> 'abstained'), 0), 0), 6) AS accuracy"


@query("ag23_answered_accuracy", f"WITH {ANSWERED_SQL} SELECT arm, server, {ANSWERED_SELECT} FROM o GROUP BY arm, server")
def ag23_answered_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.answered_accuracy(answered(spark, sf_dir), "arm", "server"))


@query("ag24_family_accuracy", f"WITH {ANSWERED_SQL} SELECT arm, {ANSWERED_SELECT} FROM o WHERE gold IN ('view', 'purchase') AND gold IN ('click', 'view') GROUP BY arm")
def ag24_family_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools of a family that are contested: both lists meet the runs in semi joins."""
    of = lambda names: spark.createDataFrame([(n,) for n in names], "gold string")
    kept = answered(spark, sf_dir).join(of(("view", "purchase")), "gold", "left_semi").join(of(("click", "view")), "gold", "left_semi")
    return rounded(outcomes.answered_accuracy(kept, "arm"))


@query("ag25_wrong_destructive", f"""WITH {RUNS_SQL} SELECT arm, server, count(*) FILTER (selected IN ('purchase', 'signup')) AS n_wrong, count(*) AS n_answered, round(count(*) FILTER (selected IN ('purchase', 'signup')) / count(*), 6) AS rate
FROM runs WHERE gold NOT IN ('purchase', 'signup') AND selected IN ('click', 'view', 'purchase', 'signup') GROUP BY arm, server""")
def ag25_wrong_destructive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.wrong_destructive(runs(spark, sf_dir), DESTRUCTIVE, KNOWN, "arm", "server"))


@query("ag26_decomposed", f"""WITH {EVENT_TRIALS_SQL} SELECT server, arm, count(*) AS n, count(*) FILTER (correct) AS n_right_tool, round(avg((NOT correct)::INT), 6) AS wrong_tool_rate,
  round(avg(argument_score), 6) AS argument_score FROM trials GROUP BY server, arm""")
def ag26_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.decomposed(event_trials(spark, sf_dir), "server", "arm"))


@query("ag28_regime_counts", """WITH r AS (SELECT l_suppkey % 20 AS family, l_suppkey AS task, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS arm, l_returnflag <> 'N' AS valid, l_discount < CASE WHEN l_linenumber % 2 = 0 THEN 0.021 + (l_suppkey % 20) * 0.005 ELSE 0.2 END AS correct FROM lineitem),
t AS (SELECT family, task, arm, coalesce(count(*) FILTER (valid AND correct)::DOUBLE / nullif(count(*) FILTER (valid), 0), 0.0) AS acc FROM r GROUP BY family, task, arm),
b AS (SELECT family, task, max(acc) FILTER (arm = 'a') AS a, max(acc) FILTER (arm = 'b') AS b FROM t GROUP BY family, task),
g AS (SELECT family, avg(a) >= 0.85 AS aborted, NOT avg(a) >= 0.85 AND coalesce(bool_or(a < 1 AND b = 1), false) AS in_regime FROM b GROUP BY family)
SELECT family % 4 AS server, count(*) AS n_families, count(*) FILTER (in_regime AND NOT aborted) AS n_in, count(*) FILTER (NOT in_regime AND NOT aborted) AS n_out, count(*) FILTER (aborted) AS n_aborted, bool_or(in_regime AND NOT aborted) AS in_regime FROM g GROUP BY 1""")
def ag28_regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, family = F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") % 20
    r = table(spark, sf_dir, "lineitem").select(family.alias("family"), F.col("l_suppkey").alias("task"), F.when(even, "a").otherwise("b").alias("arm"), (F.col("l_returnflag") != "N").alias("valid"), (F.col("l_discount") < F.when(even, 0.021 + family * 0.005).otherwise(0.2)).alias("correct"))
    inside, aborted = F.col("in_regime"), F.col("aborted")
    g = paired.regime(r).groupBy((F.col("family") % 4).alias("server"))
    return g.agg(F.count("*").alias("n_families"), F.count_if(inside & ~aborted).alias("n_in"), F.count_if(~inside & ~aborted).alias("n_out"), F.count_if(aborted).alias("n_aborted"), F.bool_or(inside & ~aborted).alias("in_regime"))


def _mcnemar_sql(name: str, x: str, y: str) -> str:
    """Tables ``m_name`` and ``t_name``: McNemar's counts and verdict of two conditions on the rows x and y."""
    return f"""m_{name} AS (SELECT x.server, count(*) FILTER ({x} AND NOT {y}) AS b, count(*) FILTER (NOT {x} AND {y}) AS c FROM runs x JOIN runs y ON x.server = y.server AND x.task = y.task AND x.trial = y.trial AND x.arm = 'a' AND y.arm = 'b' GROUP BY x.server),
s_{name} AS (SELECT *, round(CASE WHEN b + c = 0 THEN 0.0 WHEN b + c < 10 THEN (b - c)::DOUBLE ELSE (abs(b - c) - 1)::DOUBLE ** 2 / (b + c) END, 4) AS statistic FROM m_{name}),
t_{name} AS (SELECT *, CASE WHEN b + c < 10 THEN 'too_few' WHEN statistic > 3.841 THEN CASE WHEN b > c THEN 'a_better' ELSE 'b_better' END ELSE 'no_difference' END AS verdict FROM s_{name})"""


HT4_SQL = f"""WITH {RUNS_SQL}, p AS (SELECT server, arm, round_even(100.0 * avg((selected = gold)::INT), 1) AS s, round_even(100.0 * avg(success::INT), 1) AS c, count(*) AS n, list_sort(list(DISTINCT gold)) AS names FROM runs GROUP BY server, arm),
w AS (SELECT server, max(s) FILTER (arm = 'a') AS sa, max(s) FILTER (arm = 'b') AS sb, max(s) FILTER (arm = 'a_noise') AS sn, max(c) FILTER (arm = 'a') AS ca, max(c) FILTER (arm = 'b') AS cb, max(c) FILTER (arm = 'a_noise') AS cn,
  count(*) AS arms, min(n) AS least, max(n) AS most, max(names) FILTER (arm = 'a') AS na, max(names) FILTER (arm = 'b') AS nb FROM p GROUP BY server),
{_mcnemar_sql("s", "x.selected = x.gold", "y.selected = y.gold")}, {_mcnemar_sql("c", "x.success", "y.success")}
SELECT server, round_even(sb - sa, 1) AS selection_delta, round_even(cb - ca, 1) AS correctness_delta, round_even(abs(sn - sa), 1) AS selection_floor, round_even(abs(cn - ca), 1) AS correctness_floor,
  s.b AS selection_b, s.c AS selection_c, s.statistic AS selection_statistic, s.verdict AS selection_verdict, c.b AS correctness_b, c.c AS correctness_c, c.statistic AS correctness_statistic, c.verdict AS correctness_verdict,
  CASE WHEN arms < 3 THEN 'arm missing' WHEN na <> nb THEN 'names differ' WHEN least <> most THEN 'counts differ' END AS problem
FROM w LEFT JOIN t_s s USING (server) LEFT JOIN t_c c USING (server)"""


@query("ht4_paired_arms", HT4_SQL)
def ht4_paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every server, and what speaks against comparing its arms."""
    return outcomes.paired_arms(runs(spark, sf_dir))


@query("ag42_pooled_effect", f"""WITH {EVENT_TRIALS_SQL}, {PAIRS_SQL}, pooled AS (SELECT 'pooled' AS server, server AS of, server || ':' || task AS task, delta FROM pairs), {DELTAS_SQL.replace("FROM pairs", "FROM pooled")}, {replicates_sql('vals', 2000)},
p AS (SELECT count(*) AS m_tasks, count(DISTINCT of) AS n_tool_sets, avg(delta) AS mean_delta FROM pooled)
SELECT n_tool_sets, m_tasks, round(mean_delta, 6) AS mean_delta, round(mean_delta - CASE WHEN m_tasks > 30 THEN 1.959964 ELSE ({T_SQL})[greatest(m_tasks - 1, 1)::INT] END * se, 6) AS ci_lo,
  round(mean_delta + CASE WHEN m_tasks > 30 THEN 1.959964 ELSE ({T_SQL})[greatest(m_tasks - 1, 1)::INT] END * se, 6) AS ci_hi FROM p, ci WHERE m_tasks >= 2""")
def ag42_pooled_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference over all matched tasks of all servers, its interval by Student's t times the spread of replicates."""
    pairs = trials.matched(trials.paired(event_trials(spark, sf_dir)))
    pooled = pairs.select(F.lit("pooled").alias("server"), F.col("server").alias("of"), F.concat_ws(":", "server", "task").alias("task"), "delta")
    se = resample.spread(resample.replicate_means(trials.indexed(pooled, "delta", "task"), 2000))
    p = pooled.groupBy("server").agg(F.count_distinct("of").alias("n_tool_sets"), F.count("*").alias("m_tasks"), F.avg("delta").alias("mean_delta")).where("m_tasks >= 2")
    margin = resample.t_critical(F.col("m_tasks") - 1) * F.col("se")
    return rounded(p.join(se, "server").select("n_tool_sets", "m_tasks", "mean_delta", (F.col("mean_delta") - margin).alias("ci_lo"), (F.col("mean_delta") + margin).alias("ci_hi")))


@query("jn12_before_after", f"""WITH {EVENT_TRIALS_SQL}, {PAIRS_SQL}, one AS (SELECT server, round(before_mean, 9) AS before_mean, round(after_mean, 9) AS after_mean FROM pairs), two AS (FROM one UNION ALL SELECT 'pooled', before_mean, after_mean FROM one),
k AS (SELECT *, rank() OVER (PARTITION BY server ORDER BY before_mean) + (count(*) OVER (PARTITION BY server, before_mean) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY server ORDER BY after_mean) + (count(*) OVER (PARTITION BY server, after_mean) - 1) / 2.0 AS ry FROM two)
SELECT server, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(coalesce(corr(rx, ry), 0), 6) END AS spearman, CASE WHEN count(*) >= 3 THEN round(coalesce(corr(before_mean, after_mean), 0), 6) END AS pearson FROM k GROUP BY server""")
def jn12_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the task means of the arms go together, of each pair and of all pairs pooled; pairs of fewer than three shared tasks have their number only."""
    pairs = trials.matched(trials.paired(event_trials(spark, sf_dir)))
    pairs = pairs.select("server", F.round("before_mean", 9).alias("x"), F.round("after_mean", 9).alias("y"))  # ties do not hang on the order of sums
    pairs = pairs.unionByName(pairs.withColumn("server", F.lit("pooled")))
    a = ranks.spearman(pairs, "server").withColumnRenamed("r", "spearman")
    b = ranks.pearson(pairs, "server").select("server", F.col("r").alias("pearson"))
    enough = lambda c: F.when(F.col("n") >= 3, F.col(c)).alias(c)
    return rounded(a.join(b, "server").select("server", "n", enough("spearman"), enough("pearson")))


SPEARMAN_REPLICATES = 2000
BRANDS_SQL = "v AS (SELECT sum(p_size) AS x, min(p_partkey) % 7 AS y, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS n FROM part GROUP BY p_brand)"


@query("bs5_spearman_interval", f"""WITH {BRANDS_SQL},
d AS (SELECT r, least(floor({rng.uniform_sql('r * n + i + 1')} * n)::BIGINT, n - 1) AS at FROM v, range({SPEARMAN_REPLICATES}) AS g(r)),
s AS (SELECT r, x, y FROM d JOIN v ON v.i = d.at),
k AS (SELECT r, rank() OVER (PARTITION BY r ORDER BY x) + (count(*) OVER (PARTITION BY r, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY r ORDER BY y) + (count(*) OVER (PARTITION BY r, y) - 1) / 2.0 AS ry FROM s),
c AS (SELECT r, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS rho FROM k GROUP BY r)
SELECT round(quantile_cont(rho, 0.025), 4) AS ci_lo, round(quantile_cont(rho, 0.975), 4) AS ci_hi, count(*) FILTER (rho IS NULL) AS skipped FROM c""")
def bs5_spearman_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the rank correlation of two figures of the brands."""
    v = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("x"), (F.min("p_partkey") % 7).alias("y"))
    return resample.spearman_interval(v.withColumn("all", F.lit("all")), "all", "p_brand", SPEARMAN_REPLICATES).drop("all")


@query("fn20_json_answers", """WITH a AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Sure: ' || props || ' Done.' WHEN 3 THEN '[' || props || ', 1]' WHEN 4 THEN 'no' WHEN 5 THEN substr(props, 1, 5) ELSE '  ```' || chr(10) || props || ' ```  ' END AS r, props FROM events)
SELECT event_id, CASE WHEN event_id % 7 NOT IN (4, 5) THEN json_extract_string(props, '$.k')::BIGINT END AS k, event_id % 7 IN (4, 5) AS parse_failed FROM a""")
def fn20_json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare, fenced, among words, in a list (first to last brace), none, cut off."""
    p, m = F.col("props"), F.col("event_id") % 7
    r = F.when(m == 0, p).when(m == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(m == 2, F.concat(F.lit("Sure: "), p, F.lit(" Done."))).when(m == 3, F.concat(F.lit("["), p, F.lit(", 1]")))
    r = r.when(m == 4, "no").when(m == 5, F.substring(p, 1, 5)).otherwise(F.concat(F.lit("  ```\n"), p, F.lit(" ```  ")))
    e = table(spark, sf_dir, "events").withColumn("o", outcomes.json_object(r))
    return e.select("event_id", F.get_json_object("o", "$.k").cast("long").alias("k"), F.col("o").isNull().alias("parse_failed"))


@query("prj28_effect_errors", """WITH e AS (SELECT o_orderkey, (o_orderkey % 11) / 10.0 - 0.02 AS a, (o_orderkey % 13) / 12.0 + 0.02 AS b, o_orderkey % 9 AS n_contested, o_orderkey % 4 = 0 AS aborted, o_orderkey % 3 = 0 AS gated FROM orders)
SELECT o_orderkey, list_filter([CASE WHEN n_contested < 6 THEN 'few_contested' END, CASE WHEN NOT aborted AND NOT gated THEN 'no_headroom_not_aborted' END, CASE WHEN o_orderkey % 5 = 0 THEN 'effect_mismatch' END,
  CASE WHEN o_orderkey % 6 = 0 THEN 'counts_mismatch' END, CASE WHEN a < 0 OR a > 1 THEN 'arm_a_outside' END, CASE WHEN b < 0 OR b > 1 THEN 'arm_b_outside' END], lambda x: x IS NOT NULL) AS errors FROM e""")
def prj28_effect_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = (k % 11) / 10.0 - 0.02, (k % 13) / 12.0 + 0.02
    effect = (b - a) * 100 + F.when(k % 5 == 0, 0.1).otherwise(0.01)
    e = table(spark, sf_dir, "orders").select(
        "o_orderkey", a.alias("arm_a_accuracy"), b.alias("arm_b_accuracy"), effect.alias("effect_pp"), (k % 9).alias("n_contested"), (k % 4).alias("n_plus"), (k % 5).alias("n_minus"), (k % 3).alias("n_ties"),
        (k % 4 + k % 5 + k % 3 + (k % 6 == 0).cast("int")).alias("n_stable"), (k % 4 == 0).alias("aborted"), (k % 3 == 0).alias("headroom_gated"),
    )
    return outcomes.effect_errors(e).select("o_orderkey", "errors")


VALUE_SQL = "CASE WHEN size % 5 = 0 THEN '\"low\"' WHEN kind = 'boolean' THEN 'true' ELSE '\"example\"' END"


@query("prj20_task_texts", f"""WITH {TOOLS_SQL} SELECT server, tool, CASE WHEN any_value(description) = '' THEN 'Call the ''' || tool || ''' tool.' ELSE 'Call ''' || tool || ''': ' || any_value(description) END AS task,
  list(param || '=' || {VALUE_SQL} ORDER BY param) AS args FROM props GROUP BY server, tool""")
def prj20_task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task texts and (PRJ19) the sample values of all parameters."""
    return probes.tasks(tools(spark, sf_dir))


FIRST_SQL = "q AS (SELECT server, tool, min(param) AS any_param, min(param) FILTER (required) AS first, arg_min(kind, param) FILTER (required) AS kind, list(param ORDER BY param) AS params FROM props GROUP BY server, tool)"
WRONG_SQL = "'{\"' || first || '\": ' || CASE WHEN kind = 'boolean' THEN '[1, 2, 3]' ELSE '99999' END || '}'"


@query("prj22_error_probes", f"""WITH {TOOLS_SQL}, {FIRST_SQL} SELECT server, tool, 'missing_required' AS label, '{{}}' AS args FROM q WHERE first IS NOT NULL UNION ALL SELECT server, tool, 'wrong_type_' || first, {WRONG_SQL} FROM q WHERE first IS NOT NULL
UNION ALL SELECT server, tool, 'unknown_param', '{{"__bad_field__": true}}' FROM q WHERE first IS NULL""")
def prj22_error_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.error_probes(tools(spark, sf_dir))


@query("prj23_robustness_probes", f"""WITH {TOOLS_SQL}, {FIRST_SQL} SELECT server, tool, 'null_value' AS label, '{{"' || coalesce(first, any_param) || '": null}}' AS args FROM q UNION ALL SELECT server, tool, 'extra_fields', '{{"__unknown_field__": "unexpected_value"}}' FROM q
UNION ALL SELECT server, tool, CASE WHEN first IS NULL THEN 'all_nulls' ELSE 'wrong_type_' || first END, CASE WHEN first IS NULL THEN '{{' || array_to_string(list_transform(params, lambda x: '"' || x || '": null'), ', ') || '}}' ELSE {WRONG_SQL} END FROM q""")
def prj23_robustness_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.robustness_probes(tools(spark, sf_dir))


@query("prj24_named_tools", f"WITH {TOOLS_SQL} SELECT server, tool, description FROM t WHERE tool IN (SELECT replace(min(p_name), ' ', '_') FROM part GROUP BY p_type)")
def prj24_named_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_type").agg(F.replace(F.min("p_name"), F.lit(" "), F.lit("_")).alias("tool")).select("tool").distinct()
    return tools(spark, sf_dir).select("server", "tool", "description").join(names, "tool", "left_semi")


@query("prj25_guarded_required", f"""WITH {TOOLS_SQL} SELECT server, tool, coalesce(list(param ORDER BY param) FILTER (required AND size % 7 <> 0), []) AS guarded,
  coalesce(list(param ORDER BY param) FILTER (size % 7 = 0 OR required), []) AS merged FROM props GROUP BY server, tool""")
def prj25_guarded_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required parameters without a default, and (ST4) the union of all required with those that have one."""
    t = tools(spark, sf_dir)
    optional = F.transform(F.filter("props", lambda p: p["has_default"]), lambda p: p["name"])
    return t.select("server", "tool", probes.guarded_required(F.col("required"), F.col("props")).alias("guarded"), probes.merged_required(F.col("required"), optional).alias("merged"))


GENERIC = ", ".join(f"'{w}'" for w in probes.GENERIC_TOKENS)


@query("fn14_grounding", f"""WITH n AS (SELECT p_partkey, ['get', 'x', 'fetchData', 'useOf'][(p_partkey % 4)::INT + 1] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' || replace(p_name, ' ', '_') END AS name FROM part),
g AS (SELECT p_partkey, name, len(list_filter(string_split(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '_'), lambda w: length(w) > 1 AND w NOT IN ({GENERIC})))::INT AS n_tokens FROM n) SELECT *, n_tokens = 0 AS low_grounding FROM g""")
def fn14_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telling words of names, and (FN15) whether there are none."""
    k = F.col("p_partkey")
    head = F.get(F.array(*map(F.lit, ("get", "x", "fetchData", "useOf"))), (k % 4).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(head, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))))).alias("name"))
    return p.withColumn("n_tokens", probes.grounding_tokens(F.col("name"))).withColumn("low_grounding", F.col("n_tokens") == 0)


@query("fn35_json_types", """SELECT event_id, ['string', 'integer', 'array', 'object', 'string', 'number', 'boolean'][(event_id % 7)::INT + 1] AS json_type FROM events""")
def fn35_json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ("str", "int", "list[int]", " dict [str, list[int]]", "Path", "float", "bool ")
    return table(spark, sf_dir, "events").select("event_id", probes.json_type(F.get(F.array(*map(F.lit, forms)), (F.col("event_id") % 7).cast("int"))).alias("json_type"))


@query("wn12_first_tasks", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def wn12_first_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three tasks of each tool in the order of the fixture."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").withColumn("_r", place).where("_r <= 3").drop("_r")
