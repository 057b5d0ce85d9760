"""Queries: replay files, study logs and corpora written and read again, benchmark defects and decoys, hints, pooled rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linting, ranks, trials
from ..operators.power import clamped
from ..sources import records
from ..sources.shared import Steps
from ..sources.tables import EVENT_TRIALS_SQL, LINE_TRIALS_SQL, event_trials, line_trials, table
from .lint_queries import TOOLS_SQL, tools
from .registry import query, rounded


@query("src1_replay_trials", """SELECT event_type AS task, CASE WHEN event_id % 5 <> 0 THEN props END AS selected, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE round(value, 3) END AS cs FROM events""")
def src1_replay_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a replay file that lacks some selections and some scores, written and read again."""
    at = Steps(spark, "replay").place("trials")
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("task_tool_name"), F.when(k % 5 != 0, F.col("props")).alias("selected_tool"), F.when(k % 7 != 0, F.round("value", 3)).alias("constraint_satisfaction"))
    e.write.json(at)  # null fields are left out of the file
    return records.read_replay(spark, at, whole_files=False)


def order_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a study log: their lines are the runs; cancelled ones have an error."""
    li = table(spark, sf_dir, "lineitem")
    run = F.struct(
        F.concat(F.lit("t"), F.col("l_suppkey") % 3).alias("task_tool_name"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("t"), F.col("l_suppkey") % 3)).alias("selected_tool"), F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("parse_failed"), F.round(F.col("l_discount") * 10, 3).alias("constraint_satisfaction"),
    )
    runs = li.groupBy("l_orderkey").agg(F.collect_list(run).alias("run_results"))
    o = table(spark, sf_dir, "orders")
    scores = F.create_map(F.lit("robustness"), F.round(F.col("o_totalprice") % 100, 3), F.lit("discoverability"), F.when(F.col("o_custkey") % 4 != 0, F.round(F.col("o_totalprice") % 90, 3)))
    return o.join(runs, o.o_orderkey == runs.l_orderkey).select(
        F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("tier"), F.round(F.col("o_totalprice") % 1, 3).alias("task_success_rate"), scores.alias("dimension_scores"), "run_results",
        F.when(F.col("o_orderstatus") == "P", "cancelled").alias("error"), F.col("o_orderkey").alias("seq"),
    )


def written_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Steps(spark, "study").place("log")
    order_study(spark, sf_dir).write.json(at)
    return records.read_study(spark, at)


STUDY_SQL = """l AS (SELECT l_orderkey::VARCHAR AS name, 't' || l_suppkey % 3 AS task, l_returnflag <> 'R' AS ok, round(l_discount * 10, 3) AS cs FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P')"""


@query("src8_task_pools", f"WITH {STUDY_SQL} SELECT name, task, count(*) AS n FROM l GROUP BY name, task HAVING count(*) >= 2")
def src8_task_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.pools(written_study(spark, sf_dir))


@query("src9_set_pools", f"WITH {STUDY_SQL} SELECT name, count(*) AS n, round(avg(CASE WHEN ok THEN cs ELSE 0.0 END), 6) AS joint FROM l GROUP BY name HAVING count(*) >= 4")
def src9_set_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.pools_by_set(written_study(spark, sf_dir)))


@query("prj18_fields", """SELECT o_orderkey::VARCHAR AS name, round(o_totalprice % 1, 3) AS task_success_rate, round(o_totalprice % 100, 3) AS robustness, CASE WHEN o_custkey % 4 <> 0 THEN round(o_totalprice % 90, 3) END AS discoverability, NULL::DOUBLE AS overall_score, NULL::DOUBLE AS docs_manifest
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def prj18_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = written_study(spark, sf_dir)
    return log.select("name", *[records.field(log, f).alias(f) for f in ("task_success_rate", "robustness", "discoverability", "overall_score", "docs_manifest")])


@query("src11_clean_catalogs", """WITH c AS (SELECT p_size % 4 AS tier, p_name AS position, list_sort(list(DISTINCT p_type)) AS names FROM part GROUP BY p_size % 4, p_name)
SELECT tier::VARCHAR AS tier, min(position) AS position, names FROM c WHERE tier IN (1, 2) GROUP BY tier, names""")
def src11_clean_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of two tiers; of those with the same names in a tier, the first."""
    c = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 4).cast("string").alias("tier"), F.col("p_name").alias("position")).agg(F.array_sort(F.collect_set("p_type")).alias("names"))
    return records.distinct_catalogs(c, tiers=["1", "2"])


@query("prj13_clamped", "SELECT o_orderkey, round(least(1.0, greatest(0.0, o_totalprice / 177777 - 0.5)), 6) AS share FROM orders")
def prj13_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", clamped(F.col("o_totalprice") / 177777 - 0.5).alias("share")))


@query("prj14_effect_labels", """SELECT l_suppkey, round(corr(l_quantity, l_discount), 6) AS rho, CASE WHEN corr(l_quantity, l_discount) IS NULL OR isnan(corr(l_quantity, l_discount)) THEN NULL WHEN abs(round(corr(l_quantity, l_discount), 6)) > 0.5 THEN 'large' WHEN abs(round(corr(l_quantity, l_discount), 6)) > 0.3 THEN 'medium'
  WHEN abs(round(corr(l_quantity, l_discount), 6)) > 0.1 THEN 'small' ELSE 'negligible' END AS strength FROM lineitem GROUP BY l_suppkey""")
def prj14_effect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How quantity and discount go together for each supplier, and how strong that is called."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(ranks.correlation("l_quantity", "l_discount"), 6).alias("rho"))
    return r.withColumn("strength", ranks.strength(F.col("rho")))


@query("pl11_pooled_rates", f"""WITH e AS (WITH {EVENT_TRIALS_SQL} SELECT 'events' AS model, arm, correct, argument_score, joint FROM trials), l AS (WITH {LINE_TRIALS_SQL} SELECT 'lines' AS model, arm, correct, argument_score, joint FROM trials),
r AS (SELECT model, arm, count(*) AS n, avg(correct::INT) AS s, avg(argument_score) AS g, avg(joint) AS j FROM (FROM e UNION ALL FROM l) GROUP BY model, arm)
SELECT model, arm, n, round(s, 6) AS selection_accuracy, round(g, 6) AS argument_accuracy, round(j, 6) AS joint_rate, round(max(j) FILTER (arm = 'after') OVER w - max(j) FILTER (arm = 'before') OVER w, 6) AS joint_delta FROM r WINDOW w AS (PARTITION BY model)""")
def pl11_pooled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposed rates of two models over all their servers, before and after, and what the joint rate gained."""
    pool = lambda t, model: t.select(F.lit(model).alias("model"), "arm", "task", "selected", "cs")
    r = trials.decomposed_rate(pool(event_trials(spark, sf_dir), "events").unionByName(pool(line_trials(spark, sf_dir), "lines")), "model", "arm")
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("joint_rate")))
    gain = r.groupBy("model").agg((side("after") - side("before")).alias("joint_delta"))
    return rounded(r.join(gain, "model"))


@query("mu8_eligible_culprits", f"WITH {TOOLS_SQL} SELECT DISTINCT server, tool FROM props WHERE kind = 'string'")
def mu8_eligible_culprits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linting.eligible_culprits(tools(spark, sf_dir)).select("server", "tool")


FIRST_STRING_SQL = "fs AS (SELECT server, tool, any_value(description) AS description, min(param) FILTER (kind = 'string') AS first FROM props GROUP BY server, tool)"


@query("mu6_camouflaged_defects", f"""WITH {TOOLS_SQL}, {FIRST_STRING_SQL} SELECT server, tool, CASE WHEN first IS NULL THEN description ELSE description || ' Set ' || first || ' to true/false as needed. Note.' END AS description, first IS NOT NULL AS changed FROM fs""")
def mu6_camouflaged_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tools(spark, sf_dir)
    bad = linting.camouflaged_defect(clean, linting.SUFFIXES["small"])
    changed = bad.join(linting.eligible_culprits(clean).select("server", "tool", F.lit(True).alias("changed")), ["server", "tool"], "left")
    return changed.select("server", "tool", "description", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("mu7_decoys", f"""WITH {TOOLS_SQL} SELECT server, tool, description || ' This value is supplied by the caller. This tool is part of the standard workflow for this service.' AS description FROM t""")
def mu7_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linting.decoy(tools(spark, sf_dir), "medium").select("server", "tool", "description")


@query("tk10_first_hints", """WITH h AS (SELECT p_brand AS server, p_size % 8 AS dim_at, p_partkey AS hint_at, p_type AS dim, p_name AS hint FROM part WHERE p_size % 8 <> 3)
SELECT server, row_number() OVER (PARTITION BY server ORDER BY dim_at, hint_at)::INTEGER AS place, dim, hint FROM h QUALIFY place <= 10""")
def tk10_first_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as hints of eight dimensions, one of which is not implemented."""
    d = F.col("p_size") % 8
    h = table(spark, sf_dir, "part").select(F.col("p_brand").alias("server"), d.alias("dim_at"), F.col("p_partkey").alias("hint_at"), F.col("p_type").alias("dim"), F.col("p_name").alias("hint"), F.when(d == 3, False).alias("implemented"))
    return linting.first_hints(h)
