"""Queries: the audit over tables seen as tasks, tools and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, trials
from ..sources.tables import EVENT_TRIALS_SQL, event_trials, table
from .registry import query


@query("au1_leaked_names", """SELECT 'leaked_name' AS "check", 'block' AS severity, conv_id || '/' || turn AS subject, role AS detail FROM conversations WHERE role <> '' AND contains(lower(text), lower(role))""")
def au1_leaked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    return audit.leaked_names(c, "role", "text", "id")


@query("au2_missing_params", """WITH s AS (SELECT DISTINCT p_brand AS tool, p_name AS param FROM part WHERE p_size > 20), c AS (SELECT DISTINCT p_brand AS tool, p_name AS param FROM part WHERE p_size <= 10 OR p_partkey % 97 = 0)
SELECT 'missing_param' AS "check", 'block' AS severity, tool AS subject, param AS detail FROM c WHERE tool IN (SELECT tool FROM s) AND (tool, param) NOT IN (SELECT tool, param FROM s)""")
def au2_missing_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tool"), F.col("p_name").alias("param"), "p_size", "p_partkey")
    return audit.missing_params(p.where("p_size <= 10 or p_partkey % 97 = 0"), p.where("p_size > 20").distinct())


@query("au4_extreme_rates", f"""WITH {EVENT_TRIALS_SQL}, r AS (SELECT task || '/' || (trial % 16) AS task, count(*) AS n, avg(CASE WHEN cs > 0.7 AND correct THEN 1.0 ELSE 0.0 END) AS joint_rate FROM trials WHERE server = 'all' GROUP BY task || '/' || (trial % 16))
SELECT 'extreme_rate' AS "check", 'warn' AS severity, task AS subject, round(joint_rate, 6)::DECIMAL(12,6)::VARCHAR AS detail FROM r WHERE joint_rate <= 0.05 OR joint_rate >= 0.95""")
def au4_extreme_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials.with_outcomes(event_trials(spark, sf_dir)).where("server = 'all'").withColumn("task", F.concat_ws("/", "task", F.col("trial") % 16))
    r = t.groupBy("task").agg(F.count("*").alias("n"), F.avg(F.when((F.col("cs") > 0.7) & F.col("correct"), 1.0).otherwise(0.0)).alias("joint_rate"))
    return audit.extreme_rates(r, "task")


@query("au5_no_variance", """WITH g AS (SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY o_custkey)
SELECT 'no_variance' AS "check", 'block' AS severity, o_custkey::VARCHAR AS subject, n::VARCHAR AS detail FROM g WHERE n >= 2 AND lo = hi""")
def au5_no_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.no_variance(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


@query("au6_blank_texts", """SELECT 'blank_text' AS "check", 'block' AS severity, doc_id::VARCHAR AS subject, '' AS detail FROM documents WHERE text IS NULL OR trim(text) = ''""")
def au6_blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.blank_texts(table(spark, sf_dir, "documents"), "text", "doc_id")


TOOLS_SQL = "tools AS (SELECT p_brand || '/' || p_type AS tool, CASE WHEN min(p_size) > 5 THEN '' ELSE min(p_name) END AS description, count(*) FILTER (p_size > 45) AS n_params FROM part GROUP BY p_brand, p_type), tasks AS (SELECT DISTINCT p_brand || '/' || p_type AS tool FROM part WHERE p_retailprice > 950)"


@query("au7_bare_tools", f"""WITH {TOOLS_SQL} SELECT 'no_description' AS "check", 'warn' AS severity, tool AS subject, '' AS detail FROM tools SEMI JOIN tasks USING (tool) WHERE trim(description) = ''
UNION ALL SELECT 'no_params', 'warn', tool, '' FROM tools SEMI JOIN tasks USING (tool) WHERE n_params = 0""")
def au7_bare_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("tool", F.concat_ws("/", "p_brand", "p_type"))
    tools = p.groupBy("tool").agg(F.when(F.min("p_size") > 5, "").otherwise(F.min("p_name")).alias("description"), F.count_if(F.col("p_size") > 45).alias("n_params"))
    return audit.bare_tools(tools, p.where("p_retailprice > 950").select("tool"))


@query("au8_catalog_size", """WITH s AS (SELECT p_brand, count(*) FILTER (p_size < 12) AS b, count(*) FILTER (p_size >= 12) AS a FROM part GROUP BY p_brand)
SELECT 'catalog_size' AS "check", 'warn' AS severity, p_brand AS subject, b || '/' || a AS detail FROM s WHERE least(a, b)::DOUBLE / nullif(greatest(a, b), 0) < 0.5""")
def au8_catalog_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") < 12).alias("n_before"), F.count_if(F.col("p_size") >= 12).alias("n_after"))
    return audit.shrunk_catalog(s, "p_brand")


@query("au9_standing_out", """WITH c AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1 AS truth FROM part),
r AS (SELECT truth, (rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY p_brand) - 1, 0) AS f FROM c),
g AS (SELECT count(*) AS n, avg(f) AS m FROM r WHERE truth AND f IS NOT NULL)
SELECT 'standing_out' AS "check", 'block' AS severity, 'all' AS subject, round(m, 4)::DECIMAL(12,4)::VARCHAR AS detail FROM g WHERE n >= 20 AND abs(m - 0.5) > 0.15""")
def au9_standing_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")) == 1
    return audit.standing_out(table(spark, sf_dir, "part").withColumn("truth", first), "p_brand", "p_size", "truth")


@query("au11_report", """WITH f AS (SELECT 'block' AS severity FROM documents WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT 'block' FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 2 AND min(o_orderstatus) = max(o_orderstatus))
UNION ALL SELECT 'warn' FROM (SELECT count(*) FILTER (p_size < 12) AS b, count(*) FILTER (p_size >= 12) AS a FROM part GROUP BY p_brand) WHERE least(a, b)::DOUBLE / nullif(greatest(a, b), 0) < 0.5)
SELECT count(*) FILTER (severity = 'block') = 0 AS passed, count(*) FILTER (severity = 'block') AS n_block, count(*) FILTER (severity = 'warn') AS n_warn FROM f""")
def au11_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.passed(audit.report(au6_blank_texts(spark, sf_dir), au5_no_variance(spark, sf_dir), au8_catalog_size(spark, sf_dir)))
