"""Queries: logs, cost and priority merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records
from ..sources.tables import table
from .registry import query, rounded


@query("src5_compacted_log", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def src5_compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return records.compacted(e, "user_id", "event_id")


@query("src6_checkpoint_keys", "SELECT DISTINCT user_id, event_type FROM events")
def src6_checkpoint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()


@query("src4_resume_set", "SELECT user_id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def src4_resume_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.when(F.col("event_type") == "error", "error").alias("error"))
    return records.finished(log).withColumnRenamed("name", "user_id")


@query("src19_priority_union", """WITH u AS (SELECT c_nationkey AS k, c_name AS name, 0 AS p FROM customer UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier)
SELECT k, name, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, name) AS r FROM u) WHERE r = 1""")
def src19_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists under one key; the first list wins, within it the least name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit(0).alias("p"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit(1).alias("p"))
    return records.first_of(c.unionByName(s), "k", "p", "name")


@query("ag47_cost", """WITH r AS (SELECT * FROM (VALUES ('A', 3.0, 15.0), ('R', 0.5, 1.5)) AS v(model, i, o))
SELECT l_returnflag AS model, sum(l_quantity) AS tokens_in, sum(l_linenumber)::BIGINT AS tokens_out, round(sum((l_quantity * coalesce(i, 1.0) + l_linenumber * coalesce(o, 2.0)) / 1e6), 6) AS cost FROM lineitem LEFT JOIN r ON model = l_returnflag GROUP BY l_returnflag""")
def ag47_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([("A", 3.0, 15.0), ("R", 0.5, 1.5)], "model string, rate_in double, rate_out double")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("tokens_in"), F.col("l_linenumber").alias("tokens_out"))
    return rounded(records.cost(calls, rates, (1.0, 2.0)))


@query("jn13_replay", """SELECT l_orderkey, l_linenumber, o_orderstatus AS response FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def jn13_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call finds its recorded answer, or the job fails."""
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("key"))
    tape = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("response"))
    return records.replayed(calls, tape).select("l_orderkey", "l_linenumber", "response")


@query("st7_same_names", """SELECT p_type, count(DISTINCT p_name) AS n_before, (SELECT count(DISTINCT p_name) FROM part) - count(DISTINCT p_name) AS n_missing FROM part GROUP BY p_type""")
def st7_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type how many of all names it lacks; arms with different names must not be compared."""
    p = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    every = p.select("p_name").distinct().agg(F.count("*").alias("all"))
    return p.groupBy("p_type").agg(F.count("*").alias("n_before")).crossJoin(F.broadcast(every)).select("p_type", "n_before", (F.col("all") - F.col("n_before")).alias("n_missing"))
