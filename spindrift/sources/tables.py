"""The test tables seen as the records of an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Test events before this time are the arm before the change.
CHANGE = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of ``events``: server all, one of ten sets of users, and two with a planted drop and gain after the change."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1)
    share = (F.col("value") <= 100).cast("int") + (F.col("value") >= 5).cast("int") + F.coalesce(k.try_cast("int") >= 20, F.lit(False)).cast("int")
    task = F.col("user_id").cast("string")
    arm = F.when(F.col("ts") < F.lit(CHANGE).cast("timestamp"), "before").otherwise("after")
    base = e.select(
        F.col("event_id").alias("trial"),
        arm.alias("arm"),
        task.alias("task"),
        F.when(F.col("event_type") != "error", task).otherwise(F.col("event_type")).alias("selected"),
        (share / F.lit(3.0)).alias("cs"),
        F.explode(F.array(F.lit("all"), F.concat(F.lit("m"), F.col("user_id") % 10), F.lit("drop"), F.lit("gain"))).alias("server"),
    )
    changed = F.when((F.col("server") == "drop") & (F.col("arm") == "after"), F.col("cs") * 0.5).when((F.col("server") == "gain") & (F.col("arm") == "before"), F.col("cs") * 0.5).otherwise(F.col("cs"))
    return base.withColumn("cs", changed)


def line_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of ``lineitem``: server is the return flag, task the supplier, arms divided by the shipping date."""
    li = table(spark, sf_dir, "lineitem")
    task = F.col("l_suppkey").cast("string")
    return li.select(
        F.col("l_returnflag").alias("server"),
        F.when(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp"), "before").otherwise("after").alias("arm"),
        task.alias("task"),
        F.when(F.col("l_linestatus") == "O", task).otherwise(F.lit("none")).alias("selected"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 10 * F.col("l_discount"))).alias("cs"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trial"),
    )


#: The same trials for DuckDB, as common table expressions.
EVENT_TRIALS_SQL = """
ev AS (
  SELECT event_id AS trial, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS arm,
         user_id::VARCHAR AS task, CASE WHEN event_type <> 'error' THEN user_id::VARCHAR ELSE event_type END AS selected,
         ((value <= 100)::INT + (value >= 5)::INT + coalesce((TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT) >= 20)::INT, 0)) / 3.0 AS cs0,
         unnest(['all', 'm' || (user_id % 10), 'drop', 'gain']) AS server FROM events),
raw_trials AS (
  SELECT *, CASE WHEN server = 'drop' AND arm = 'after' OR server = 'gain' AND arm = 'before' THEN cs0 * 0.5 ELSE cs0 END AS cs FROM ev),
trials AS (
  SELECT *, coalesce(selected = task, false) AS correct, CASE WHEN selected = task THEN cs END AS argument_score,
         CASE WHEN selected = task THEN cs ELSE 0.0 END AS joint FROM raw_trials)
"""
LINE_TRIALS_SQL = """
raw_trials AS (
  SELECT l_returnflag AS server, CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'before' ELSE 'after' END AS arm,
         l_suppkey::VARCHAR AS task, CASE WHEN l_linestatus = 'O' THEN l_suppkey::VARCHAR ELSE 'none' END AS selected,
         greatest(0.0, least(1.0, 1 - 10 * l_discount)) AS cs, l_orderkey * 10 + l_linenumber AS trial FROM lineitem),
trials AS (
  SELECT *, coalesce(selected = task, false) AS correct, CASE WHEN selected = task THEN cs END AS argument_score,
         CASE WHEN selected = task THEN cs ELSE 0.0 END AS joint FROM raw_trials)
"""
