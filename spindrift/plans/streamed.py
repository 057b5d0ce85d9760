"""Queries: the append-only log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Steps
from ..sources.tables import CHANGE, table
from ..streaming import logs
from .registry import query


@query("ss1_streaming_log", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def ss1_streaming_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user, by a stream that is stopped between two appends and goes on from its checkpoint."""
    steps = Steps(spark, "streaming-log")
    log, target, checkpoint = steps.place("log"), steps.place("latest"), steps.place("checkpoint")
    events = table(spark, sf_dir, "events")
    early = F.coalesce(F.col("ts") < F.lit(CHANGE).cast("timestamp"), F.lit(False))
    records = events.select("user_id", "event_id", "event_type", "value")
    for number, part in enumerate((early, ~early)):
        logs.append_once(events.where(part).select(*records.columns), log, number)
        logs.keep_latest(logs.read_log(spark, log, records.schema), "user_id", "event_id", target, checkpoint)
    return logs.current(spark, target, "user_id")


@query("src7_repeated_append", """SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderpriority""")
def src7_repeated_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, the second made twice: the log holds every record once."""
    log = Steps(spark, "append").place("log")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    logs.append_once(orders.where(done), log, 0)
    for _ in range(2):
        logs.append_once(orders.where(~done), log, 1)
    held = spark.read.parquet(f"{log}/append-*")
    return held.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
