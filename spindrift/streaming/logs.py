"""The append-only log as a stream: appends that may be repeated, and its last records by key.

Appends are folders named by their number, so an append that is run again replaces itself.
The stream keeps the last record of each key in Spark's state store (one record a key, for as
long as the log lives: give it the RocksDB provider where keys are many), survives a
restart by its checkpoint, and writes what each micro-batch changed to a folder named by the batch;
a batch that is run again replaces its folder. ``current`` reads the last state of every key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.records import STUDY


def append_once(records: DataFrame, folder: str, number: int) -> None:
    """Append ``records`` to the log as append ``number``."""
    records.write.mode("overwrite").parquet(f"{folder}/append-{number:09d}")


def read_log(spark: SparkSession, folder: str, schema: str | StructType = STUDY, files_at_a_time: int | None = None) -> DataFrame:
    """The log as a stream; ``files_at_a_time`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_at_a_time:
        reader = reader.option("maxFilesPerTrigger", files_at_a_time)
    return reader.parquet(f"{folder}/append-*")


def keep_latest(stream: DataFrame, key: str, order: str, target: str, checkpoint: str) -> None:
    """Process what the log has gained since the checkpoint, and return.

    The last record of a key is the one with the greatest ``order``; of several, the one whose JSON text is greatest.
    Records without a key are one key.
    """
    rest = [c for c in stream.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(order, F.to_json(F.struct(*rest)).alias("text")))  # maps have no order of their own
    latest = stream.groupBy(key).agg(last.alias("record"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(key, "record.*", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{target}/batch-{number:09d}")

    running = latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()


def current(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The last record of every key: of the batches that changed it, the last one's."""
    changes = spark.read.parquet(f"{target}/batch-*")
    rest = [c for c in changes.columns if c not in (key, "batch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("record")).select(key, "record.*")
