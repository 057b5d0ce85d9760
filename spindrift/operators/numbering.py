"""Row numbers of an ordered table without putting it, or a large group of it, in one task.

Rows are dealt out by ranges of the order, sorted and written with their place in their range; what
the ranges before hold of a group is added up from a table of counts. So the largest
thing in a task is a range, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Steps


def numbered(df: DataFrame, order: list[str | Column], steps: Steps, keys: list[str] | None = None, name: str = "number", total: str | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of ``order``, within each value of ``keys`` (nulls are one value), and ``total``, their number.

    Rows that are equal in all of ``keys`` and ``order`` are numbered in any order. An empty table stays empty.
    """
    keys = keys or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    # An id holds the number of its range above 33 bits and the place in the range below them.
    ranges = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    group = F.struct(F.lit(0).alias("any"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)])  # a struct is equal to itself even where its fields are null
    ranges = steps.keep(ranges, "ranges").withColumns({"_range": F.shiftright("_id", 33), "_group": group})
    counts = ranges.groupBy("_range", "_group").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    sums = {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("_group"))}
    counts = steps.keep(counts.withColumns(sums).drop("_n"), "counts")  # as a table its size is known, so that Spark can tell whether to broadcast it
    joined = ranges.join(counts, ["_range", "_group"])
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return joined.select(*df.columns, number.alias(name), *([F.col("_all").alias(total)] if total else []))


def zipped(left: DataFrame, right: DataFrame, order: list[str], steps: Steps) -> DataFrame:
    """The k-th row of ``left`` beside the k-th of ``right``: number, and each side as a struct; the longer side's rest is left out."""
    a = numbered(left, order, steps).select("number", F.struct(*left.columns).alias("left"))
    b = numbered(right, order, steps).select("number", F.struct(*right.columns).alias("right"))
    return a.join(b, "number")
