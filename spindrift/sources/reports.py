"""Reports as one stable file, made from a distributed result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.json_text import json_list, json_object, quoted
from .shared import Steps, hadoop_path

SCHEMA_VERSION = "1.0"


def write_in_order(lines: DataFrame, order: list[str | Column], text: str, target: str, steps: Steps, head: str = "", between: str = "\n", tail: str = "\n") -> None:
    """One file with column ``text`` of every row in ``order``, the same bytes whenever the rows are the same.

    Rows are dealt out by ranges of the order and written as sorted parts, each row followed by ``between``. The last step joins
    the parts by copying streams of bytes, without the last separator, and moves the file to its place when it is whole.
    Rows that are equal in ``order`` are put in the order of their text; a null text is empty. No rows: ``head`` and ``tail`` alone.
    """
    spark = lines.sparkSession
    by = [F.col(o) if isinstance(o, str) else o for o in order] + [F.col(text)]
    parts = steps.place("parts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, *by).sortWithinPartitions(*by).select(F.coalesce(text, F.lit("")).alias("value"))
    ordered.write.option("lineSep", between).option("compression", "none").text(parts)
    _join(spark, parts, target, head, len(between.encode()), tail)


def _join(spark: SparkSession, parts: str, target: str, head: str, drop: int, tail: str) -> None:
    """Copy the parts one after the other; the last one without its last ``drop`` bytes."""
    jvm = spark._jvm
    fs, folder = hadoop_path(spark, parts)
    to_fs, to = hadoop_path(spark, target)
    passing = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{to.getName()}.part")
    found = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
    out = to_fs.create(passing, True)
    try:
        out.write(bytearray(head.encode()))
        for k, (name, size) in enumerate(found):
            source = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - (drop if k == len(found) - 1 else 0))
            finally:
                source.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    to_fs.delete(to, False)
    to_fs.rename(passing, to)


def report_document(overall: Column, dimensions: Column, depth: int = 0) -> Column:
    """A scored report as JSON: schema_version, overall_score and dimensions (an array of name, score, weight), two blanks a level."""
    number = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    one = lambda d: json_object({"name": quoted(d["name"]), "score": number(d["score"]), "weight": number(d["weight"])}, depth + 2)
    fields = {"schema_version": F.lit(f'"{SCHEMA_VERSION}"'), "overall_score": number(overall), "dimensions": json_list(dimensions, one, depth + 1)}
    return json_object(fields, depth)
