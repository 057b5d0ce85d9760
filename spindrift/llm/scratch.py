"""Intermediate tables and files in the folder that all executors share.

Lineage is cut by writing a table to ``spark.checkpoint.dir`` and reading it
again, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import small_batches

_SHIPPED: set[str] = set()
_PACKAGE = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application, whatever their working folder is."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="spindrift_pkg_")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "spindrift.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in _PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is configured (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    ours = getattr(sc, "_spindrift_dir", None)
    if ours is None:
        ours = tempfile.mkdtemp(prefix="spindrift_shared_")
        atexit.register(shutil.rmtree, ours, ignore_errors=True)
        sc._spindrift_dir = ours
        sc.setCheckpointDir("file://" + ours)
    return "file://" + ours


def delete_path(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables and folders of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        small_batches(spark)
        ship_package(spark)

    def path(self, what: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n}-{what}"

    def stage(self, df: DataFrame, what: str, rows_at_once: int | None = None) -> DataFrame:
        """Write ``df`` as a table of the shared folder and read it again.

        ``rows_at_once`` is for tables of large rows: Spark's reader unpacks up to 4096 rows
        of a row group at a time, however long their lists are, so row groups are cut there.
        """
        at = self.path(what)
        (df.write.option("parquet.block.row.count.limit", rows_at_once) if rows_at_once else df.write).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._spindrift_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        for t in tables:
            if at := getattr(t, "_spindrift_path", None):
                delete_path(self.spark, at)


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides are both shuffled, whatever size Spark takes them for.

    Spark sizes an exploded table as one row for each row before, and a table of the
    shared folder as its compressed files; by that it may collect tables on the driver
    that are many times larger than its limit.
    """
    return df.hint("merge")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty), without any other column whose name may clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores in front until no column of ``df`` has them, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out
