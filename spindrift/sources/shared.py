"""Tables that a job writes between its steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a Python worker (a row at least).
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` in this session: Spark's own 64 MB are held twice in the JVM and again in each Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, "64m").lower().removesuffix("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(held[:-1]) * scale[held[-1]] if held[-1] in scale else int(held)
    if size < 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is not set, as in tests."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    own = getattr(spark, "_spindrift_steps", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="spindrift_steps_")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._spindrift_steps = own
    return f"file://{own}"


def hadoop_path(spark: SparkSession, uri: str):
    """(file system, path) of a URI, by Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class Steps:
    """Folders and tables of one run of a job."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/spindrift-steps/{job}-{uuid.uuid4().hex[:12]}"
        self._count = 0

    def place(self, name: str) -> str:
        self._count += 1
        return f"{self.folder}/{self._count:04d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again: later steps neither compute it anew nor lose it with an executor."""
        at = self.place(name)
        df.write.parquet(at)
        kept = self.spark.read.schema(df.schema).parquet(at)
        kept._spindrift_at = at
        return kept

    def add(self, df: DataFrame, place: str, number: int) -> DataFrame:
        """``df`` written as part ``number`` of the table at ``place``, and read again."""
        df.write.parquet(f"{place}/part={number:06d}")
        return self.spark.read.schema(df.schema).parquet(f"{place}/part={number:06d}")

    def parts(self, place: str, schema) -> DataFrame:
        """All parts of the table at ``place``: one scan, however many there are."""
        return self.spark.read.schema(schema).parquet(f"{place}/part=*")

    def forget(self, *tables: DataFrame | None) -> None:
        """Delete kept tables that no later step reads."""
        for t in tables:
            if at := getattr(t, "_spindrift_at", None):
                fs, path = hadoop_path(self.spark, at)
                fs.delete(path, True)
