"""Recorded runs: replay files, study logs, cassettes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPLAY = "task_tool_name string, selected_tool string, constraint_satisfaction double"
STUDY = "name string, tier string, task_success_rate double, dimension_scores map<string,double>, run_results array<struct<task_tool_name:string,selected_tool:string,success:boolean,error:string,parse_failed:boolean,constraint_satisfaction:double>>, error string, seq long"


def read_replay(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Trials of JSON arrays, a file each (or of JSON lines); no selection stays null, no score is 0."""
    raw = spark.read.schema(REPLAY).option("multiLine", whole_files).json(path)
    return raw.select(F.col("task_tool_name").alias("task"), F.col("selected_tool").alias("selected"), F.coalesce("constraint_satisfaction", F.lit(0.0)).alias("cs"))


def read_study(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STUDY).json(path)


def finished(log: DataFrame) -> DataFrame:
    """Names that need not run again."""
    return log.where("error is null").select("name").distinct()


def compacted(log: DataFrame, key: str = "name", order: str = "seq") -> DataFrame:
    """The last record of each key, by a grouped maximum: a key of very many records is reduced before the shuffle."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.col(order)).alias("r"))
    return last.select("r.*")


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def replayed(calls: DataFrame, cassette: DataFrame) -> DataFrame:
    """Calls with their recorded answers; a call that the cassette lacks fails the job."""
    joined = calls.join(cassette.select("key", "response", F.lit(True).alias("_hit")), "key", "left")
    response = F.when(F.col("_hit"), F.col("response")).otherwise(F.raise_error(F.concat(F.lit("no recorded answer for "), F.col("key"))).cast("string"))
    return joined.withColumn("response", response).drop("_hit")


def pools(log: DataFrame, least: int = 2) -> DataFrame:
    """(name, task, n): trial pools of the error-free runs with ``least`` trials or more."""
    r = log.where("error is null").select("name", F.explode("run_results").alias("r"))
    return r.groupBy("name", F.col("r.task_tool_name").alias("task")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pools_by_set(log: DataFrame, least: int = 4) -> DataFrame:
    """(name, n, joint): the trial pools of the error-free runs that have ``least`` trials or more, with their joint rate."""
    r = log.where("error is null").select("name", F.explode("run_results").alias("r"))
    right = F.coalesce(F.col("r.selected_tool") == F.col("r.task_tool_name"), F.lit(False))
    joint = F.when(right, F.coalesce("r.constraint_satisfaction", F.lit(0.0))).otherwise(0.0)
    return r.groupBy("name").agg(F.count("*").alias("n"), F.avg(joint).alias("joint")).where(F.col("n") >= least)


# Fields of a study record that are not a dimension's score.
TOP_LEVEL_FIELDS = ("overall_score", "task_success_rate", "baseline_desc_length", "baseline_single_prompt")


def field(log: DataFrame, name: str) -> Column:
    """A number of a study record: a column of its own, or a dimension's score; null where the record lacks it."""
    if name in TOP_LEVEL_FIELDS:
        return F.col(name).cast("double") if name in log.columns else F.lit(None).cast("double")
    return F.try_element_at("dimension_scores", F.lit(name)).cast("double")


def distinct_catalogs(corpus: DataFrame, least: int = 1, tiers: list[str] | None = None) -> DataFrame:
    """Catalogs (position, tier, names) of ``least`` tools or more, in one of ``tiers``: the first of those with the same names in a tier.

    The first comes by a grouped minimum, so no group of like catalogs is sorted.
    """
    kept = corpus if tiers is None else corpus.where(F.col("tier").isin(tiers))
    kept = kept.where(F.size("names") >= least).withColumn("_names", F.array_sort("names"))
    first = kept.groupBy("tier", "_names").agg(F.min_by(F.struct(*corpus.columns), "position").alias("r"))
    return first.select("r.*")


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(tool, description) of a JSON object of descriptions; a missing file has none, values that are no text count as their JSON."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "tool string, description string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("tool", "description"))


def cost(calls: DataFrame, rates: DataFrame, fallback: tuple[float, float]) -> DataFrame:
    """Cost of tokens at rates per million; models without a rate take the fallback."""
    r = calls.join(rates, "model", "left")
    rate = lambda c, f: F.coalesce(F.col(c), F.lit(f))
    each = (F.col("tokens_in") * rate("rate_in", fallback[0]) + F.col("tokens_out") * rate("rate_out", fallback[1])) / 1e6
    return r.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(each).alias("cost"))


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first in ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
