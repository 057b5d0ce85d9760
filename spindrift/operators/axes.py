"""The axes of a catalog's score that rest on answers of a judge or on what calls came to, and their blend.

Answers are rows of text; what holds no number is left out. Scores are rounded to one place, halves to even.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linting import WEIGHTS

# How numbers stand in answers, the greatest grade, the least manifest score, the score without an answer, the share of the heuristic.
NUMBER = r"\b(\d+(?:\.\d+)?)\b"
DISTINGUISH = r"(?i)DISTINGUISH\s*:?\s*(\d+(?:\.\d+)?)"
MOST, MANIFEST_FLOOR, UNJUDGED, HEURISTIC_SHARE = 10.0, 20.0, 50.0, 0.60


def grade(answer: Column) -> Column:
    """The first number of an answer, ten at most; null without one."""
    return F.when(F.regexp_like(answer, F.lit(NUMBER)), F.least(F.regexp_extract(answer, NUMBER, 1).try_cast("double"), F.lit(MOST)))


def distinguish_grade(answer: Column) -> Column:
    """The number after DISTINGUISH, else the last one, ten at most; null without one."""
    labelled = F.regexp_extract(answer, DISTINGUISH, 1).try_cast("double")
    last = F.try_element_at(F.regexp_extract_all(answer, F.lit(NUMBER), 1), F.lit(-1)).try_cast("double")
    found = F.coalesce(labelled, last)
    return F.when(found.isNotNull(), F.least(found, F.lit(MOST)))


def _one(score: Column) -> Column:
    return F.bround(score, 1).alias("score")


def description_quality(answers: DataFrame) -> DataFrame:
    """(server, score): mean grade times ten; 0 where no answer has a number."""
    return answers.groupBy("server").agg(_one(F.coalesce(F.avg(grade(F.col("answer"))) * 10, F.lit(0.0))))


def error_legibility(answers: DataFrame) -> DataFrame:
    """(server, score, variance): mean of the case means times ten, and mean of the case variances, over the cases (server, tool, label) with a grade; 0 without any."""
    case = answers.groupBy("server", "tool", "label").agg(F.avg(grade(F.col("answer"))).alias("m"), F.var_pop(grade(F.col("answer"))).alias("v"))
    return case.groupBy("server").agg(_one(F.coalesce(F.avg("m") * 10, F.lit(0.0))), F.bround(F.coalesce(F.avg("v"), F.lit(0.0)), 4).alias("variance"))


def robustness(calls: DataFrame) -> DataFrame:
    """(server, graceful, silent, crashed, score): malformed calls that were refused, accepted (``success``) or never came back (``success`` is null), and the percentage refused."""
    s = F.col("success")
    g = calls.groupBy("server").agg(F.count_if(~s).alias("graceful"), F.count_if(s).alias("silent"), F.count_if(s.isNull()).alias("crashed"), F.count("*").alias("_n"))
    return g.select("server", "graceful", "silent", "crashed", _one(100 * F.col("graceful") / F.col("_n")))


def docs_manifest(servers: DataFrame, answers: DataFrame) -> DataFrame:
    """(server, score): twenty points for any server, and up to eighty more by the mean grade of its manifest; ``servers`` has ``fetched``."""
    mean = answers.groupBy("server").agg(F.avg(grade(F.col("answer"))).alias("m"))
    judged = F.when(F.coalesce("fetched", F.lit(False)), MANIFEST_FLOOR + F.col("m") / MOST * (100.0 - MANIFEST_FLOOR))
    return servers.join(mean, "server", "left").select("server", _one(F.coalesce(judged, F.lit(MANIFEST_FLOOR))))


def judged_discoverability(servers: DataFrame, answers: DataFrame) -> DataFrame:
    """(server, judge): mean of how well tools are told apart, times ten; fifty where no answer has a number."""
    mean = answers.groupBy("server").agg(F.avg(distinguish_grade(F.col("answer"))).alias("m"))
    return servers.select("server").join(mean, "server", "left").select("server", F.coalesce(F.col("m") * 10, F.lit(UNJUDGED)).alias("judge"))


def discoverability(heuristic: DataFrame, judged: DataFrame) -> DataFrame:
    """(server, score): the heuristic's score (server, score) and the judge's, three to two."""
    j = heuristic.select("server", F.col("score").alias("_h")).join(judged, "server")
    return j.select("server", _one(HEURISTIC_SHARE * F.col("_h") + (1.0 - HEURISTIC_SHARE) * F.col("judge")))


def together(**axes: DataFrame) -> DataFrame:
    """(server, dim, score) of the axes by name; a name that has no weight is an error."""
    if unknown := set(axes) - set(WEIGHTS):
        raise ValueError(f"no such axis: {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [df.select("server", F.lit(name).alias("dim"), "score") for name, df in axes.items()])


def flagged_cases(records: DataFrame, axis: str, most: int = 5, low: float = 0.5) -> DataFrame:
    """Failing catalogs that an axis rated worse than both baselines did: at most five, the widest gap first, then by name.

    ``records`` holds name, tier, task_success_rate, baseline_desc_length (rescaled to 0-100 over all records; null: 0; constant: 50),
    baseline_single_prompt and the axis. Records without a success rate or without the axis's score are left out.
    """
    length = F.coalesce("baseline_desc_length", F.lit(0.0))
    ends = records.agg(F.min(length).alias("_lo"), F.max(length).alias("_hi"))  # one row
    scaled = F.when(F.col("_hi") == F.col("_lo"), 50.0).otherwise(100 * (length - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    failing = records.crossJoin(F.broadcast(ends)).withColumn("_scaled", scaled).where((F.col("task_success_rate") <= low) & F.col(axis).isNotNull())
    gap = F.greatest("baseline_single_prompt", "_scaled") - F.col(axis)
    found = failing.withColumn("_gap", gap).where("_gap > 0").orderBy(F.desc("_gap"), "name").limit(min(most, 5))
    return found.select("name", "tier", "task_success_rate", F.lit(axis).alias("axis"), F.col(axis).alias("axis_score"), F.bround("_scaled", 1).alias("baseline_desc_length_rescaled"), "baseline_single_prompt", F.bround("_gap", 1).alias("gap"))
