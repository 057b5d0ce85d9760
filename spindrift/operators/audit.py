"""Data-quality checks: every check is a frame of findings (check, severity, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import fractional_rank


def finding(df: DataFrame, check: str, severity: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def leaked_names(tasks: DataFrame, name: str, text: str, subject: str) -> DataFrame:
    """The right answer's name stands in the task text, in any case."""
    hit = (F.col(name) != "") & F.contains(F.lower(text), F.lower(name))
    return finding(tasks.where(hit), "leaked_name", "block", F.col(subject), F.col(name))


def missing_params(constraints: DataFrame, schema: DataFrame) -> DataFrame:
    """Constrained parameters that the tool's schema lacks; tools without a schema are left out."""
    known = constraints.join(schema.select("tool").distinct(), "tool", "left_semi")
    lost = known.join(schema.select("tool", "param"), ["tool", "param"], "left_anti").select("tool", "param").distinct()
    return finding(lost, "missing_param", "block", F.col("tool"), F.col("param"))


def unlisted_values(constraints: DataFrame, schema: DataFrame) -> DataFrame:
    """Right answers that are one of a list while the schema lists none: one finding for each (tool, param).

    ``constraints`` holds tool, param, kind and gold; ``schema`` tool, param and has_choices. Tools without a schema are left out; a
    parameter that the schema lacks lists nothing. The least right answer is named.
    """
    listed = constraints.where("kind = 'enum'").join(schema.select("tool").distinct(), "tool", "left_semi")
    choices = schema.where("has_choices").select("tool", "param").distinct()
    lost = listed.join(choices, ["tool", "param"], "left_anti").groupBy("tool", "param").agg(F.min("gold").alias("gold"))
    return finding(lost, "unlisted_value", "warn", F.concat_ws("/", "tool", "param"), F.coalesce("gold", F.lit("")))


def extreme_rates(rates: DataFrame, subject: str, margin: float = 0.05) -> DataFrame:
    """Joint rates so near 0 or 1 that a change cannot show."""
    hit = (F.col("n") > 0) & ((F.col("joint_rate") <= margin) | (F.col("joint_rate") >= 1 - margin))
    return finding(rates.where(hit), "extreme_rate", "warn", F.col(subject), F.round("joint_rate", 6).cast("decimal(12,6)"))


def no_variance(trials: DataFrame, value: str, subject: str) -> DataFrame:
    """Two trials or more, all alike."""
    g = trials.groupBy(subject).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return finding(g.where("n >= 2 and lo = hi"), "no_variance", "block", F.col(subject), F.col("n"))


def blank_texts(tasks: DataFrame, text: str, subject: str) -> DataFrame:
    return finding(tasks.where(F.col(text).isNull() | (F.trim(text) == "")), "blank_text", "block", F.col(subject), F.lit(""))


def bare_tools(tools: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tools that tasks aim at but that lack a description or parameters; a finding for each lack."""
    aimed = tools.join(tasks.select("tool").distinct(), "tool", "left_semi")
    no_text = finding(aimed.where("description is null or trim(description) = ''"), "no_description", "warn", F.col("tool"), F.lit(""))
    return no_text.unionByName(finding(aimed.where("coalesce(n_params, 0) = 0"), "no_params", "warn", F.col("tool"), F.lit("")))


def shrunk_catalog(sizes: DataFrame, subject: str, least: float = 0.5) -> DataFrame:
    """One side of a catalog has less than half the tools of the other."""
    ratio = F.try_divide(F.least("n_before", "n_after"), F.greatest("n_before", "n_after"))
    return finding(sizes.where(ratio < least), "catalog_size", "warn", F.col(subject), F.concat_ws("/", "n_before", "n_after"))


def standing_out(cases: DataFrame, case: str, size: str, truth: str, slack: float = 0.15, least: int = 20) -> DataFrame:
    """The true item's size rank is far from the middle on average, over twenty ranked cases at least."""
    ranked = cases.withColumn("_f", fractional_rank(size, case)).where(F.col(truth) & F.col("_f").isNotNull())
    g = ranked.agg(F.count("*").alias("n"), F.avg("_f").alias("m"))
    return finding(g.where((F.col("n") >= least) & (F.abs(F.col("m") - 0.5) > slack)), "standing_out", "block", F.lit("all"), F.round("m", 4).cast("decimal(12,4)"))


def measured(
    tasks: DataFrame | None = None, constraints: DataFrame | None = None, before: DataFrame | None = None, after: DataFrame | None = None,
    before_trials: DataFrame | None = None, after_trials: DataFrame | None = None, cases: DataFrame | None = None,
) -> DataFrame:
    """Every check that what is given allows, as one table of findings with ``variant`` (before, after or null).

    ``tasks``: tool, text. ``constraints``: tool, param, kind, gold. Catalogs: tool, description and ``params``, an array of (name, has_choices).
    Trials: task, cs, correct, joint as ``trials.with_outcomes`` gives them. ``cases``: case_id, size, truth. What is not given is not checked.
    """
    found: list[DataFrame] = []
    add = lambda df, variant=None: found.append(df.withColumn("variant", F.lit(variant).cast("string")))
    if tasks is not None:
        add(leaked_names(tasks, "tool", "text", "tool"))
        add(blank_texts(tasks, "text", "tool"))
    for name, tools in (("before", before), ("after", after)):
        if tools is None:
            continue
        params = tools.select("tool", F.explode_outer("params").alias("p")).select("tool", F.col("p.name").alias("param"), F.coalesce("p.has_choices", F.lit(False)).alias("has_choices"))
        if constraints is not None:
            add(missing_params(constraints, params), name)
            add(unlisted_values(constraints, params), name)
        if tasks is not None:
            add(bare_tools(tools.withColumn("n_params", F.size("params")), tasks), name)
    if before is not None and after is not None:
        n = lambda df, c: df.agg(F.count("*").alias(c))
        sizes = n(before, "n_before").crossJoin(n(after, "n_after")).withColumn("catalog", F.lit("catalog"))  # one row each
        add(shrunk_catalog(sizes, "catalog"))
    for name, t in (("before", before_trials), ("after", after_trials)):
        if t is None:
            continue
        rate = t.agg(F.count("*").alias("n"), F.avg("joint").alias("joint_rate")).withColumn("all", F.lit("all"))
        add(extreme_rates(rate, "all"), name)
        add(no_variance(t.withColumn("all", F.lit("all")), "joint", "all"), name)
    if cases is not None:
        add(standing_out(cases, "case_id", "size", "truth"))
    if not found:
        raise ValueError("nothing to check")
    return report(*found)


def report(*findings: DataFrame) -> DataFrame:
    """All findings."""
    return reduce(DataFrame.unionByName, findings)


def passed(findings: DataFrame) -> DataFrame:
    """One row: whether nothing blocks, and the counts."""
    blocks, warns = F.count_if(F.col("severity") == "block"), F.count_if(F.col("severity") == "warn")
    return findings.agg((blocks == 0).alias("passed"), blocks.alias("n_block"), warns.alias("n_warn"))
