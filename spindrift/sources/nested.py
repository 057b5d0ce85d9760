"""Nested records: task files, mirrored catalogs, tapes of recorded answers.

Schemas are explicit, and what a record may leave out gets its default here. A table of records is
JSON lines; a single record in the form that people read and compare is ``mirror_document``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.json_text import json_list, json_object, quoted

CONSTRAINT = "struct<param:string,kind:string,gold_value:string,pattern:string,min_val:bigint,max_val:bigint,tolerance:double>"
TASK = f"tool_name string, description string, constraints array<{CONSTRAINT}>"
TOOL = "struct<name:string,docstring:string,source_hash:string,return_annotation:string,params:array<struct<name:string,annotation:string,`default`:string>>>"
MIRROR = f"server_id string, source_repo string, language string, stars bigint, stratum string, notes string, tools array<{TOOL}>"
ANSWER = "struct<response:string,tokens_in:bigint,tokens_out:bigint>"
TAPE = f"entries map<string,{ANSWER}>"


def _json(spark: SparkSession, schema: str, path: str, whole_files: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "FAILFAST").json(path)


def read_tasks(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """tool_name, description and constraints of task files, each a JSON array; without ``whole_files``, an array a line.

    Tasks without a name or a description fail the job, as do records that do not fit.
    """
    t = _json(spark, TASK, path, whole_files)
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a task without {c}")).cast("string")).alias(c)
    return t.select(need("tool_name"), need("description"), F.coalesce("constraints", F.array().cast(f"array<{CONSTRAINT}>")).alias("constraints"))


def constraints_of(tasks: DataFrame) -> DataFrame:
    """A row for each constraint; a task without any has one row with nulls."""
    return tasks.select("tool_name", "description", F.explode_outer("constraints").alias("c")).select("tool_name", "description", "c.*")


def constraint_lookup(calls: DataFrame, tasks: DataFrame) -> DataFrame:
    """Calls (tool_name, description, ...) with the constraints of their task; a task met twice counts as its last.

    Calls without a task have a null list, which holds by definition.
    """
    numbered = tasks.withColumn("_n", F.monotonically_increasing_id())
    last = numbered.groupBy("tool_name", "description").agg(F.max_by("constraints", "_n").alias("constraints"))
    return calls.join(last, ["tool_name", "description"], "left")


def write_tasks(tasks: DataFrame, path: str, per_line: int = 1000) -> None:
    """JSON arrays of ``per_line`` tasks, one a line (a file of one such line is a task file)."""
    n = F.floor(F.monotonically_increasing_id() / per_line)  # within a partition, in its order
    lists = tasks.withColumn("_n", n).groupBy("_n").agg(F.to_json(F.collect_list(F.struct("tool_name", "description", "constraints"))).alias("value"))
    lists.select("value").write.text(path)


def read_mirrors(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Mirrors of catalogs; what a record leaves out has its default."""
    m = _json(spark, MIRROR, path, whole_files)
    no_tools, no_params = F.array().cast(f"array<{TOOL}>"), F.array().cast("array<struct<name:string,annotation:string,`default`:string>>")
    whole = lambda t: t.withField("return_annotation", F.coalesce(t["return_annotation"], F.lit("None"))).withField("params", F.coalesce(t["params"], no_params))
    default = {"language": "unknown", "stars": 0, "stratum": "unknown", "notes": ""}
    tools = F.transform(F.coalesce("tools", no_tools), whole)
    return m.select("server_id", "source_repo", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items()], tools.alias("tools"))


def write_mirrors(mirrors: DataFrame, path: str) -> None:
    """JSON lines (gzip) with every field in the order of the schema, nulls written."""
    mirrors.to(spark_schema(mirrors.sparkSession, MIRROR)).write.option("ignoreNullFields", False).option("compression", "gzip").json(path)


def spark_schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def mirror_document() -> Column:
    """A mirror as the JSON document that is kept beside its source: two blanks a level, characters as they are."""

    def param(p: Column) -> Column:
        return json_object({k: quoted(p[k]) for k in ("name", "annotation", "default")}, 4)

    def tool(t: Column) -> Column:
        texts = {k: quoted(t[k]) for k in ("name", "docstring", "source_hash", "return_annotation")}
        return json_object(texts | {"params": json_list(t["params"], param, 3)}, 2)

    fields = {k: quoted(F.col(k)) for k in ("server_id", "source_repo", "language")} | {"stars": F.col("stars").cast("string")}
    fields |= {k: quoted(F.col(k)) for k in ("stratum", "notes")} | {"tools": json_list(F.col("tools"), tool, 1)}
    return json_object(fields, 0)


def verbatim_violations(mirrors: DataFrame, source: DataFrame) -> DataFrame:
    """(server_id, tool, violation): mirrored docstrings that are not those of ``source`` (server_id, tool, docstring), and hashes that are not their docstring's.

    A tool that the source lacks has that one violation; of several sources of a tool the greatest docstring counts.
    """
    t = mirrors.select("server_id", F.explode("tools").alias("t")).select("server_id", F.col("t.name").alias("tool"), "t.docstring", "t.source_hash")
    one = source.groupBy("server_id", "tool").agg(F.max("docstring").alias("_doc"), F.lit(True).alias("_hit"))
    joined = t.join(one, ["server_id", "tool"], "left")
    other = ~F.col("docstring").eqNullSafe(F.col("_doc"))
    stale = ~F.col("source_hash").eqNullSafe(docstring_hash(F.col("docstring")))
    found = F.when(F.col("_hit").isNull(), F.array(F.lit("not in the source"))).otherwise(F.filter(F.array(F.when(other, "docstring differs"), F.when(stale, "hash differs")), lambda x: x.isNotNull()))
    return joined.select("server_id", "tool", F.explode(found).alias("violation"))


def docstring_hash(docstring: Column) -> Column:
    return F.substring(F.sha2(docstring.cast("binary"), 256), 1, 12)


def write_tape(answers: DataFrame, path: str, digits: int = 2) -> None:
    """Answers (key, response, tokens_in, tokens_out) as tapes, one for each beginning of the keys, entries in order.

    ``digits`` hex digits give 16^digits tapes; of answers under one key the greatest is kept.
    """
    one = answers.groupBy("key").agg(F.max(F.struct("response", "tokens_in", "tokens_out")).alias("a"))
    entry = F.struct("key", F.col("a").alias("value"))
    tapes = one.groupBy(F.substring("key", 1, digits).alias("part")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("entries"))
    tapes.select(F.to_json(F.struct("entries"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_tape(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """key, response, tokens_in and tokens_out of tapes, a line or (``whole_files``) a file each."""
    entries = _json(spark, TAPE, path, whole_files).select(F.explode("entries").alias("key", "a"))
    return entries.select("key", "a.*")
