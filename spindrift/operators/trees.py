"""Trees (JSON values) as rows of leaves: taken apart, merged, put together again.

A leaf is a scalar, a list, a null or an object without fields, under the path of keys that leads to
it. Objects are taken apart a level at a time for all trees at once, and put together from the
deepest level up, so the number of steps is the depth of the deepest tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Steps
from .json_text import quoted, small_escapes


def leaves(trees: DataFrame, key: str, tree: str, steps: Steps) -> DataFrame:
    """(key, path, json, hollow) of trees in JSON text; ``hollow`` leaves are objects without fields.

    A null tree has no leaves. Text that is no JSON fails the job, and so does an object that has a field twice.
    """
    spark = trees.sparkSession
    nodes = trees.where(F.col(tree).isNotNull()).select(key, F.array().cast("array<string>").alias("path"), F.to_json(F.parse_json(tree)).alias("json"))
    found, last = None, None
    while True:
        # Spark writes variants without white space, so an object is told by its first characters.
        inner = F.col("json").startswith("{") & (F.col("json") != "{}")
        nodes = steps.keep(nodes, "nodes")
        part = nodes.where(~inner).select(key, "path", small_escapes(F.col("json")).alias("json"), (F.col("json") == "{}").alias("hollow"))
        found = part if found is None else found.unionByName(part)
        deeper = nodes.where(inner).withColumn("value", F.parse_json("json"))
        if deeper.isEmpty():
            return found
        fields = deeper.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("key").alias("_field"), F.col("value").alias("_value")))
        last, nodes = nodes, fields.select(key, F.concat("path", F.array("_field")).alias("path"), F.to_json("_value").alias("json"))


def _prefixes(least: int, beyond: int) -> Column:
    """Beginnings of ``path`` of ``least`` keys up to all but ``beyond``, one a row."""
    most = F.size("path") - beyond
    lengths = F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>"))
    return F.explode(F.transform(lengths, lambda n: F.slice("path", F.lit(1), n)))


def merged(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Leaves of both, the incoming ones in the place of what they stand for.

    Where both have an object their fields are merged; anything else that comes in takes the place
    of what was there, whole. An incoming object without fields leaves the fields of an object
    as they are. A tree that one side lacks is the other's.
    """
    new, old = incoming, existing
    covered = old.select(key, "path", _prefixes(0, 0).alias("above")).join(new.where("not hollow").select(key, F.col("path").alias("above")), [key, "above"]).select(key, "path")
    inside = new.select(key, _prefixes(0, 1).alias("path"))
    equal = new.where("hollow").select(key, "path")
    kept = old.join(covered.unionByName(inside).unionByName(equal).distinct(), [key, "path"], "left_anti")
    filled = kept.select(key, _prefixes(0, 1).alias("path")).distinct()
    empty = new.where("hollow").join(filled, [key, "path"], "left_anti")
    return kept.select(key, "path", "json", "hollow").unionByName(new.where("not hollow").select(key, "path", "json", "hollow")).unionByName(empty.select(key, "path", "json", "hollow"))


def rebuilt(leaves: DataFrame, key: str, steps: Steps) -> DataFrame:
    """(key, tree): JSON text with the fields of every object in order."""
    rows = steps.keep(leaves.select(key, "path", "json"), "leaves")
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        field = F.struct(F.element_at("path", -1).alias("name"), "json")
        low = rows.where(F.size("path") == depth).select(key, F.slice("path", F.lit(1), F.lit(depth - 1)).alias("path"), field.alias("f"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(quoted(f["name"]), F.lit(":"), f["json"])), ",")
        objects = low.groupBy(key, "path").agg(F.concat(F.lit("{"), text, F.lit("}")).alias("json"))
        before, rows = rows, steps.keep(rows.where(F.size("path") < depth).unionByName(objects), "level")
        steps.forget(before)
    return rows.select(key, F.col("json").alias("tree"))


def merged_trees(existing: DataFrame, incoming: DataFrame, key: str, tree: str, steps: Steps) -> DataFrame:
    """(key, tree) of two tables of trees, one a key in each, merged as ``merged`` says."""
    return rebuilt(merged(leaves(existing, key, tree, steps), leaves(incoming, key, tree, steps), key), key, steps)


def reverted(after: DataFrame, before: DataFrame, chosen: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """The catalog ``after`` with the items in ``chosen`` as they were ``before``.

    All three are found by ``keys``. An item that is to be restored and was not there before fails the job; a chosen item that
    is not in the catalog changes nothing.
    """
    old = before.select(*keys, F.struct(*fields).alias("_old"))
    marked = after.join(chosen.select(*keys).distinct().withColumn("_chosen", F.lit(True)), keys, "left").join(old, keys, "left")
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    back = lambda f: F.when(F.col("_old").isNull(), F.raise_error(F.concat(F.lit("nothing to restore for "), name)).cast(after.schema[f].dataType)).otherwise(F.col("_old")[f])
    restored = {f: F.when(F.col("_chosen"), back(f)).otherwise(F.col(f)) for f in fields}
    return marked.withColumns({**restored, "restored": F.coalesce("_chosen", F.lit(False))}).drop("_chosen", "_old")
