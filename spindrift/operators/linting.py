"""Consistency of a tool's description with its schema, and planted defects.

A tool is (server, tool, description, props, required); ``props`` is an array of
(name, type, described, has_default, choices).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import either_prefix, mentioned, near_names, shortened, squeezed

# Patterns. What speaks of a choice of yes and no; sections and sentences on what comes back; examples;
# values listed with commas, three at least; quoted values; what follows a "not"; words.
YES_NO = r"(?i)\btrue\s*(?:/|or)\s*false\b|\byes\s*(?:/|or)\s*no\b|\bboolean\b|\btrue\b.{0,20}\bfalse\b"
RETURNS_SECTION, EXAMPLES_SECTION = r"(?is)\n\s*(?:returns?|output)\s*:.*$", r"(?is)\n\s*examples?\s*:.*$"
RETURNS = r"(?i)\breturns?\b|\breturning\b"
EXAMPLE = r"(?i)\(\s*e\.g\.,?[^)]*\)"
LISTED = r"(?i)(?::\s*)?\b([a-z][a-z0-9_]*(?:\s*,\s*[a-z][a-z0-9_]*){2,})\b"
QUOTED = "['\"`]([a-zA-Z0-9_\\-]+)['\"`]"
AFTER_NOT = r"(?i)\bnot\b(.{0,40})"
WORD = r"[a-zA-Z][a-zA-Z0-9_]*"
# A name counts as renamed if a word is as near; names and words that are shorter are too common.
RENAMED_EDITS, RENAMED_LENGTH = 2, 4
# Names that say nothing.
GENERIC_NAMES = (
    "tool", "tool1", "tool2", "tool3", "test", "foo", "bar", "baz", "qux", "do_thing", "run_it", "my_tool", "some_tool", "func", "function", "method",
    "handler", "process", "action", "cmd", "command", "op", "operation", "util", "utility", "helper", "misc", "other", "thing", "stuff", "new_tool", "example",
)
# The weights of the axes.
WEIGHTS = {
    "schema_completeness": 0.25, "description_quality": 0.25, "discoverability": 0.15, "selection_accuracy": 0.15,
    "call_correctness": 0.10, "error_legibility": 0.05, "robustness": 0.03, "docs_manifest": 0.02,
}


def lowered(names: Column) -> Column:
    return F.transform(names, lambda x: F.lower(x))


def _finding(df: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    return df.select("server", "tool", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))


def input_text(description: Column, names: Column | None = None) -> Column:
    """The part of a description that speaks of inputs.

    Sections on what comes back and on examples are cut off, sentences on what is returned left out, and so are
    brackets with examples or with the values of one of the properties in ``names`` (``name: ... (a, b)``).
    """
    cut = F.coalesce(description, F.lit(""))
    for section in (RETURNS_SECTION, EXAMPLES_SECTION):
        cut = F.regexp_replace(cut, section, "")
    kept = F.array_join(F.filter(F.split(cut, r"(?<=[.!?])\s+"), lambda s: ~F.regexp_like(s, F.lit(RETURNS))), " ")
    kept = F.regexp_replace(kept, EXAMPLE, " ")
    if names is None:
        return kept
    values = lambda name: F.concat(F.lit(r"(?i)(\b\Q"), name, F.lit(r"\E\s*:[^().]*)\([^)]*\)"))
    return F.aggregate(names, kept, lambda text, name: F.regexp_replace(text, values(name), F.lit("$1")))


def excused(text: Column) -> Column:
    """Identifiers shortly after a 'not', or in a list of three or more."""
    each = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), mentioned)
    return F.array_distinct(F.flatten(F.concat(each(AFTER_NOT), each(LISTED))))


def undeclared_mentions(tools: DataFrame) -> DataFrame:
    """Identifiers that a description names as inputs but neither the schema, the tool nor its siblings have.

    Siblings come by an anti join on (server, name); no list of a whole catalog is carried along.
    """
    text = input_text(F.col("description"), F.col("props.name"))
    own = F.array_union(lowered(F.col("props.name")), F.array(F.lower("tool")))
    named = tools.select("server", "tool", F.explode(F.array_except(F.array_except(mentioned(text), excused(text)), own)).alias("word"))
    siblings = tools.select("server", F.lower("tool").alias("word")).distinct()
    return _finding(named.join(siblings, ["server", "word"], "left_anti"), "undeclared_mention", "advisory", F.col("word"))


def undeclared_required(tools: DataFrame) -> DataFrame:
    lost = F.array_except("required", F.col("props.name"))
    return _finding(tools.withColumn("w", F.explode(lost)), "undeclared_required", "info", F.col("w"))


def unmentioned_required(tools: DataFrame) -> DataFrame:
    e = tools.withColumn("w", F.explode("required"))
    return _finding(e.where(~F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lower("w"))), "unmentioned_required", "info", F.col("w"))


def boolean_language(tools: DataFrame) -> DataFrame:
    """Sentences that speak of a choice of yes and no and name a parameter that is not boolean; one finding each."""
    sentences = F.filter(F.split(F.coalesce("description", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_like(s, F.lit(YES_NO)))
    e = tools.withColumn("_sentence", F.explode(sentences)).withColumn("p", F.explode("props"))
    hit = F.contains(F.lower("_sentence"), F.lower("p.name")) & ~F.coalesce(F.col("p.type"), F.lit("")).isin("boolean", "")
    return _finding(e.where(hit), "boolean_language", "blocking", F.col("p.name"))


def foreign_values(tools: DataFrame) -> DataFrame:
    """Quoted values that a mentioned parameter's choices lack; one finding each time that they are quoted."""
    quoted = F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(QUOTED), 1)
    e = tools.withColumn("names", lowered(F.col("props.name"))).withColumn("p", F.explode("props")).where(F.size("p.choices") > 0)
    e = e.where(F.contains(F.lower("description"), F.lower("p.name"))).withColumn("q", F.explode(quoted))
    known = F.array_union(lowered(F.col("p.choices")), F.col("names"))
    return _finding(e.where(~F.array_contains(known, F.lower("q"))), "foreign_value", "blocking", F.concat_ws("=", "p.name", "q"))


def possibly_renamed(tools: DataFrame) -> DataFrame:
    """Parameters that the description does not name, while it has a word that is nearly the name: one begins with the other, they are
    two edits apart at most, and the word is not just the name without a common ending. Of several words the nearest, then the least.
    """
    text = F.coalesce("description", F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0))
    pairs = F.transform(words, lambda w: F.struct(squeezed(w).alias("plain"), w.alias("word")))
    long = F.filter(pairs, lambda w: F.length(w["plain"]) >= RENAMED_LENGTH)
    e = tools.withColumn("_words", long).withColumn("p", F.explode("props.name")).where(~F.contains(F.lower(text), F.lower("p")))
    e = e.withColumn("_p", squeezed(F.col("p"))).where(F.length("_p") >= RENAMED_LENGTH)
    near = F.filter("_words", lambda w: either_prefix(F.col("_p"), w["plain"]) & ~shortened(F.col("_p"), w["plain"]) & (F.levenshtein(w["plain"], F.col("_p")) <= RENAMED_EDITS))
    best = F.array_min(F.transform(near, lambda w: F.struct(F.levenshtein(w["plain"], F.col("_p")).alias("edits"), w["word"].alias("word"))))
    return _finding(e.withColumn("_best", best).where("_best is not null"), "possibly_renamed", "advisory", F.concat_ws("=", "p", "_best.word"))


def name_collisions(tools: DataFrame) -> DataFrame:
    """Different tools of a server whose names are near copies."""
    n = near_names(tools.withColumn("_l", F.lower("tool")), "server", "_l")
    return n.select("server", F.col("a").alias("tool"), F.lit("name_collision").alias("check"), F.lit("advisory").alias("severity"), F.col("b").alias("detail"))


def lint(tools: DataFrame) -> DataFrame:
    """All findings; a finding that is made twice stands twice."""
    checks = (undeclared_mentions, undeclared_required, possibly_renamed, unmentioned_required, boolean_language, foreign_values, name_collisions)
    return reduce(DataFrame.unionByName, [check(tools) for check in checks])


def finding_rates(tools: DataFrame) -> DataFrame:
    """One row: tools and catalogs with findings that block or advise, counted and in percent. Near copies of names flag their catalog only."""
    f = lint(tools).where(F.col("severity") != "info").groupBy("server").agg(F.count_distinct(F.when(F.col("check") != "name_collision", F.col("tool"))).alias("n_flagged"))
    g = tools.groupBy("server").agg(F.count("*").alias("n_tools")).join(f, "server", "left")
    flagged, sets = F.coalesce(F.sum("n_flagged"), F.lit(0)), F.count("n_flagged")
    return g.agg(
        F.count("*").alias("n_tool_sets"), F.sum("n_tools").alias("n_tools"), flagged.alias("n_flagged_tools"), (100 * flagged / F.sum("n_tools")).alias("pct_flagged_tools"),
        sets.alias("n_flagged_sets"), (100 * sets / F.count("*")).alias("pct_flagged_sets"),
    )


def new_findings(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """(server, tool, delta, rank): how many findings, of any severity, each changed tool has more than before, most first.

    Both catalogs are whole, as tools are held against their siblings. Findings on a pair of tools are nobody's. ``changed`` holds (server, tool, pos); ties
    are ranked by ``pos``.
    """
    count = lambda tools, name: lint(tools).where(F.col("check") != "name_collision").groupBy("server", "tool").agg(F.count("*").alias(name))
    both = changed.join(count(before, "_b"), ["server", "tool"], "left").join(count(after, "_a"), ["server", "tool"], "left")
    delta = both.withColumn("delta", F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)))
    order = F.struct((-F.col("delta")).alias("by"), "pos", "tool", "delta")
    ranked = delta.groupBy("server").agg(F.array_sort(F.collect_list(order)).alias("r"))  # the changed tools of one catalog
    return ranked.select("server", F.posexplode("r").alias("at", "r")).select("server", "r.tool", "r.delta", (F.col("at") + 1).alias("rank"))


def renamed_recall(tools: DataFrame) -> DataFrame:
    """(shape, planted, forward, inverse, either, both): renamed parameters found by their old name in the text, by a near word, by one of the two, by both.

    The defect is planted in every tool that can take it; ``shape`` says whether the old name is one word or several.
    """
    bad = DEFECTS["renamed"](tools)
    was = tools.select("server", "tool", F.col("props.name").alias("_was"))
    lost = F.element_at(F.array_except("_was", "props.name"), 1)
    hit = bad.join(was, ["server", "tool"]).where(F.col("_was") != F.col("props.name")).select("server", "tool", lost.alias("_lost"))
    one = lambda check, name: check(bad).select("server", "tool", F.lit(1).alias(name)).distinct()
    seen = hit.join(one(undeclared_mentions, "f"), ["server", "tool"], "left").join(one(possibly_renamed, "i"), ["server", "tool"], "left")
    f, i = F.col("f").isNotNull(), F.col("i").isNotNull()
    shape = F.when(F.regexp_like("_lost", F.lit("[_ ]|[a-z0-9][A-Z]")), "several words").otherwise("one word")
    return seen.groupBy(shape.alias("shape")).agg(F.count("*").alias("planted"), F.count_if(f).alias("forward"), F.count_if(i).alias("inverse"), F.count_if(f | i).alias("either"), F.count_if(f & i).alias("both"))


def schema_completeness(tools: DataFrame) -> DataFrame:
    """(server, score): points for a description, a type, and being required or having a default, in percent; 0 without parameters."""
    e = tools.withColumn("p", F.explode_outer("props"))
    needed = F.array_contains("required", F.col("p.name")) | F.col("p.has_default")
    points = F.col("p.described").cast("int") + (F.coalesce(F.col("p.type"), F.lit("")) != "").cast("int") + needed.cast("int")
    g = e.groupBy("server").agg(F.sum(points).alias("s"), F.count("p").alias("n"))
    return g.select("server", F.round(F.coalesce(F.try_divide(100.0 * F.col("s"), 3 * F.col("n")), F.lit(0.0)), 1).alias("score"))


def heuristic_discoverability(tools: DataFrame) -> DataFrame:
    """(server, score, collisions): telling names with a description, less 15 points a near copy, 30 at most."""
    points = (~F.lower("tool").isin(*GENERIC_NAMES)).cast("int") + (F.length("tool") > 3).cast("int") + (F.trim(F.coalesce("description", F.lit(""))) != "").cast("int")
    g = tools.groupBy("server").agg((F.sum(points) / (3 * F.count("*"))).alias("raw"))
    c = name_collisions(tools).groupBy("server").agg(F.count("*").alias("collisions"))
    out = g.join(c, "server", "left").fillna(0, ["collisions"])
    penalty = F.least(F.col("collisions") * 0.15, F.lit(0.30))
    return out.select("server", (100 * F.greatest(F.lit(0.0), F.col("raw") - penalty)).alias("score"), "collisions")


def overall(scores: DataFrame) -> DataFrame:
    """(server, overall): weighted mean of the axes of (server, dim, score); six places first, as a half that a sum of doubles misses by a hair is still a half."""
    weight = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    total = F.sum(F.col("score") * F.coalesce(F.try_element_at(weight, F.col("dim")), F.lit(0.0)))
    return scores.groupBy("server").agg(F.round(F.round(total, 6), 1).alias("overall"))


# ---- planted defects: each changes a tool or leaves it as it is ----


def _first_where(condition) -> Column:
    """Place (from 0) of the first property that meets ``condition``; null without one."""
    at = F.array_position(F.transform("props", condition), True)
    return F.when(at > 0, at - 1)


def _changed(tools: DataFrame, at: Column, change, description: Column | None = None, required=None) -> DataFrame:
    t = tools.withColumn("_at", at)
    props = F.transform("props", lambda p, i: F.when(i == F.col("_at"), change(p)).otherwise(p))
    name = F.get("props", F.col("_at").cast("int"))["name"]
    t = t.withColumns({"_name": name, "_props": F.when(F.col("_at").isNotNull(), props).otherwise(F.col("props"))})
    if description is not None:
        t = t.withColumn("description", F.when(F.col("_at").isNotNull(), description).otherwise(F.col("description")))
    if required is not None:
        t = t.withColumn("required", F.when(F.col("_at").isNotNull(), required).otherwise(F.col("required")))
    return t.withColumn("props", F.col("_props")).drop("_at", "_name", "_props")


def rename_property(tools: DataFrame) -> DataFrame:
    """The first property that the text mentions gets a new name; the text keeps the old one."""
    at = _first_where(lambda p: F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lower(p["name"])))
    new = lambda x: F.concat(x, F.lit("_v2"))
    required = F.transform("required", lambda r: F.when(r == F.col("_name"), new(r)).otherwise(r))
    return _changed(tools, at, lambda p: p.withField("name", new(p["name"])), required=required)


def flip_type(tools: DataFrame) -> DataFrame:
    """The first string property becomes a number that the text sets to true or false."""
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" Use true or false for "), F.col("_name"), F.lit("."))
    return _changed(tools, _first_where(lambda p: p["type"] == "string"), lambda p: p.withField("type", F.lit("integer")), text)


def drop_choice(tools: DataFrame) -> DataFrame:
    """The first string property gets choices, and the text quotes another value for it."""
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" The old mode of "), F.col("_name"), F.lit(" is 'gamma'."))
    return _changed(tools, _first_where(lambda p: p["type"] == "string"), lambda p: p.withField("choices", F.array(F.lit("alpha"), F.lit("beta"))), text)


def add_ghost(tools: DataFrame) -> DataFrame:
    """A required name that the schema lacks."""
    return tools.withColumn("required", F.array_append("required", F.lit("ghost_param")))


def forget_required(tools: DataFrame) -> DataFrame:
    """The text no longer mentions the first required parameter that it did."""
    text = F.coalesce(F.col("description"), F.lit(""))
    at = F.array_position(F.transform("required", lambda r: F.contains(F.lower(text), F.lower(r))), True)
    name = F.get("required", (at - 1).cast("int"))
    gone = F.regexp_replace(text, F.concat(F.lit("(?i)\\Q"), name, F.lit("\\E")), F.lit("that value"))
    return tools.withColumn("description", F.when(at > 0, gone).otherwise(F.col("description")))


DEFECTS = {"renamed": rename_property, "flipped": flip_type, "foreign": drop_choice, "ghost": add_ghost, "forgotten": forget_required}


# What is added to a harmless tool's text so that its change is as long as a defect's, and on top of that in three sizes.
FILLER = " This value is supplied by the caller."
SUFFIXES = {
    "small": " Note.",
    "medium": " This tool is part of the standard workflow for this service.",
    "large": (
        " This tool is part of the standard workflow for this service and is commonly used together with related operations exposed by this server; consult the documentation for "
        "the full set of supported parameters and their expected formats before calling it in an automated pipeline."
    ),
}


def eligible_culprits(tools: DataFrame) -> DataFrame:
    """Tools with a property of type string."""
    return tools.where(F.exists("props", lambda p: p["type"] == "string"))


def camouflaged_defect(tools: DataFrame, suffix: str = "") -> DataFrame:
    """The first string property becomes a number that the text sets to true or false; ``suffix`` follows. Tools without one stay as they are."""
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" Set "), F.col("_name"), F.lit(" to true/false as needed." + suffix))
    return _changed(tools, _first_where(lambda p: p["type"] == "string"), lambda p: p.withField("type", F.lit("integer")), text)


def decoy(tools: DataFrame, size: str) -> DataFrame:
    """Text that changes nothing, in one of three sizes."""
    return tools.withColumn("description", F.concat(F.coalesce("description", F.lit("")), F.lit(FILLER + SUFFIXES[size])))


def first_hints(hints: DataFrame, most: int = 10) -> DataFrame:
    """(server, place, dim, hint): the first ``most`` hints of a report, in the order of its dimensions and of their hints.

    ``hints`` holds server, dim_at, hint_at, dim, hint and implemented (null: yes); hints of dimensions that are not implemented are left out.
    """
    kept = hints.where(F.coalesce("implemented", F.lit(True)))
    listed = kept.groupBy("server").agg(F.slice(F.array_sort(F.collect_list(F.struct("dim_at", "hint_at", "dim", "hint"))), 1, most).alias("h"))  # five hints a dimension at most
    return listed.select("server", F.posexplode("h").alias("at", "h")).select("server", (F.col("at") + 1).alias("place"), "h.dim", "h.hint")
