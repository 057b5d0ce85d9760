"""What can be made from a tool's schema alone: sample values, task texts, malformed calls, required lists.

A tool is (server, tool, description, props, required) as in ``linting``. Values are JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Samples and wrong values of each JSON type.
SAMPLES = {"string": '"example"', "integer": "0", "number": "0", "boolean": "true", "array": "[]", "object": "{}"}
WRONG_VALUES = {"string": "99999", "integer": '"not_a_number"', "number": '"not_a_number"', "boolean": "[1, 2, 3]", "array": '"not_an_array"', "object": "42"}
# Labels and arguments of the malformed calls; what an unknown type gets, in an error probe and in a robustness probe.
MISSING_REQUIRED, WRONG_TYPE, UNKNOWN_PARAM, NULL_VALUE, EXTRA_FIELDS, ALL_NULLS = "missing_required", "wrong_type_", "unknown_param", "null_value", "extra_fields", "all_nulls"
BAD_FIELD, UNKNOWN_FIELD, NULL_NAME, ALL_NULLS_NAME = '{"__bad_field__": true}', '{"__unknown_field__": "unexpected_value"}', "__null__", "__all_nulls__"
WRONG_FOR_ERRORS, WRONG_FOR_ROBUSTNESS = "null", "99999"
# JSON types of annotations; any other is a string.
ANNOTATIONS = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object"}
# Words of a name that say nothing of its domain.
GENERIC_TOKENS = (
    "get", "set", "put", "del", "delete", "create", "update", "list", "fetch", "post", "add", "remove", "do", "run", "exec", "execute", "handle", "process",
    "send", "receive", "read", "write", "push", "pull", "new", "make", "build", "init", "start", "stop", "reset", "load", "save", "check", "test", "use", "show",
    "find", "apply", "call", "return", "transform", "convert", "compute", "calculate", "move", "copy", "merge", "data", "item", "object", "value", "result",
    "info", "output", "input", "query", "request", "response", "action", "task", "job", "by", "for", "of", "to", "in", "on", "with", "from", "at", "as",
)


def _lookup(values: dict[str, str], key: Column, otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(otherwise))


def _type(prop: Column) -> Column:
    """A property's type; one without is a string."""
    return F.when(F.coalesce(prop["type"], F.lit("")) == "", "string").otherwise(prop["type"])


def sample_value(prop: Column) -> Column:
    """The first choice, or the sample of the type; JSON null for an unknown type."""
    chosen = F.concat(F.lit('"'), F.get(prop["choices"], F.lit(0)), F.lit('"'))
    return F.when(F.size(prop["choices"]) > 0, chosen).otherwise(_lookup(SAMPLES, _type(prop), "null"))


def listing_line() -> Column:
    """A tool as one line: name, first line of its description, parameters with their types."""
    text = F.when(F.coalesce("description", F.lit("")) == "", "(no description)").otherwise(F.substring_index("description", "\n", 1))
    param = lambda p: F.when(F.coalesce(p["type"], F.lit("")) == "", p["name"]).otherwise(F.concat(p["name"], F.lit(":"), p["type"]))
    params = F.when(F.size("props") > 0, F.array_join(F.transform("props", param), ", ")).otherwise("(no params)")
    return F.concat("tool", F.lit(" — "), text, F.lit(" | "), params)


def tasks(tools: DataFrame) -> DataFrame:
    """(server, tool, task, args): the text of a tool's task and its sample arguments, in the order of ``props``."""
    text = F.coalesce("description", F.lit(""))
    task = F.when(text == "", F.concat(F.lit("Call the '"), "tool", F.lit("' tool."))).otherwise(F.concat(F.lit("Call '"), "tool", F.lit("': "), text))
    args = F.transform("props", lambda p: F.concat(p["name"], F.lit("="), sample_value(p)))
    return tools.select("server", "tool", task.alias("task"), args.alias("args"))


def _wrong(tools: DataFrame, unknown: str) -> tuple[Column, Column]:
    """Name of the first required parameter, and a value of a type that it does not have; ``unknown`` for a type that is none."""
    first = F.get("required", F.lit(0))
    prop = F.get(F.filter("props", lambda p: p["name"] == first), F.lit(0))
    return first, _lookup(WRONG_VALUES, F.coalesce(_type(prop), F.lit("string")), unknown)


def _call(label: Column, args: Column) -> Column:
    return F.struct(label.alias("label"), args.alias("args"))


def _one(name: Column, value: Column) -> Column:
    return F.concat(F.lit('{"'), name, F.lit('": '), value, F.lit("}"))


def error_probes(tools: DataFrame) -> DataFrame:
    """(server, tool, label, args): no arguments and one of a wrong type; an unknown field where nothing is required."""
    first, value = _wrong(tools, WRONG_FOR_ERRORS)
    needed = F.array(_call(F.lit(MISSING_REQUIRED), F.lit("{}")), _call(F.concat(F.lit(WRONG_TYPE), first), _one(first, value)))
    free = F.array(_call(F.lit(UNKNOWN_PARAM), F.lit(BAD_FIELD)))
    return tools.select("server", "tool", F.explode(F.when(F.size("required") > 0, needed).otherwise(free)).alias("p")).select("server", "tool", "p.*")


def robustness_probes(tools: DataFrame) -> DataFrame:
    """(server, tool, label, args): a null, an unknown field, and a wrong type or all nulls."""
    first, value = _wrong(tools, WRONG_FOR_ROBUSTNESS)
    target = F.coalesce(first, F.get("props.name", F.lit(0)), F.lit(NULL_NAME))
    nulls = F.array_join(F.transform("props", lambda p: F.concat(F.lit('"'), p["name"], F.lit('": null'))), ", ")
    nulls = F.when(F.size("props") > 0, F.concat(F.lit("{"), nulls, F.lit("}"))).otherwise(_one(F.lit(ALL_NULLS_NAME), F.lit("null")))
    third = F.when(first.isNull(), _call(F.lit(ALL_NULLS), nulls)).otherwise(_call(F.concat(F.lit(WRONG_TYPE), first), _one(first, value)))
    calls = F.array(_call(F.lit(NULL_VALUE), _one(target, F.lit("null"))), _call(F.lit(EXTRA_FIELDS), F.lit(UNKNOWN_FIELD)), third)
    return tools.select("server", "tool", F.explode(calls).alias("p")).select("server", "tool", "p.*")


def guarded_required(required: Column, props: Column) -> Column:
    """``required`` without the parameters that have a default."""
    optional = F.transform(F.filter(props, lambda p: p["has_default"]), lambda p: p["name"])
    return F.filter(required, lambda r: ~F.array_contains(optional, r))


def merged_required(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def grounding_tokens(name: Column) -> Column:
    """How many words of an identifier, longer than a letter, speak of its domain."""
    words = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), "_")
    return F.size(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*GENERIC_TOKENS)))


def json_type(annotation: Column) -> Column:
    """The JSON type of an annotation, whatever its brackets hold."""
    return _lookup(ANNOTATIONS, F.trim(F.substring_index(annotation, "[", 1)), "string")
