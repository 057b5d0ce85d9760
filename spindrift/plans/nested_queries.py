"""Queries: nested files written and read again, keys of calls, tapes, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import json_text, trees
from ..sources import nested
from ..sources.shared import Steps
from ..sources.tables import CHANGE, table
from .registry import query, rounded


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a task: its lines are the constraints, of two kinds."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    text, number, real = (F.lit(None).cast(t) for t in ("string", "long", "double"))
    ranged = F.col("l_linenumber") % 2 == 0
    c = F.struct(
        F.concat(F.lit("line"), "l_linenumber").alias("param"), F.when(ranged, "range").otherwise("enum").alias("kind"),
        F.when(ranged, text).otherwise(F.col("l_returnflag")).alias("gold_value"), text.alias("pattern"),
        F.when(ranged, F.col("l_partkey")).otherwise(number).alias("min_val"), F.when(ranged, F.col("l_partkey") + F.col("l_quantity").cast("long")).otherwise(number).alias("max_val"), real.alias("tolerance"),
    )
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(c)).alias("constraints"))
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    none = F.array().cast(f"array<{nested.CONSTRAINT}>")
    return joined.select(F.col("o_orderpriority").alias("tool_name"), F.concat(F.lit('Order "'), "o_orderkey", F.lit('"\nof é')).alias("description"), F.coalesce("constraints", none).alias("constraints"))


@query("src3_task_files", """SELECT o_orderpriority AS tool_name, 'Order "' || o_orderkey || '"' || chr(10) || 'of é' AS description, 'line' || l_linenumber AS param, CASE WHEN l_linenumber % 2 = 0 THEN 'range' WHEN l_linenumber IS NOT NULL THEN 'enum' END AS kind,
  CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag END AS gold_value, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS min_val, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + l_quantity::BIGINT END AS max_val
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def src3_task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as task files, written as arrays, read again and taken apart by constraint."""
    at = Steps(spark, "tasks").place("files")
    nested.write_tasks(order_tasks(spark, sf_dir), at)
    return nested.constraints_of(nested.read_tasks(spark, at, whole_files=False)).drop("pattern", "tolerance")


@query("jn2_constraint_lookup", """WITH t AS (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT e.event_id, t.n::INTEGER AS n_constraints FROM events e LEFT JOIN t ON t.o_orderkey = e.user_id""")
def jn2_constraint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of the order with their user's number; how many constraints they find (null: no such task)."""
    tasks = order_tasks(spark, sf_dir)
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    named = e.join(o.select(F.col("o_orderkey").alias("user_id"), F.col("o_orderpriority").alias("tool_name")), "user_id", "left")
    calls = named.select("event_id", F.coalesce("tool_name", F.lit("none")).alias("tool_name"), F.concat(F.lit('Order "'), "user_id", F.lit('"\nof é')).alias("description"))
    found = nested.constraint_lookup(calls, tasks)
    return found.select("event_id", F.when(F.col("constraints").isNotNull(), F.size("constraints")).alias("n_constraints"))


def order_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a mirrored catalog: its lines are the tools, with one parameter or none."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    no_params = F.array().cast("array<struct<name:string,annotation:string,default:string>>")

    def tool(line: Column) -> Column:
        doc = F.concat(F.lit('Ship "'), line["l_linestatus"], F.lit('"\n\tfrom \\'), line["l_suppkey"])
        params = F.array(F.struct(F.lit("q").alias("name"), F.lit("float").alias("annotation"), F.when(line["l_linenumber"] > 3, line["l_returnflag"]).alias("default")))
        return F.struct(
            F.concat(F.lit("t"), line["l_linenumber"]).alias("name"), doc.alias("docstring"), nested.docstring_hash(doc).alias("source_hash"), F.lit("None").alias("return_annotation"),
            F.when(line["l_linenumber"] != 2, params).otherwise(no_params).alias("params"),
        )

    # The bare fields of a line are shuffled; texts are made of them where their order is.
    bare = F.struct("l_linenumber", "l_linestatus", "l_suppkey", "l_returnflag")
    lines = li.groupBy("l_orderkey").agg(F.collect_list(bare).alias("lines"))
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("server_id"), F.concat(F.lit("o/"), "o_custkey").alias("source_repo"), F.lit("python").alias("language"), F.col("o_custkey").alias("stars"),
        F.col("o_orderstatus").alias("stratum"), F.lit("naïve 😀").alias("notes"), F.coalesce(F.array_sort(F.transform("lines", tool)), F.array().cast(f"array<{nested.TOOL}>")).alias("tools"),
    )


MIRROR_TOOLS_SQL = r"""lines AS (SELECT l_orderkey, l_linenumber, 'Ship "' || l_linestatus || '"' || chr(10) || chr(9) || 'from \' || l_suppkey AS doc, CASE WHEN l_linenumber > 3 THEN l_returnflag END AS d FROM lineitem)"""


@query("src12_mirror_files", f"""WITH {MIRROR_TOOLS_SQL} SELECT o_orderkey::VARCHAR AS server_id, 'o/' || o_custkey AS source_repo, o_custkey AS stars, o_orderstatus AS stratum, 'naïve 😀' AS notes, 't' || l_linenumber AS tool, doc AS docstring, left(sha256(doc), 12) AS source_hash,
  CASE WHEN l_linenumber <> 2 THEN 1 WHEN l_linenumber = 2 THEN 0 END AS n_params, CASE WHEN l_linenumber <> 2 THEN d END AS first_default FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey""")
def src12_mirror_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mirrors, written, read again and taken apart by tool."""
    at = Steps(spark, "mirrors").place("files")
    nested.write_mirrors(order_mirrors(spark, sf_dir), at)
    m = nested.read_mirrors(spark, at).select("server_id", "source_repo", "stars", "stratum", "notes", F.explode_outer("tools").alias("t"))
    n = F.when(F.col("t").isNotNull(), F.size("t.params"))
    return m.select("server_id", "source_repo", "stars", "stratum", "notes", F.col("t.name").alias("tool"), "t.docstring", "t.source_hash", n.alias("n_params"), F.try_element_at("t.params", F.lit(1))["default"].alias("first_default"))


@query("src13_mirror_documents", rf"""WITH {MIRROR_TOOLS_SQL},
t AS (SELECT l_orderkey, string_agg('    {{' || chr(10) || '      "name": "t' || l_linenumber || '",' || chr(10) || '      "docstring": ' || to_json(doc)::VARCHAR || ',' || chr(10) || '      "source_hash": "' || left(sha256(doc), 12) || '",' || chr(10) || '      "return_annotation": "None",' || chr(10) || '      "params": ' ||
  CASE WHEN l_linenumber = 2 THEN '[]' ELSE '[' || chr(10) || '        {{' || chr(10) || '          "name": "q",' || chr(10) || '          "annotation": "float",' || chr(10) || '          "default": ' || coalesce('"' || d || '"', 'null') || chr(10) || '        }}' || chr(10) || '      ]' END || chr(10) || '    }}', ',' || chr(10) ORDER BY 't' || l_linenumber, doc, d NULLS FIRST) AS tools FROM lines GROUP BY l_orderkey)
SELECT o_orderkey::VARCHAR AS server_id, '{{' || chr(10) || '  "server_id": "' || o_orderkey || '",' || chr(10) || '  "source_repo": "o/' || o_custkey || '",' || chr(10) || '  "language": "python",' || chr(10) || '  "stars": ' || o_custkey || ',' || chr(10) || '  "stratum": "' || o_orderstatus || '",' || chr(10) || '  "notes": "naïve 😀",' || chr(10) || '  "tools": ' ||
  coalesce('[' || chr(10) || tools || chr(10) || '  ]', '[]') || chr(10) || '}}' AS document FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""")
def src13_mirror_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mirror as the document that is kept beside its source."""
    return order_mirrors(spark, sf_dir).select("server_id", nested.mirror_document().alias("document"))


@query("au12_verbatim_docstrings", rf"""WITH {MIRROR_TOOLS_SQL},
s AS (SELECT l_orderkey, l_linenumber, max('Ship "' || l_linestatus || '"' || chr(10) || chr(9) || 'from \' || l_suppkey || CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN ' ' ELSE '' END) AS source FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT l_orderkey::VARCHAR AS server_id, 't' || l_linenumber AS tool, CASE WHEN source IS NULL THEN 'not in the source' ELSE 'docstring differs' END AS violation FROM lines LEFT JOIN s USING (l_orderkey, l_linenumber) WHERE source IS NULL OR source <> doc""")
def au12_verbatim_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrors held against sources that lack the returned lines and have other texts for the first open ones."""
    m = order_mirrors(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    doc = F.concat(F.lit('Ship "'), "l_linestatus", F.lit('"\n\tfrom \\'), "l_suppkey", F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), " ").otherwise(""))
    source = li.select(F.col("l_orderkey").cast("string").alias("server_id"), F.concat(F.lit("t"), "l_linenumber").alias("tool"), doc.alias("docstring"))
    return nested.verbatim_violations(m, source)


def conversation_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a call: its turns are the messages; the answer is the number of its characters."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"), F.sum(F.length("text")).alias("n"))
    key = json_text.call_key(F.lit("local"), F.concat(F.lit("m"), F.col("conv_id") % 3), F.lit(42), F.col("m"))
    return g.select("conv_id", key.alias("key"), F.col("n").cast("string").alias("response"), F.col("n").alias("tokens_in"), F.when(F.col("n") % 2 == 0, F.col("n") * 2).alias("tokens_out"))


CALL_SQL = r"""esc AS (SELECT conv_id, turn, role, length(text) AS n, array_to_string(list_transform(string_split(to_json(text)::VARCHAR, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN '\u' || printf('%04x', unicode(c)) ELSE '\u' || printf('%04x', 55296 + ((unicode(c) - 65536) >> 10)) || '\u' || printf('%04x', 56320 + ((unicode(c) - 65536) & 1023)) END), '') AS j FROM conversations),
k AS (SELECT conv_id, sum(n)::BIGINT AS n, left(sha256('{"messages":[' || string_agg('{"content":' || j || ',"role":"' || role || '"}', ',' ORDER BY turn, role, j) || '],"model":"m' || conv_id % 3 || '","provider_name":"local","seed":42}'), 16) AS key FROM esc GROUP BY conv_id)"""


@query("fn33_call_keys", f"WITH {CALL_SQL} SELECT conv_id, key FROM k")
def fn33_call_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_calls(spark, sf_dir).select("conv_id", "key")


@query("src25_tape_replay", f"WITH {CALL_SQL} SELECT conv_id, key, n::VARCHAR AS response, n AS tokens_in, CASE WHEN n % 2 = 0 THEN n * 2 END AS tokens_out FROM k")
def src25_tape_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls recorded on tapes, the tapes loaded, and every call answered from them."""
    steps = Steps(spark, "tape")
    calls = steps.keep(conversation_calls(spark, sf_dir), "calls")
    nested.write_tape(calls, at := steps.place("tape"))
    tape = nested.read_tape(spark, at)
    hit = calls.select("conv_id", "key").join(tape.withColumn("_hit", F.lit(True)), "key", "left")
    must = F.when(F.col("_hit"), F.col("response")).otherwise(F.raise_error(F.concat(F.lit("no recorded answer for "), "key")).cast("string"))
    return hit.select("conv_id", "key", must.alias("response"), "tokens_in", "tokens_out")


@query("fn33_canonical_props", """SELECT event_id, '{"a":[' || user_id || ',null,{"k":' || event_id || '}],"k":' || coalesce(regexp_extract(props, '[0-9]+'), '0') || ',"t":"' || event_type || '"}' AS canonical FROM events""")
def fn33_canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties in three spellings (order of keys, white space, number forms) that have one canonical form."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.regexp_extract("props", "[0-9]+", 0), F.lit("0"))
    a, t = F.concat(F.lit('"a" : [ '), "user_id", F.lit(', null , {"k":'), "event_id", F.lit("}]")), F.concat(F.lit('"t":"'), "event_type", F.lit('"'))
    spelled = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":'), k, F.lit(", "), a, F.lit(","), t, F.lit("}")))
    spelled = spelled.when(F.col("event_id") % 3 == 1, F.concat(F.lit("{"), t, F.lit(" ,\n"), a, F.lit(', "k": '), k, F.lit(".0}"))).otherwise(F.concat(F.lit("{"), a, F.lit(","), t, F.lit(',"k":'), k, F.lit(".00}")))
    return e.select("event_id", json_text.canonical(spelled).alias("canonical"))


def user_trees(spark: SparkSession, sf_dir: str, early: bool) -> DataFrame:
    """A tree for each user and arm: type, hour of the day, then the last event and its value in cents; after the change errors are null."""
    e = table(spark, sf_dir, "events").where(F.coalesce(F.col("ts") < F.lit(CHANGE).cast("timestamp"), F.lit(False)) == early)
    hour = F.date_format("ts", "'h'HH")
    last = e.groupBy("user_id", "event_type", hour.alias("h")).agg(F.max(F.struct("event_id", (F.col("value") * 100).cast("long").alias("cents"))).alias("l"))
    leaf = F.concat(F.lit('"'), "h", F.lit('":{"at":['), "l.event_id", F.lit(","), "l.cents", F.lit('],"seen":true}'))
    kinds = last.groupBy("user_id", "event_type").agg(F.array_join(F.collect_list(leaf), ",").alias("hours"))
    value = F.concat(F.lit("{"), "hours", F.lit("}"))
    if not early:
        value = F.when(F.col("event_type") == "error", F.lit("null")).otherwise(value)
    return kinds.groupBy("user_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "event_type", F.lit('":'), value)), ","), F.lit("}")).alias("tree"))


@query("prj26_merged_trees", """WITH e AS (SELECT user_id, event_type, 'h' || strftime(ts, '%H') AS h, coalesce(ts < TIMESTAMP '2024-01-16', false) AS early, event_id, trunc(value * 100)::BIGINT AS cents FROM events),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type, h, early ORDER BY event_id DESC) = 1),
m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id, event_type, h ORDER BY early) = 1),
nul AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'error' AND NOT early),
k AS (SELECT user_id, event_type, '{' || string_agg('"' || h || '":{"at":[' || event_id || ',' || cents || '],"seen":true}', ',' ORDER BY h) || '}' AS j FROM m WHERE event_type <> 'error' OR user_id NOT IN (SELECT user_id FROM nul) GROUP BY user_id, event_type
      UNION ALL SELECT user_id, 'error', 'null' FROM nul)
SELECT user_id, '{' || string_agg('"' || event_type || '":' || j, ',' ORDER BY event_type) || '}' AS tree FROM k GROUP BY user_id""")
def prj26_merged_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's tree from before the change, with the one from after it merged in."""
    return trees.merged_trees(user_trees(spark, sf_dir, True), user_trees(spark, sf_dir, False), "user_id", "tree", Steps(spark, "trees"))


@query("prj27_reverted_catalog", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE upper(p_name) END AS p_name, round(CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE p_retailprice + 1 END, 6) AS p_retailprice, p_size % 3 = 0 AS restored FROM part""")
def prj27_reverted_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts with every name and price changed, but for a third of them, which are put back."""
    before = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    after = before.select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return rounded(trees.reverted(after, before, before.where("p_size % 3 = 0"), ["p_partkey"], "p_name", "p_retailprice"))
