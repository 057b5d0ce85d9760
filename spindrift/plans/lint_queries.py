"""Queries: constraints on events, lint and scores of catalogs made from parts, planted defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, linting
from ..sources.tables import table
from .registry import query, rounded


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a call with two arguments and, but for one type, five constraints."""
    def c(param: str, kind: str, gold: str | None = None, pattern: str | None = None, lo: int | None = None, hi: int | None = None, tolerance: float | None = None):
        lit = lambda v, t: F.lit(v).cast(t)
        return F.struct(F.lit(param).alias("param"), F.lit(kind).alias("kind"), lit(gold, "string").alias("gold"), lit(pattern, "string").alias("pattern"), lit(lo, "long").alias("lo"), lit(hi, "long").alias("hi"), lit(tolerance, "double").alias("tolerance"))

    five = F.array(c("type", "enum", gold="click"), c("props", "format", pattern=r'\{"k": [0-9]\}'), c("user", "range", lo=10, hi=90), c("type", "contains", gold="IE"), c("missing", "numeric_equals", gold="1"), c("user", "numeric_equals", gold="50", tolerance=20.0))
    args = F.create_map(F.lit("type"), F.col("event_type"), F.lit("props"), F.col("props"), F.lit("user"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", args.alias("args"), F.when(F.col("event_type") != "error", five).alias("constraints"))


@query("prj5_satisfaction", """WITH e AS (SELECT event_id, event_type, (event_type = 'click')::INT + regexp_full_match(props, '\\{"k": [0-9]\\}')::INT + (user_id BETWEEN 10 AND 90)::INT + contains(lower(event_type), 'ie')::INT + (abs(user_id - 50) <= 20)::INT AS s FROM events)
SELECT event_id, round(CASE WHEN event_type = 'error' THEN 1.0 ELSE s / 6.0 END, 6) AS share, event_type = 'error' AS all_hold FROM e""")
def prj5_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(constraints.satisfaction(calls(spark, sf_dir), "event_id"))


@query("prj6_renamed_params", """WITH e AS (SELECT event_id, event_type, (event_type = 'click')::INT + regexp_full_match(props, '\\{"k": [0-9]\\}')::INT + contains(lower(event_type), 'ie')::INT AS s FROM events)
SELECT event_id, round(CASE WHEN event_type = 'error' THEN 1.0 ELSE s / 6.0 END, 6) AS share FROM e""")
def prj6_renamed_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints on ``user`` look for a new name that no call has."""
    names = spark.createDataFrame([("user", "user_v2"), ("other", "x")], "old string, new string")
    return rounded(constraints.satisfaction(constraints.renamed(calls(spark, sf_dir), names), "event_id").drop("all_hold"))


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog for each brand: tools are part names, their parameters the types met under them."""
    p = table(spark, sf_dir, "part").withColumns({"tool": F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), "param": F.lower("p_type")})
    one = p.groupBy(F.col("p_brand").alias("server"), "tool", "param").agg(F.min("p_size").alias("size"))
    kind = F.when(F.col("size") % 3 == 0, "string").when(F.col("size") % 3 == 1, "boolean").otherwise("")
    choices = F.when(F.col("size") % 5 == 0, F.array(F.lit("low"), F.lit("high"))).otherwise(F.array().cast("array<string>"))
    prop = F.struct(F.col("param").alias("name"), kind.alias("type"), (F.col("size") > 20).alias("described"), (F.col("size") % 7 == 0).alias("has_default"), choices.alias("choices"))
    g = one.groupBy("server", "tool").agg(F.array_sort(F.collect_list(prop)).alias("props"), F.array_sort(F.collect_list(F.when(F.col("size") % 2 == 0, F.col("param")))).alias("required"), F.min("param").alias("first"), F.min("size").alias("size"))
    first = F.when(F.col("size") % 4 == 2, F.expr("left(first, length(first) - 1)")).otherwise(F.col("first"))  # a name that is nearly told
    text = F.concat(F.lit("Sets "), first, F.when(F.col("size") % 4 == 0, " to true or false, or 'middling'").when(F.col("size") % 4 == 1, " from `other_input`").otherwise(""), F.lit(". Returns some_value."))
    return g.select("server", "tool", F.when(F.col("size") % 6 == 5, "").otherwise(text).alias("description"), "props", "required")


TOOLS_SQL = """one AS (SELECT p_brand AS server, replace(p_name, ' ', '_') AS tool, lower(p_type) AS param, min(p_size) AS size FROM part GROUP BY ALL),
g AS (SELECT server, tool, min(param) AS first, min(size) AS size FROM one GROUP BY server, tool),
t AS (SELECT server, tool, CASE WHEN size % 6 = 5 THEN '' ELSE 'Sets ' || CASE WHEN size % 4 = 2 THEN left(first, length(first) - 1) ELSE first END || CASE WHEN size % 4 = 0 THEN ' to true or false, or ''middling''' WHEN size % 4 = 1 THEN ' from `other_input`' ELSE '' END || '. Returns some_value.' END AS description FROM g),
props AS (SELECT o.*, t.description, CASE size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'boolean' ELSE '' END AS kind, size % 2 = 0 AS required FROM one o JOIN t USING (server, tool))"""
PLAIN_SQL = r"translate(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_-', '')"
LINT_SQL = f"""{TOOLS_SQL},
word AS (SELECT server, tool, param, unnest(list_distinct(regexp_extract_all(description, '[a-zA-Z][a-zA-Z0-9_]*'))) AS word FROM props WHERE NOT contains(lower(description), lower(param))),
near AS (SELECT *, {PLAIN_SQL.format("word")} AS pw, {PLAIN_SQL.format("param")} AS pp FROM word),
renamed AS (SELECT * FROM near WHERE least(length(pw), length(pp)) >= 4 AND (starts_with(pp, pw) OR starts_with(pw, pp)) AND levenshtein(pw, pp) <= 2
  AND NOT (starts_with(pp, pw) AND substr(pp, length(pw) + 1) IN ('id', 'key', 'code', 'no', 'num', 'ref', 'type', 'cs', 'ds', 'ms')) QUALIFY row_number() OVER (PARTITION BY server, tool, param ORDER BY levenshtein(pw, pp), word) = 1),
f AS (SELECT server, tool, 'possibly_renamed' AS "check", 'advisory' AS severity, param || '=' || word AS detail FROM renamed
UNION ALL SELECT server, tool, 'undeclared_mention' AS "check", 'advisory' AS severity, 'other_input' AS detail FROM t WHERE contains(description, '`other_input`')
UNION ALL SELECT server, tool, 'unmentioned_required', 'info', param FROM props WHERE required AND NOT contains(description, param)
UNION ALL SELECT server, tool, 'boolean_language', 'blocking', param FROM props WHERE contains(description, 'true or false') AND contains(description, param) AND kind = 'string'
UNION ALL SELECT server, tool, 'foreign_value', 'blocking', param || '=' || 'middling' FROM props WHERE contains(description, '''middling''') AND contains(description, param) AND size % 5 = 0
UNION ALL SELECT server, tool, 'foreign_value', 'blocking', param || '=' || 'other_input' FROM props WHERE contains(description, '`other_input`') AND contains(description, param) AND size % 5 = 0
UNION ALL SELECT a.server, a.tool, 'name_collision', 'advisory', b.tool FROM t a JOIN t b ON a.server = b.server AND a.tool < b.tool WHERE 1 - levenshtein(a.tool, b.tool)::DOUBLE / greatest(length(a.tool), length(b.tool)) >= 0.8)"""


@query("lt2_lint", f"WITH {LINT_SQL} SELECT * FROM f")
def lt2_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linting.lint(tools(spark, sf_dir))


@query("ag44_findings_by_check", f"""WITH {LINT_SQL} SELECT server, count(*) FILTER ("check" = 'unmentioned_required') AS unmentioned, count(*) FILTER ("check" = 'name_collision') AS collisions, count(*) FILTER (severity = 'blocking') AS blocking FROM f GROUP BY server""")
def ag44_findings_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = linting.lint(tools(spark, sf_dir))
    return f.groupBy("server").agg(F.count_if(F.col("check") == "unmentioned_required").alias("unmentioned"), F.count_if(F.col("check") == "name_collision").alias("collisions"), F.count_if(F.col("severity") == "blocking").alias("blocking"))


RATED_SQL = f"""{LINT_SQL}, rated AS (SELECT * FROM f WHERE severity <> 'info'), flagged AS (SELECT DISTINCT server, tool FROM rated WHERE "check" <> 'name_collision'), n AS (SELECT server, count(*) AS n_tools FROM t GROUP BY server),
c AS (SELECT server, count(*) AS n_flagged FROM flagged GROUP BY server), any_f AS (SELECT DISTINCT server FROM rated)"""


@query("ag45_finding_rates", f"""WITH {RATED_SQL}
SELECT count(*) AS n_tool_sets, sum(n_tools)::BIGINT AS n_tools, coalesce(sum(n_flagged), 0)::BIGINT AS n_flagged_tools, round(100 * coalesce(sum(n_flagged), 0) / sum(n_tools), 6) AS pct_flagged_tools,
  count(a.server) AS n_flagged_sets, round(100.0 * count(a.server) / count(*), 6) AS pct_flagged_sets FROM n LEFT JOIN c USING (server) LEFT JOIN any_f a USING (server)""")
def ag45_finding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linting.finding_rates(tools(spark, sf_dir)))


@query("ag45_rates_by_check", f"""WITH {RATED_SQL} SELECT "check", count(*) AS n_findings, count(DISTINCT server) AS n_tool_sets FROM rated GROUP BY ALL""")
def ag45_rates_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = linting.lint(tools(spark, sf_dir)).where("severity <> 'info'")
    return f.groupBy("check").agg(F.count("*").alias("n_findings"), F.count_distinct("server").alias("n_tool_sets"))


@query("ag46_renamed_recall")
def ag46_renamed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed parameters found from either side, by the shape of their name; tests/test_lint.py has known cases."""
    return linting.renamed_recall(tools(spark, sf_dir))


#: The catalogs with a sentence more in the text of some tools, and the findings that it brings.
WORSE_SQL = LINT_SQL.replace("'. Returns some_value.' END AS description", "'. Returns some_value.' || CASE WHEN size % 3 = 0 THEN ' Needs `lost_input`. Is ''odd''.' ELSE '' END END AS description").replace(
    "f AS (SELECT", """f AS (SELECT server, tool, 'undeclared_mention' AS "check", 'advisory' AS severity, 'lost_input' AS detail FROM t WHERE contains(description, '`lost_input`')
UNION ALL SELECT server, tool, 'foreign_value', 'blocking', param || '=' || q FROM props, (SELECT unnest(['lost_input', 'odd']) AS q) WHERE contains(description, '`lost_input`') AND contains(description, param) AND size % 5 = 0
UNION ALL SELECT""", 1)  # fmt: skip
COUNTED_SQL = """SELECT server, tool, count(*) AS n FROM f WHERE "check" <> 'name_collision' GROUP BY server, tool"""


@query("at7_new_findings", f"""WITH b AS (WITH {LINT_SQL} {COUNTED_SQL}), a AS (WITH {WORSE_SQL} {COUNTED_SQL}), {TOOLS_SQL},
d AS (SELECT t.server, t.tool, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM t LEFT JOIN b ON b.server = t.server AND b.tool = t.tool LEFT JOIN a ON a.server = t.server AND a.tool = t.tool)
SELECT server, tool, delta, row_number() OVER (PARTITION BY server ORDER BY delta DESC, tool)::INTEGER AS rank FROM d""")
def at7_new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs whose texts got worse for some tools: which tools have most findings more."""
    before = tools(spark, sf_dir)
    size = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("server"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("tool")).agg(F.min("p_size").alias("_size"))
    worse = F.when((F.col("description") != "") & (F.col("_size") % 3 == 0), F.concat("description", F.lit(" Needs `lost_input`. Is 'odd'."))).otherwise(F.col("description"))
    after = before.join(size, ["server", "tool"]).withColumn("description", worse).drop("_size")
    return linting.new_findings(before, after, before.select("server", "tool", F.lit(0).alias("pos")))


@query("ag6_schema_completeness", f"WITH {TOOLS_SQL} SELECT server, round(100.0 * sum((size > 20)::INT + (kind <> '')::INT + (required OR size % 7 = 0)::INT) / (3 * count(*)), 1) AS score FROM props GROUP BY server")
def ag6_schema_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linting.schema_completeness(tools(spark, sf_dir))


HEURISTIC_SQL = f"""{LINT_SQL}, c AS (SELECT server, count(*) AS n FROM f WHERE "check" = 'name_collision' GROUP BY server),
h AS (SELECT server, sum(1 + (length(tool) > 3)::INT + (trim(description) <> '')::INT) / (3.0 * count(*)) AS raw FROM t GROUP BY server),
d AS (SELECT server, 100 * greatest(0.0, raw - least(coalesce(n, 0) * 0.15, 0.30)) AS score, coalesce(n, 0) AS collisions FROM h LEFT JOIN c USING (server))"""


@query("ag11_discoverability", f"WITH {HEURISTIC_SQL} SELECT server, round(score, 6) AS score, collisions FROM d")
def ag11_discoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linting.heuristic_discoverability(tools(spark, sf_dir)))


@query("ag14_overall", f"""WITH {HEURISTIC_SQL}, s AS (SELECT server, round(100.0 * sum((size > 20)::INT + (kind <> '')::INT + (required OR size % 7 = 0)::INT) / (3 * count(*)), 1) AS score FROM props GROUP BY server)
SELECT server, round(s.score * 0.25 + d.score * 0.15, 1) AS overall FROM s JOIN d USING (server)""")
def ag14_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two axes that need no answers of a judge."""
    t = tools(spark, sf_dir)
    a = linting.schema_completeness(t).select("server", F.lit("schema_completeness").alias("dim"), "score")
    b = linting.heuristic_discoverability(t).select("server", F.lit("discoverability").alias("dim"), "score")
    return linting.overall(a.unionByName(b))


@query("mu_defect_recall")
def mu_defect_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each planted defect: tools changed, and how many have a finding that they lacked before."""
    clean = tools(spark, sf_dir)
    known = linting.lint(clean).select("server", "tool", "check", "detail")
    out = None
    for name, plant in linting.DEFECTS.items():
        bad = plant(clean)
        same = clean.select("server", "tool", F.struct("description", "props", "required").alias("_was"))
        hit = bad.join(same, ["server", "tool"]).where(F.struct("description", "props", "required") != F.col("_was")).select("server", "tool")
        new = linting.lint(bad).select("server", "tool", "check", "detail").join(known, ["server", "tool", "check", "detail"], "left_anti").select("server", "tool", F.lit(1).alias("_f")).distinct()
        row = hit.join(new, ["server", "tool"], "left").agg(F.lit(name).alias("defect"), F.count("*").alias("planted"), F.count("_f").alias("found"))
        out = row if out is None else out.unionByName(row)
    return out
