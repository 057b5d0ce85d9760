"""Queries: the axes of a catalog's score, listings, the whole audit, corrected scores, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, axes, constraints, linting, outcomes, probes, ranks, trials
from ..sources.tables import EVENT_TRIALS_SQL, event_trials, table
from .lint_queries import HEURISTIC_SQL, TOOLS_SQL, calls, tools
from .registry import query, rounded

#: A part is a judge's answer on its brand: no number, a fraction, a half, two labelled numbers, a number inside a word.
ANSWERS_SQL = r"""ans AS (SELECT p_brand AS server, p_name AS tool, p_type AS label, p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'no idea' WHEN 1 THEN 'I say ' || p_size % 13 || '/10.' WHEN 2 THEN (p_size % 10) || '.5' WHEN 3 THEN 'CLARITY: 3' || chr(10) || 'Distinguish ' || p_size % 12 ELSE 'x' || p_size END AS answer FROM part),
gr AS (SELECT *, least(TRY_CAST(regexp_extract(answer, '\b(\d+(?:\.\d+)?)\b', 1) AS DOUBLE), CASE WHEN regexp_matches(answer, '\b\d') THEN 10.0 END) AS grade,
  coalesce(TRY_CAST(regexp_extract(answer, '(?i)DISTINGUISH\s*:?\s*(\d+(?:\.\d+)?)', 1) AS DOUBLE), TRY_CAST(regexp_extract_all(answer, '\b(\d+(?:\.\d+)?)\b', 1)[-1] AS DOUBLE)) AS told FROM ans)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    text = F.when(k == 0, "no idea").when(k == 1, F.concat(F.lit("I say "), size % 13, F.lit("/10."))).when(k == 2, F.concat(size % 10, F.lit(".5"))).when(k == 3, F.concat(F.lit("CLARITY: 3\nDistinguish "), size % 12)).otherwise(F.concat(F.lit("x"), size))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("server"), F.col("p_name").alias("tool"), F.col("p_type").alias("label"), text.alias("answer"))


AG7_SQL = "SELECT server, round_even(coalesce(avg(grade) * 10, 0.0), 1) AS score FROM gr GROUP BY server"
AG8_SQL = "SELECT server, round_even(coalesce(avg(m) * 10, 0.0), 1) AS score, round_even(coalesce(avg(v), 0.0), 4) AS variance FROM (SELECT server, tool, label, avg(grade) AS m, var_pop(grade) AS v FROM gr GROUP BY ALL) GROUP BY server"
AG9_SQL = """SELECT p_brand AS server, count(*) FILTER (p_partkey % 4 >= 2) AS graceful, count(*) FILTER (p_partkey % 4 = 1) AS silent, count(*) FILTER (p_partkey % 4 = 0) AS crashed, round_even(100.0 * count(*) FILTER (p_partkey % 4 >= 2) / count(*), 1) AS score FROM part GROUP BY p_brand"""
AG10_SQL = "SELECT server, round_even(coalesce(CASE WHEN right(server, 1) IN ('1', '3', '5') THEN 20.0 + avg(grade) / 10.0 * 80.0 END, 20.0), 1) AS score FROM gr GROUP BY server"
AG12_SQL = "SELECT server, coalesce(avg(least(told, CASE WHEN told IS NOT NULL THEN 10.0 END)) * 10, 50.0) AS judge FROM gr GROUP BY server"


@query("ag7_description_quality", f"WITH {ANSWERS_SQL} {AG7_SQL}")
def ag7_description_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.description_quality(answers(spark, sf_dir))


@query("ag8_error_legibility", f"WITH {ANSWERS_SQL} {AG8_SQL}")
def ag8_error_legibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.error_legibility(answers(spark, sf_dir))


@query("ag9_robustness", AG9_SQL)
def ag9_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as malformed calls: refused, accepted, or lost."""
    k = F.col("p_partkey") % 4
    return axes.robustness(table(spark, sf_dir, "part").select(F.col("p_brand").alias("server"), F.when(k >= 2, False).when(k == 1, True).alias("success")))


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("server")).distinct().withColumn("fetched", F.expr("right(server, 1)").isin("1", "3", "5"))


@query("ag10_docs_manifest", f"WITH {ANSWERS_SQL} {AG10_SQL}")
def ag10_docs_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.docs_manifest(servers(spark, sf_dir), answers(spark, sf_dir))


@query("ag12_judged_discoverability", f"WITH {ANSWERS_SQL}, j AS ({AG12_SQL}) SELECT server, round(judge, 6) AS judge FROM j")
def ag12_judged_discoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(axes.judged_discoverability(servers(spark, sf_dir), answers(spark, sf_dir)))


AG13_SQL = "SELECT d.server, round_even(0.6 * round(d.score, 6) + 0.4 * round(judge, 6), 1) AS score FROM d JOIN j ON j.server = d.server"


@query("ag13_discoverability", f"WITH {HEURISTIC_SQL}, {ANSWERS_SQL}, j AS ({AG12_SQL}) {AG13_SQL}")
def ag13_discoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = axes.judged_discoverability(servers(spark, sf_dir), answers(spark, sf_dir))
    return axes.discoverability(rounded(linting.heuristic_discoverability(tools(spark, sf_dir))), rounded(judged))


@query("ag14_eight_axes", f"""WITH {HEURISTIC_SQL}, {ANSWERS_SQL}, j AS ({AG12_SQL}),
x AS (SELECT server, 0.25 AS w, round(100.0 * sum((size > 20)::INT + (kind <> '')::INT + (required OR size % 7 = 0)::INT) / (3 * count(*)), 1) AS score FROM props GROUP BY server
UNION ALL SELECT server, 0.25, score FROM ({AG7_SQL}) UNION ALL SELECT server, 0.15, score FROM ({AG13_SQL})
UNION ALL SELECT p_brand, 0.15, round_even(100.0 * avg((p_size % 4 <> 0)::INT), 1) FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 0.10, round_even(100.0 * avg((p_size % 3 <> 0)::INT), 1) FROM part GROUP BY p_brand
UNION ALL SELECT server, 0.05, score FROM ({AG8_SQL}) UNION ALL SELECT server, 0.03, score FROM ({AG9_SQL}) UNION ALL SELECT server, 0.02, score FROM ({AG10_SQL}))
SELECT server, round(round(sum(w * score), 6), 1) AS overall FROM x GROUP BY server""")
def ag14_eight_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole score of every brand; parts are its recorded runs as well."""
    p = table(spark, sf_dir, "part")
    runs = p.select(F.col("p_brand").alias("server"), F.col("p_type").alias("gold"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("selected"), (F.col("p_size") % 3 != 0).alias("success"))
    rates = outcomes.percentages(runs, "server")
    scores = axes.together(
        schema_completeness=linting.schema_completeness(tools(spark, sf_dir)), description_quality=ag7_description_quality(spark, sf_dir), discoverability=ag13_discoverability(spark, sf_dir),
        selection_accuracy=rates.select("server", F.col("selection_accuracy").alias("score")), call_correctness=rates.select("server", F.col("call_correctness").alias("score")),
        error_legibility=ag8_error_legibility(spark, sf_dir), robustness=ag9_robustness(spark, sf_dir), docs_manifest=ag10_docs_manifest(spark, sf_dir),
    )
    return linting.overall(scores)


@query("prj21_tool_listing", f"""WITH {TOOLS_SQL} SELECT server, tool, tool || ' — ' || CASE WHEN any_value(description) = '' THEN '(no description)' ELSE any_value(description) END || ' | ' || string_agg(param || CASE WHEN kind = '' THEN '' ELSE ':' || kind END, ', ' ORDER BY param) AS line FROM props GROUP BY server, tool""")
def prj21_tool_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools(spark, sf_dir).select("server", "tool", probes.listing_line().alias("line"))


@query("tk7_flagged_cases", """WITH r AS (SELECT p_brand AS name, avg((p_size % 4 <> 0)::INT) - 0.3 AS rate, sum(length(p_name))::DOUBLE AS len, CASE WHEN min(p_size) % 2 = 0 THEN avg(p_size)::DOUBLE END AS prompt, CASE WHEN max(p_partkey) % 7 <> 0 THEN round(avg(p_retailprice) % 60, 3) END AS axis FROM part GROUP BY p_brand),
s AS (SELECT *, CASE WHEN max(len) OVER () = min(len) OVER () THEN 50.0 ELSE 100 * (len - min(len) OVER ()) / (max(len) OVER () - min(len) OVER ()) END AS scaled FROM r),
g AS (SELECT *, greatest(prompt, scaled) - axis AS gap FROM s WHERE rate <= 0.5 AND axis IS NOT NULL)
SELECT name, 'brand' AS tier, round(rate, 6) AS task_success_rate, 'discoverability' AS axis, axis AS axis_score, round_even(scaled, 1) AS baseline_desc_length_rescaled, round(prompt, 6) AS baseline_single_prompt, round_even(gap, 1) AS gap FROM g WHERE gap > 0 ORDER BY g.gap DESC, name LIMIT 5""")
def tk7_flagged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(
        (F.avg((F.col("p_size") % 4 != 0).cast("double")) - 0.3).alias("task_success_rate"), F.sum(F.length("p_name")).cast("double").alias("baseline_desc_length"),
        F.when(F.min("p_size") % 2 == 0, F.avg("p_size")).alias("baseline_single_prompt"), F.when(F.max("p_partkey") % 7 != 0, F.round(F.avg("p_retailprice") % 60, 3)).alias("discoverability"),
    )
    return rounded(axes.flagged_cases(p.withColumn("tier", F.lit("brand")), "discoverability"))


@query("prj8_corrected_scores", r"""WITH e AS (SELECT event_id, event_type, (event_type = 'click')::INT + regexp_full_match(props, '\{"k": [0-9]\}')::INT + (user_id BETWEEN 10 AND 90)::INT + contains(lower(event_type), 'ie')::INT + (abs(user_id - 50) <= 20)::INT AS s FROM events)
SELECT event_id, round(CASE WHEN event_id % 11 = 0 OR event_type = 'view' OR event_id % 7 = 0 THEN 0.0 WHEN event_type = 'error' THEN 1.0 ELSE s / 6.0 END, 6) AS score FROM e""")
def prj8_corrected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose argument ``user`` has a new name, scored by constraints on the old one."""
    k = F.col("event_id")
    named = F.transform_keys("args", lambda name, _: F.when(name == "user", "user_v2").otherwise(name))
    c = calls(spark, sf_dir).withColumn("kind", F.col("args")["type"]).withColumn("args", named)
    c = c.withColumns({"parse_failed": k % 11 == 0, "selected": F.when(F.col("kind") == "view", "other").otherwise("tool"), "target": F.lit("tool"), "success": k % 7 != 0}).drop("kind")
    return rounded(constraints.corrected(c, spark.createDataFrame([("user", "user_v2")], "old string, new string"), "event_id"))


@query("ag39_several_culprits_guard", """WITH i AS (SELECT l_orderkey AS c, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS pos, l_quantity AS size, l_discount >= 0.08 AS truth FROM lineitem),
d AS (SELECT c, arg_max(truth, (size, -pos)) AS top, max(size) FILTER (NOT truth) AS decoy, min(size) FILTER (truth) AS least FROM i GROUP BY c),
r AS (SELECT a.c, a.pos, (count(*) FILTER (b.size > a.size) + count(*) FILTER (b.size = a.size) / 2) / nullif(count(b.c), 0) AS rank FROM (SELECT *, row_number() OVER () AS id FROM i WHERE truth) a LEFT JOIN i b ON b.c = a.c AND NOT b.truth GROUP BY a.id, a.c, a.pos)
SELECT (SELECT count(*) FROM d) AS n_cases, round((SELECT avg(top::INT) FROM d), 6) AS true_is_largest, round((SELECT avg(coalesce(decoy > least, false)::INT) FROM d), 6) AS decoy_over_least_true, count(*) AS n_true, count(DISTINCT pos) AS n_positions, round(coalesce(avg(rank), 0.5), 6) AS mean_fractional_rank FROM r""")
def ag39_several_culprits_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases whose true items are the lines with a discount of eight percent or more."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("size"), (F.col("l_discount") >= 0.08).alias("truth"))
    return rounded(ranks.several_culprits_guard(li))


def enum_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint for each part: its type is a parameter, one of a list for the smaller parts."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("tool"), F.lower("p_type").alias("param"), F.when(F.col("p_size") < 25, "enum").otherwise("format").alias("kind"), F.col("p_name").alias("gold"))


@query("au3_unlisted_values", """WITH c AS (SELECT p_brand AS tool, lower(p_type) AS param, p_name AS gold FROM part WHERE p_size < 25), s AS (SELECT p_brand AS tool, lower(p_type) AS param, bool_or(p_size % 5 = 0) AS listed FROM part WHERE p_size > 30 GROUP BY ALL)
SELECT 'unlisted_value' AS "check", 'warn' AS severity, tool || '/' || param AS subject, min(gold) AS detail FROM c WHERE tool IN (SELECT tool FROM s) AND (tool, param) NOT IN (SELECT tool, param FROM s WHERE listed) GROUP BY tool, param""")
def au3_unlisted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size > 30")
    schema = p.select(F.col("p_brand").alias("tool"), F.lower("p_type").alias("param"), (F.col("p_size") % 5 == 0).alias("has_choices"))
    return audit.unlisted_values(enum_constraints(spark, sf_dir), schema)


@query("au11_whole_audit", f"""WITH {EVENT_TRIALS_SQL},
tasks AS (SELECT p_brand AS tool, CASE WHEN p_size % 9 = 0 THEN ' ' WHEN p_size % 10 = 0 THEN 'Ask ' || lower(p_brand) ELSE p_name END AS text FROM part),
cons AS (SELECT p_brand AS tool, lower(p_type) AS param, p_size < 25 AS is_enum, p_name AS gold FROM part),
cat AS (SELECT p_brand AS tool, lower(p_type) AS param, bool_or(p_size % 5 = 0) AS listed, v FROM part, (SELECT unnest(['before', 'after']) AS v) WHERE v = 'before' AND p_size > 30 OR v = 'after' AND p_size > 48 GROUP BY ALL),
ct AS (SELECT DISTINCT tool, v FROM cat),
arm AS (SELECT arm, count(*) AS n, avg(joint) AS rate, min(joint) AS lo, max(joint) AS hi FROM trials GROUP BY arm),
k AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1 AS truth FROM part),
kr AS (SELECT truth, (rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY p_brand) - 1, 0) AS f FROM k),
f AS (SELECT 'leaked_name' AS "check", 'block' AS severity, NULL AS variant FROM tasks WHERE contains(lower(text), lower(tool)) UNION ALL SELECT 'blank_text', 'block', NULL FROM tasks WHERE trim(text) = ''
UNION ALL SELECT 'missing_param', 'block', v FROM (SELECT DISTINCT ct.v, cons.tool, cons.param FROM cons JOIN ct USING (tool)) x WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.v = x.v AND cat.tool = x.tool AND cat.param = x.param)
UNION ALL SELECT 'unlisted_value', 'warn', v FROM (SELECT DISTINCT ct.v, cons.tool, cons.param FROM cons JOIN ct USING (tool) WHERE is_enum) x WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.v = x.v AND cat.tool = x.tool AND cat.param = x.param AND listed)
UNION ALL SELECT 'no_description', 'warn', v FROM ct WHERE v = 'after'
UNION ALL SELECT 'catalog_size', 'warn', NULL FROM (SELECT count(*) FILTER (v = 'before') AS b, count(*) FILTER (v = 'after') AS a FROM ct) WHERE least(a, b)::DOUBLE / nullif(greatest(a, b), 0) < 0.5
UNION ALL SELECT 'extreme_rate', 'warn', arm FROM arm WHERE rate <= 0.05 OR rate >= 0.95 UNION ALL SELECT 'no_variance', 'block', arm FROM arm WHERE n >= 2 AND lo = hi
UNION ALL SELECT 'standing_out', 'block', NULL FROM (SELECT count(*) AS n, avg(f) AS m FROM kr WHERE truth AND f IS NOT NULL) WHERE n >= 20 AND abs(m - 0.5) > 0.15)
SELECT "check", severity, variant, count(*) AS n FROM f GROUP BY ALL""")
def au11_whole_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check at once over brands as tools, in two catalogs, with trials and cases; findings counted."""
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 9 == 0, " ").when(F.col("p_size") % 10 == 0, F.concat(F.lit("Ask "), F.lower("p_brand"))).otherwise(F.col("p_name"))
    param = F.struct(F.lower("p_type").alias("name"), (F.col("p_size") % 5 == 0).alias("has_choices"))
    catalog = lambda least, about: p.where(F.col("p_size") > least).groupBy(F.col("p_brand").alias("tool")).agg(F.collect_set(param).alias("params")).withColumn("description", F.lit(about).cast("string"))
    t = trials.with_outcomes(event_trials(spark, sf_dir))
    first = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")) == 1
    found = audit.measured(
        tasks=p.select(F.col("p_brand").alias("tool"), text.alias("text")), constraints=enum_constraints(spark, sf_dir), before=catalog(30, "Parts."), after=catalog(48, None),
        before_trials=t.where("arm = 'before'"), after_trials=t.where("arm = 'after'"), cases=p.select(F.col("p_brand").alias("case_id"), F.col("p_size").alias("size"), first.alias("truth")),
    )
    return found.groupBy("check", "severity", "variant").agg(F.count("*").alias("n"))
