"""Queries: numbering and zipping, searches by probes, gates, registries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import attribution, audit, gates, numbering, probing, versions
from ..sources import reports
from ..sources.shared import Steps
from ..sources.tables import table
from .registry import query, rounded

THRESHOLD, MARGIN = 0.02, 0.005


@query("jn11_positional_zip", """WITH l AS (SELECT *, l_orderkey * 10 + l_linenumber AS trial FROM lineitem),
b AS (SELECT row_number() OVER (ORDER BY l_shipdate, trial, l_partkey, l_suppkey, l_discount) AS number, trial, l_discount FROM l WHERE l_linestatus = 'F'), a AS (SELECT row_number() OVER (ORDER BY l_shipdate, trial, l_partkey, l_suppkey, l_discount) AS number, trial, l_discount FROM l WHERE l_linestatus <> 'F')
SELECT number, b.trial AS before_trial, a.trial AS after_trial, round(a.l_discount - b.l_discount, 6) AS delta FROM b JOIN a USING (number)""")
def jn11_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished lines beside open ones in the order of shipping."""
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trial"), "l_discount", "l_linestatus", "l_partkey", "l_suppkey")
    order = ["l_shipdate", "trial", "l_partkey", "l_suppkey", "l_discount"]
    z = numbering.zipped(li.where("l_linestatus = 'F'"), li.where("l_linestatus <> 'F'"), order, Steps(spark, "zip"))
    return rounded(z.select("number", F.col("left.trial").alias("before_trial"), F.col("right.trial").alias("after_trial"), (F.col("right.l_discount") - F.col("left.l_discount")).alias("delta")))


@query("jn11_numbered_within", """SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS trial, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS number FROM lineitem""")
def jn11_numbered_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered within three groups, each of them over many tasks."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trial"))
    return numbering.numbered(li, ["trial"], Steps(spark, "numbers"), ["l_returnflag"])


def order_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cases, effects): an order is a case, its lines are the items; lines with a discount of nine percent or more have an effect."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("i"), "l_linenumber").alias("item"), "l_discount", "l_quantity")
    each = F.when(F.col("l_discount") >= 0.09, F.col("l_discount")).otherwise(F.col("l_quantity") / 10000)
    effect = li.groupBy("case_id", "item").agg(F.round(F.sum(each), 4).alias("effect"))
    return li.groupBy("case_id").agg(F.array_sort(F.collect_set("item")).alias("items")), effect


@query("at5_probe_search")
def at5_probe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All culprits of every order, with what ruled the others out and how many probes it took; held against a loop in tests/test_probing.py."""
    cases, effect = order_cases(spark, sf_dir)
    ranking, _ = probing.bisection_search(cases, probing.additive(effect, MARGIN), THRESHOLD, Steps(spark, "bisection"))
    return rounded(ranking)


@query("at3_probe_contrasts")
def at3_probe_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts over drawn coalitions, half as many as an order has lines, with their intervals; held against a loop in tests/test_probing.py."""
    cases, effect = order_cases(spark, sf_dir)
    return rounded(probing.shapley_search(cases, probing.additive(effect, MARGIN), Steps(spark, "contrasts")))


def strategies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rankings, truth) of two strategies over the orders that have a culprit, in buckets by their number of lines."""
    cases, effect = order_cases(spark, sf_dir)
    truth = effect.where("effect >= 0.09").select("case_id", "item")
    e = cases.select("case_id", F.size("items").alias("n"), F.posexplode("items").alias("pos", "item")).join(effect, ["case_id", "item"]).join(truth.select("case_id").distinct(), "case_id")
    bucket = F.concat(F.lit("n="), "n")
    order = Window.partitionBy("case_id")  # an order has a few lines
    ablation = e.select(bucket.alias("bucket"), F.lit("ablation").alias("strategy"), "case_id", "item", F.row_number().over(order.orderBy(F.desc("effect"), "pos")).alias("rank"), "n")
    listed = e.select(bucket.alias("bucket"), F.lit("listed").alias("strategy"), "case_id", "item", (F.col("pos") + 1).alias("rank"), F.lit(0).alias("n"))
    return attribution.union(ablation, listed).withColumnRenamed("n", "probes"), truth


@query("ag41_bucket_scores", """WITH i AS (SELECT l_orderkey AS c, 'i' || l_linenumber AS item, round(sum(CASE WHEN l_discount >= 0.09 THEN l_discount ELSE l_quantity / 10000 END), 4) AS effect FROM lineitem GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY item) AS pos, effect >= 0.09 AS truth FROM i),
k AS (SELECT *, sum(truth::INT) OVER (PARTITION BY c) AS m, row_number() OVER (PARTITION BY c ORDER BY effect DESC, pos) AS ra FROM n),
r AS (SELECT c, n, m, truth, 'ablation' AS strategy, ra AS rank, n AS probes FROM k WHERE m > 0 UNION ALL SELECT c, n, m, truth, 'listed', pos, 0 FROM k WHERE m > 0),
g AS (SELECT n, strategy, c, m, count(*) FILTER (truth AND rank <= 1) AS a, count(*) FILTER (truth AND rank <= 3) AS b, count(*) FILTER (truth AND rank <= m) AS d, max(probes) AS probes FROM r GROUP BY ALL)
SELECT 'n=' || n AS bucket, strategy, count(*) AS n_cases, round(avg((a = m)::INT), 6) AS top1, round(avg((b = m)::INT), 6) AS top3, round(avg(d / m), 6) AS recall_at_m, round(avg(probes), 6) AS mean_probes FROM g GROUP BY n, strategy""")
def ag41_bucket_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probing.bucket_scores(*strategies(spark, sf_dir)))


@query("au13_decision_trace")
def au13_decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the searches' decisions stand to the truth, counted by verdict and size of what was probed; the truth is an order's largest effect."""
    cases, effect = order_cases(spark, sf_dir)
    truth = effect.groupBy("case_id").agg(F.max_by("item", F.struct("effect", "item")).alias("item"))
    _, decisions = probing.bisection_search(cases, probing.additive(effect, MARGIN), THRESHOLD, Steps(spark, "trace"))
    t = probing.traced(decisions, truth)
    return t.groupBy("verdict", F.size("probed").alias("n_probed")).agg(F.count("*").alias("decisions"), F.count_distinct("case_id").alias("cases"))


def findings_of_parts(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cheap = audit.finding(p.where(F.col("p_retailprice") < least), "cheap_part", "block", F.col("p_partkey"), F.col("p_name"))
    return cheap.unionByName(audit.finding(p.where("p_size < 3"), "small_part", "warn", F.col("p_partkey"), F.col("p_name")))


@query("au14_gate", """WITH b AS (SELECT 'blocked' AS outcome, p_partkey::VARCHAR AS subject, 1::BIGINT AS n FROM part WHERE p_retailprice < (SELECT min(p_retailprice) + 1 FROM part))
SELECT * FROM b UNION ALL SELECT 'done', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag""")
def au14_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gates over the parts: one finds blocks and its work is left out, the other finds warnings only and its work is done."""
    work = lambda: table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("subject")).agg(F.count("*").alias("n"))
    least = table(spark, sf_dir, "part").agg(F.min("p_retailprice")).first()[0]
    shut, open_ = gates.gated(findings_of_parts(spark, sf_dir, least + 1), work), gates.gated(findings_of_parts(spark, sf_dir, least), work)
    blocked = shut.blocking.select(F.lit("blocked").alias("outcome"), "subject", F.lit(1).cast("long").alias("n"))
    for gate in (shut, open_):
        if gate.result is not None:
            blocked = blocked.unionByName(gate.result.select(F.lit("done").alias("outcome"), "subject", "n"))
    return blocked


@query("src22_registry_servers", """WITH e AS (SELECT page_id, 'o' || page_id % 40 || '/r' || page_id % 60 AS repo, url FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 3 <> 0)
SELECT replace(repo, '/', '-') AS server_id, repo AS source_repo, arg_min(url, page_id) AS name, '' AS description, 'https://github.com/' || repo AS url FROM e GROUP BY repo""")
def src22_registry_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries of a registry: some elsewhere, some not the latest, some inactive (in turn), several of one repository."""
    k = F.col("page_id")
    address = F.concat(F.lit("https://github.com/o"), k % 40, F.lit("/r"), k % 60, F.when(k % 2 == 0, ".git").otherwise("/tree/main"))
    entries = table(spark, sf_dir, "pages").select(
        k.alias("position"), F.col("url").alias("name"), F.lit(None).cast("string").alias("description"), F.when(k % 7 == 0, "gitlab").otherwise("github").alias("source"),
        address.alias("url"), F.when(k % 5 != 0, True).alias("is_latest"), F.when(k % 3 == 0, "deleted").otherwise("active").alias("status"),
    )
    return versions.registry_servers(entries)


@query("src22_latest_versions", """WITH v AS (SELECT p_name, p_partkey, p_size, p_partkey % 11 AS c, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS rel, p_partkey % 13 AS r FROM part)
SELECT p_name, 'v1.' || p_size || '.' || c || CASE rel WHEN 2 THEN '' WHEN 1 THEN '-rc.' || r ELSE '-' || r END AS version, p_partkey FROM v
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, c DESC, rel DESC, CASE WHEN rel < 2 THEN r END DESC, p_partkey DESC) = 1""")
def src22_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as versions of their name: numbers of several digits, releases, candidates and numbered pre-releases."""
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("-rc."), k % 13)).otherwise(F.concat(F.lit("-"), k % 13))
    p = table(spark, sf_dir, "part").select("p_name", F.concat(F.lit("v1."), "p_size", F.lit("."), k % 11, tail).alias("version"), "p_partkey")
    return versions.latest_versions(p, "p_name", "version")


@query("src27_stable_report", """WITH d AS (SELECT p_brand, p_type, sum(p_size)::DOUBLE AS score FROM part GROUP BY p_brand, p_type)
SELECT row_number() OVER (ORDER BY p_brand) - 1 AS place, p_brand AS server, sum(score) AS overall, count(*)::INTEGER AS n_dimensions FROM d GROUP BY p_brand""")
def src27_stable_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all brands in one JSON file, in order, and what reading it back gives."""
    steps = Steps(spark, "report")
    d = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").cast("double").alias("score"))
    b = d.groupBy("p_brand").agg(F.sum("score").alias("overall"), F.array_sort(F.collect_list(F.struct(F.col("p_type").alias("name"), "score", F.lit(0.5).alias("weight")))).alias("dimensions"))
    line = F.concat(F.lit('{"server": '), F.to_json(F.struct("p_brand")), F.lit(', "report": '), reports.report_document(F.col("overall"), F.col("dimensions")), F.lit("}"))
    at = steps.place("report.json")
    reports.write_in_order(b.select("p_brand", line.alias("text")), ["p_brand"], "text", at, steps, head="[", between=",\n", tail="]\n")
    schema = "server struct<p_brand:string>, report struct<schema_version:string,overall_score:double,dimensions:array<struct<name:string,score:double,weight:double>>>"
    read = spark.read.schema(schema).option("multiLine", True).json(at).withColumn("place", F.monotonically_increasing_id())  # one file, one task, in its order
    return read.select("place", F.col("server.p_brand").alias("server"), F.col("report.overall_score").alias("overall"), F.size("report.dimensions").alias("n_dimensions"))
