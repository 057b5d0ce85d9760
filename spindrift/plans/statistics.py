"""Queries: ranks, correlations, variance decompositions, strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks
from ..sources.tables import table
from .registry import query, rounded

FIELDS = ["l_extendedprice", "l_discount", "l_tax"]


@query("wn1_average_rank", """SELECT l_returnflag, l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_quantity)
  + (count(*) OVER (PARTITION BY l_returnflag, l_suppkey, l_quantity) - 1) / 2.0 AS avg_rank FROM lineitem""")
def wn1_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = ranks.dealt(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), "l_returnflag", "l_suppkey")
    return li.select("l_returnflag", "l_orderkey", "l_linenumber", ranks.average_rank("l_quantity", "l_returnflag", "l_suppkey").alias("avg_rank"))


@query("wn3_fractional_rank", """WITH c AS (SELECT p_brand, p_partkey, length(p_name) + p_size AS diff FROM part),
r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY diff DESC) + (count(*) OVER (PARTITION BY p_brand, diff) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM c)
SELECT p_brand, p_partkey, round(CASE WHEN n > 1 THEN (k - 1) / (n - 1) END, 6) AS fractional_rank FROM r""")
def wn3_fractional_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.length("p_name") + F.col("p_size")).alias("diff"))
    return rounded(c.select("p_brand", "p_partkey", ranks.fractional_rank("diff", "p_brand").alias("fractional_rank")))


@query("wn7_percentiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.975), 6) AS p975 FROM lineitem GROUP BY l_returnflag""")
def wn7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(ranks.percentiles(li, "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p975": 0.975}, "l_returnflag"))


@query("wn8_terciles", """WITH s AS (SELECT s_suppkey, s_acctbal FROM supplier), c AS (SELECT quantile_cont(s_acctbal, 0.33) AS a, quantile_cont(s_acctbal, 0.67) AS b FROM s)
SELECT s_suppkey, CASE WHEN s_acctbal >= b THEN 'high' WHEN s_acctbal >= a THEN 'mid' ELSE 'low' END AS tier FROM s, c""")
def wn8_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.tercile(table(spark, sf_dir, "supplier"), "s_acctbal").select("s_suppkey", "tier")


@query("wn11_stratified_pick", """WITH c AS (SELECT quantile_cont(s_acctbal, 0.33) AS a, quantile_cont(s_acctbal, 0.67) AS b FROM supplier),
t AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal >= b THEN 'high' WHEN s_acctbal >= a THEN 'mid' ELSE 'low' END AS tier FROM supplier, c WHERE s_suppkey % 7 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY s_suppkey) AS k FROM t)
SELECT s_suppkey, tier, row_number() OVER (ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, k) AS place FROM r WHERE k <= 4""")
def wn11_stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of each stratum, anchors (ids divisible by 7) left out, numbered in stratum order."""
    t = ranks.tercile(table(spark, sf_dir, "supplier"), "s_acctbal").where("s_suppkey % 7 <> 0")
    k = t.withColumn("k", F.row_number().over(Window.partitionBy("tier").orderBy("s_suppkey"))).where("k <= 4")
    order = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "mid", 1).otherwise(2)
    return k.select("s_suppkey", "tier", F.row_number().over(Window.orderBy(order, "k")).alias("place"))


@query("prj17_rescaled", """SELECT s_nationkey, s_suppkey, round(CASE WHEN max(s_acctbal) OVER w = min(s_acctbal) OVER w THEN 50.0
  ELSE 100 * (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) END, 6) AS scaled FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def prj17_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", ranks.rescaled("s_acctbal", "s_nationkey").alias("scaled")))


LONG_SQL = "long AS (SELECT l_returnflag, l_quantity AS y, unnest([{'f': 'l_extendedprice', 'x': l_extendedprice}, {'f': 'l_discount', 'x': l_discount}, {'f': 'l_tax', 'x': l_tax}]) AS p FROM lineitem)"


@query("cr1_pearson", f"WITH {LONG_SQL} SELECT p.f AS field, l_returnflag, count(*) AS n, round(coalesce(corr(p.x, y), 0), 6) AS r FROM long GROUP BY p.f, l_returnflag")
def cr1_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(ranks.pearson(ranks.unpivoted(li, "l_returnflag", "l_quantity", FIELDS), "field", "l_returnflag"))


RANKED_SQL = f"""{LONG_SQL},
ranked AS (SELECT p.f AS field, l_returnflag, rank() OVER (PARTITION BY p.f, l_returnflag ORDER BY p.x) + (count(*) OVER (PARTITION BY p.f, l_returnflag, p.x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY p.f, l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY p.f, l_returnflag, y) - 1) / 2.0 AS ry FROM long)"""


@query("cr2_spearman", f"WITH {RANKED_SQL} SELECT field, l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS r FROM ranked GROUP BY field, l_returnflag")
def cr2_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(ranks.spearman(ranks.unpivoted(li, "l_returnflag", "l_quantity", FIELDS), "field", "l_returnflag"))


@query("cr2_spearman_p")
def cr2_spearman_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two-tailed p and both corrections; the p needs a special function that SQL lacks."""
    li = table(spark, sf_dir, "lineitem")
    rho = ranks.spearman(ranks.unpivoted(li, "l_returnflag", "l_quantity", FIELDS), "field", "l_returnflag")
    return ranks.adjusted_p(ranks.with_p(rho), key="l_returnflag")


@query("cr4_correlation_table", """WITH c AS (SELECT o_orderstatus, avg(o_totalprice) AS price, count(*)::DOUBLE AS n, avg(extract(year FROM o_orderdate)) AS year, 1.0 AS flat, o_custkey % 50 AS k
  FROM orders GROUP BY o_orderstatus, o_custkey % 50),
long AS (SELECT unnest([{'f': 'price', 'x': price}, {'f': 'year', 'x': year}, {'f': 'flat', 'x': flat}]) AS p, n AS y FROM c),
r AS (SELECT p.f AS field, p.x AS x, y, rank() OVER (PARTITION BY p.f ORDER BY p.x) + (count(*) OVER (PARTITION BY p.f, p.x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY p.f ORDER BY y) + (count(*) OVER (PARTITION BY p.f, y) - 1) / 2.0 AS ry FROM long),
t AS (SELECT field, count(*) AS n, CASE WHEN count(*) < 3 THEN 'insufficient_n' WHEN min(x) = max(x) OR min(y) = max(y) THEN 'degenerate' ELSE 'ok' END AS status, corr(rx, ry) AS rho FROM r GROUP BY field)
SELECT field, n, status, CASE WHEN status = 'ok' THEN round(rho, 6) END AS spearman,
  CASE WHEN status <> 'ok' THEN NULL WHEN abs(rho) > 0.5 THEN 'large' WHEN abs(rho) > 0.3 THEN 'medium' WHEN abs(rho) > 0.1 THEN 'small' ELSE 'negligible' END AS strength FROM t""")
def cr4_correlation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 50)
    c = o.groupBy("o_orderstatus", "k").agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n"), F.avg(F.year("o_orderdate")).alias("year"), F.lit(1.0).alias("flat"))
    return rounded(ranks.correlation_table(c, "k", "n", ["price", "year", "flat"]))


@query("cr5_partial_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS b, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS c FROM lineitem),
k AS (SELECT count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r)
SELECT n, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS rho, n - 3 AS df FROM k""")
def cr5_partial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.partial_spearman(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_discount"))


@query("cr6_corrected_p", """WITH t AS (SELECT n_regionkey, n_nationkey, (n_nationkey * 37 % 101 + 1) / 500.0 AS p FROM nation),
r AS (SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS m, row_number() OVER (PARTITION BY n_regionkey ORDER BY p) AS i FROM t),
q AS (SELECT *, least(1.0, p * m / i) AS q FROM r)
SELECT n_regionkey, n_nationkey, round(least(1.0, p * m), 6) AS bonferroni, round(min(q) OVER (PARTITION BY n_regionkey ORDER BY i DESC), 6) AS benjamini_hochberg FROM q""")
def cr6_corrected_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both corrections for many tests, families being regions."""
    t = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", ((F.col("n_nationkey") * 37 % 101 + 1) / 500.0).alias("p"))
    return rounded(ranks.adjusted_p(t, key="n_regionkey").drop("p"))


@query("ag34_icc", """WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY l_suppkey),
t AS (SELECT count(*) AS k, sum(n) AS total, sum(n * m) AS s, sum(n * m * m) AS ss, sum(n * v) AS w, sum(n::DOUBLE * n) AS n2, avg((v < 1e-9)::INT) AS z FROM g),
c AS (SELECT *, (ss - s * s / total) / (k - 1) AS msb, w / (total - k) AS msw, (total - n2 / total) / (k - 1) AS n0 FROM t),
i AS (SELECT *, (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM c)
SELECT k, total::BIGINT AS total, round(n0, 6) AS n0, round(icc, 6) AS icc, round(1 + (total / k - 1) * icc, 6) AS design_effect, round(total / (1 + (total / k - 1) * icc), 6) AS n_eff, round(z, 6) AS zero_variance_share FROM i""")
def ag34_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.icc(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity"))


@query("ag35_nested_variance", """WITH x AS (SELECT l_quantity AS v, avg(l_quantity) OVER () AS g, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS o, avg(l_quantity) OVER (PARTITION BY l_returnflag, l_suppkey) AS i FROM lineitem),
s AS (SELECT sum((v - g) ** 2) AS total, sum((o - g) ** 2) AS a, sum((i - o) ** 2) AS b, sum((v - i) ** 2) AS c FROM x)
SELECT round(total, 3) AS total, round(a / total, 6) AS set_share, round(b / total, 6) AS task_share, round(c / total, 6) AS trial_share FROM s""")
def ag35_nested_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranks.nested_shares(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "l_quantity")
    return rounded(out.withColumn("total", F.round("total", 3)))


@query("ag38_confound_guard", """WITH c AS (SELECT p_brand AS case_id, p_partkey, length(p_name) AS diff, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
r AS (SELECT *, (rank() OVER (PARTITION BY case_id ORDER BY diff DESC) + (count(*) OVER (PARTITION BY case_id, diff) - 1) / 2.0 - 1) / nullif(n - 1, 0) AS fr,
  max(diff) OVER (PARTITION BY case_id) AS top, sum(diff) OVER (PARTITION BY case_id) AS s FROM c)
SELECT count(*) AS n_cases, round(avg((diff = top)::INT), 6) AS max_diff_share, round(avg(fr), 6) AS mean_fractional_rank, round(avg(diff), 6) AS mean_culprit_diff, round(avg((s - diff)::DOUBLE / nullif(n - 1, 0)), 6) AS mean_decoy_diff FROM r WHERE pos = 1""")
def ag38_confound_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the true item (the first of a brand) stands out by the size of its change."""
    w = Window.partitionBy("case_id")
    c = table(spark, sf_dir, "part").select(F.col("p_brand").alias("case_id"), "p_partkey", F.length("p_name").alias("diff"))
    c = c.withColumns({"pos": F.row_number().over(w.orderBy("p_partkey")), "n": F.count("*").over(w), "fr": ranks.fractional_rank("diff", "case_id"), "top": F.max("diff").over(w), "s": F.sum("diff").over(w)})
    out = c.where("pos = 1").agg(F.count("*").alias("n_cases"), F.avg((F.col("diff") == F.col("top")).cast("double")).alias("max_diff_share"), F.avg("fr").alias("mean_fractional_rank"), F.avg("diff").alias("mean_culprit_diff"), F.avg(F.try_divide(F.col("s") - F.col("diff"), F.col("n") - 1)).alias("mean_decoy_diff"))
    return rounded(out)
