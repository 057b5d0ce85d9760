"""Queries: paired outcomes of orders, three-arm recovery, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paired
from ..sources.tables import table
from .registry import query, rounded

#: For each order: did status (a) and all lines (b) come out as 'O'; priority as the family.
OUTCOMES_SQL = """o AS (
  SELECT o_orderkey, any_value(o_orderpriority) AS family, any_value(o_orderstatus) = 'O' AS a, bool_and(l_linestatus = 'O') AS b,
         sum((l_linestatus = 'O')::INT) - sum((l_linestatus <> 'O')::INT) AS delta
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bool_and(F.col("l_linestatus") == "O").alias("b"),
        (F.count_if(F.col("l_linestatus") == "O") - F.count_if(F.col("l_linestatus") != "O")).alias("delta"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("family"), (F.col("o_orderstatus") == "O").alias("a"))
    return o.join(li, "o_orderkey")


@query("ht1_mcnemar", f"""WITH {OUTCOMES_SQL}, c AS (SELECT family, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM o GROUP BY family),
s AS (SELECT *, round(CASE WHEN b + c = 0 THEN 0.0 WHEN b + c < 10 THEN b - c ELSE (abs(b - c) - 1)::DOUBLE ** 2 / (b + c) END, 4) AS statistic FROM c)
SELECT family, b, c, statistic, CASE WHEN b + c < 10 THEN 'too_few' WHEN statistic > 3.841 THEN CASE WHEN b > c THEN 'a_better' ELSE 'b_better' END ELSE 'no_difference' END AS verdict FROM s""")
def ht1_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.mcnemar(outcomes(spark, sf_dir), "a", "b", "family")


@query("ht2_sign_test", f"""WITH {OUTCOMES_SQL}, d AS (SELECT family || (o_orderkey % 40) AS grp, delta FROM o),
c AS (SELECT grp, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses FROM d GROUP BY grp),
t AS (SELECT grp, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) AS tail FROM (SELECT grp, wins + losses AS n, unnest(range(least(wins, losses) + 1)) AS i FROM c) GROUP BY grp)
SELECT grp, wins, losses, CASE WHEN wins + losses = 0 THEN 1.0 ELSE round(least(1.0, 2 * tail), 4) END AS p FROM c JOIN t USING (grp)""")
def ht2_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir).withColumn("grp", F.concat("family", (F.col("o_orderkey") % 40).cast("string")))
    return paired.sign_test(o, "delta", "grp")


@query("ht3_stability", f"""WITH s AS (SELECT l_suppkey, count(*) FILTER (l_linenumber <= 3 AND l_returnflag = 'R') AS first, count(*) FILTER (l_linenumber > 3 AND l_returnflag = 'R') AS second FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, first, second, abs(first - second) <= 1 AS stable FROM s""")
def ht3_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("l_returnflag") == "R"
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(hit & (F.col("l_linenumber") <= 3)).alias("first"), F.count_if(hit & (F.col("l_linenumber") > 3)).alias("second"))
    return s.withColumn("stable", paired.stable(F.col("first"), F.col("second")))


#: Three arms of answers: a task is a customer, the arm goes by the order key; a status of P is not valid.
ARMS_SQL = """r AS (
  SELECT o_custkey AS task, ['a', 'fixed', 'oracle'][(o_orderkey % 3)::INT + 1] AS arm, o_orderstatus <> 'P' AS valid,
         CASE o_orderkey % 3 WHEN 0 THEN o_totalprice > 400000 WHEN 1 THEN o_totalprice > 300000 ELSE o_totalprice > 150000 END AS correct FROM orders)"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey") % 3, F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task"),
        F.when(k == 0, "a").when(k == 1, "fixed").otherwise("oracle").alias("arm"),
        (F.col("o_orderstatus") != "P").alias("valid"),
        F.when(k == 0, price > 400000).when(k == 1, price > 300000).otherwise(price > 150000).alias("correct"),
    )


@query("ag15_parse_accuracy", f"""WITH {ARMS_SQL} SELECT task, arm, coalesce(round(count(*) FILTER (valid AND correct)::DOUBLE / nullif(count(*) FILTER (valid), 0), 6), 0.0) AS accuracy,
  count(*) FILTER (NOT valid) AS parse_failed FROM r GROUP BY task, arm""")
def ag15_parse_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.accuracy(arms(spark, sf_dir), "valid", "correct", "task", "arm"))


@query("ag17_contested_tasks", f"WITH {ARMS_SQL} SELECT task FROM r WHERE arm = 'a' GROUP BY task HAVING count(*) FILTER (valid) > 0 AND count(*) FILTER (valid AND correct) = 0")
def ag17_contested_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.contested(arms(spark, sf_dir).where("arm = 'a'"), "valid", "correct", "task")


@query("pl1_three_arm_recovery", f"""WITH {ARMS_SQL}, hard AS (SELECT task FROM r WHERE arm = 'a' GROUP BY task HAVING count(*) FILTER (valid) > 0 AND count(*) FILTER (valid AND correct) = 0),
x AS (SELECT arm, coalesce(count(*) FILTER (valid AND correct)::DOUBLE / nullif(count(*) FILTER (valid), 0), 0.0) AS acc FROM r WHERE task IN (SELECT task FROM hard) OR arm = 'a' GROUP BY arm),
p AS (SELECT max(acc) FILTER (arm = 'a') AS a, max(acc) FILTER (arm = 'fixed') AS f, max(acc) FILTER (arm = 'oracle') AS o FROM x)
SELECT round(a, 6) AS a, round(f, 6) AS fixed, round(o, 6) AS oracle, round(CASE WHEN abs(o - a) >= 1e-9 THEN (f - a) / (o - a) END, 6) AS recovery FROM p""")
def pl1_three_arm_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery of the contested tasks, against all tasks of the first arm."""
    r = arms(spark, sf_dir)
    hard = paired.contested(r.where("arm = 'a'"), "valid", "correct", "task").withColumn("hard", F.lit(True))
    kept = r.join(hard, "task", "left").where("hard or arm = 'a'")
    x = paired.accuracy(kept, "valid", "correct", "arm")
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("accuracy")))
    p = x.agg(side("a").alias("a"), side("fixed").alias("fixed"), side("oracle").alias("oracle"))
    return rounded(p.withColumn("recovery", paired.recovery(F.col("fixed"), F.col("a"), F.col("oracle"))))


@query("ag27_regime", """WITH r AS (SELECT l_suppkey % 20 AS family, l_suppkey AS task, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS arm, l_returnflag <> 'N' AS valid, l_discount < CASE WHEN l_linenumber % 2 = 0 THEN 0.021 + (l_suppkey % 20) * 0.005 ELSE 0.2 END AS correct FROM lineitem),
t AS (SELECT family, task, arm, coalesce(count(*) FILTER (valid AND correct)::DOUBLE / nullif(count(*) FILTER (valid), 0), 0.0) AS acc FROM r GROUP BY family, task, arm),
b AS (SELECT family, task, max(acc) FILTER (arm = 'a') AS a, max(acc) FILTER (arm = 'b') AS b FROM t GROUP BY family, task),
g AS (SELECT family, count(*) AS n_tasks, avg(a) AS aa, avg(b) AS bb, coalesce(bool_or(a < 1 AND b = 1), false) AS gain FROM b GROUP BY family)
SELECT family, n_tasks, round(aa, 6) AS a_accuracy, round(bb, 6) AS b_accuracy, aa >= 0.85 AS aborted, NOT aa >= 0.85 AND gain AS in_regime FROM g""")
def ag27_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    family = F.col("l_suppkey") % 20
    r = table(spark, sf_dir, "lineitem").select(family.alias("family"), F.col("l_suppkey").alias("task"), F.when(even, "a").otherwise("b").alias("arm"), (F.col("l_returnflag") != "N").alias("valid"), (F.col("l_discount") < F.when(even, 0.021 + family * 0.005).otherwise(0.2)).alias("correct"))
    return rounded(paired.regime(r))


@query("wn15_regression_flips", """WITH t AS (SELECT l_orderkey AS task, l_linestatus = 'F' AS ok, l_shipdate < TIMESTAMP '1998-07-01' AS before, l_returnflag AS picked FROM lineitem),
m AS (SELECT task, avg(ok::INT) FILTER (before) AS b, avg(ok::INT) FILTER (NOT before) AS a FROM t GROUP BY task),
c AS (SELECT task, picked, count(*) AS n FROM t WHERE NOT before AND NOT ok GROUP BY task, picked),
p AS (SELECT task, picked, row_number() OVER (PARTITION BY task ORDER BY n DESC, picked) AS r FROM c)
SELECT m.task, round(b, 6) AS before, round(a, 6) AS after, p.picked AS wrong_pick FROM m LEFT JOIN p ON p.task = m.task AND p.r = 1 WHERE b >= 0.6 AND a < 0.4""")
def wn15_regression_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), (F.col("l_linestatus") == "F").alias("ok"), (F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp")).alias("before"), F.col("l_returnflag").alias("picked"))
    acc = lambda side: t.where(side).groupBy("task").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))
    return rounded(paired.regression_flips(acc("before"), acc("not before"), t.where("not before and not ok")))
