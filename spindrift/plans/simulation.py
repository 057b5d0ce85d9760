"""Queries: attribution over users' event types, and power simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import attribution, power, rng
from ..sources.tables import table
from .comparison import replicates_sql
from .registry import query, rounded

#: A case is a user, its items the event types in their order, an item's effect its share of all value less an equal share.
ITEMS_SQL = """e AS (SELECT user_id AS case_id, event_type AS item, sum(value) AS v FROM events GROUP BY user_id, event_type),
items AS (SELECT case_id, item, row_number() OVER (PARTITION BY case_id ORDER BY item) - 1 AS pos, count(*) OVER (PARTITION BY case_id) AS n,
  round(v / sum(v) OVER (PARTITION BY case_id) - 1.0 / count(*) OVER (PARTITION BY case_id), 9) AS effect FROM e)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("item")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("case_id")
    n = F.count("*").over(w)
    return e.select("case_id", "item", (F.row_number().over(w.orderBy("item")) - 1).cast("long").alias("pos"), n.alias("n"), F.round(F.col("v") / F.sum("v").over(w) - 1.0 / n, 9).alias("effect"))


@query("at1_ablation", f"WITH {ITEMS_SQL} SELECT case_id, item, round(effect, 6) AS delta, row_number() OVER (PARTITION BY case_id ORDER BY effect DESC, pos) AS rank FROM items")
def at1_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    probes = i.select("case_id", F.array("item").alias("coalition"), F.col("effect").alias("delta"))
    return rounded(attribution.ablation(i.drop("effect"), probes))


SHAPLEY_SQL = f"""WITH {ITEMS_SQL}, m AS (SELECT case_id, item, pos, effect, b, {rng.uniform_sql('b * n + pos + 1')} < 0.5 AS inside FROM items, range(8) AS g(b)),
p AS (SELECT case_id, b, sum(CASE WHEN inside THEN effect ELSE 0.0 END) AS v, list_sort(list(item) FILTER (inside)) AS c FROM m GROUP BY case_id, b),
u AS (SELECT case_id, count(DISTINCT c) AS probes FROM p WHERE len(c) > 0 GROUP BY case_id),
g AS (SELECT m.case_id, item, pos, coalesce(avg(v) FILTER (inside), 0) - sum(CASE WHEN inside THEN 0 ELSE v END) / (count(*) FILTER (NOT inside) + 1) AS delta FROM m JOIN p ON p.case_id = m.case_id AND p.b = m.b GROUP BY m.case_id, item, pos)
SELECT g.case_id, item, round(delta, 6) AS delta, row_number() OVER (PARTITION BY g.case_id ORDER BY round(delta, 9) DESC, pos) AS rank, coalesce(probes, 0) AS probes FROM g LEFT JOIN u ON u.case_id = g.case_id"""


@query("at3_sampled_shapley", SHAPLEY_SQL)
def at3_sampled_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    out = attribution.sampled_shapley(i.drop("effect"), i.select("case_id", "item", "effect"), 8)
    pos = i.select("case_id", "item", "pos")
    again = out.join(pos, ["case_id", "item"]).withColumn("delta", F.round("delta", 9))
    return rounded(attribution.ranked(again.drop("rank"), "case_id", "delta", "pos").select("case_id", "item", "delta", "rank", "probes"))


def bisect_sql(name: str, start: str) -> str:
    """Tables ``name``_s0 to ``name``: the culprit of each case of ``start``, three halvings, margin 0.005, threshold 0.02."""
    out = f"{name}_s0 AS (SELECT case_id, item, pos, effect FROM {start})"
    for k in range(3):
        out += f""", {name}_m{k} AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) <= floor(count(*) OVER (PARTITION BY case_id) / 2.0) AS h, count(*) OVER (PARTITION BY case_id) AS c FROM {name}_s{k}),
  {name}_s{k + 1} AS (SELECT case_id, item, pos, effect FROM (SELECT *, sum(CASE WHEN h THEN effect ELSE 0.0 END) OVER (PARTITION BY case_id) - 0.005 > 0.02 AS hit FROM {name}_m{k}) WHERE c = 1 OR h = hit)"""
    return out + f", {name} AS (SELECT case_id, item, effect FROM {name}_s3 WHERE effect - 0.005 > 0.02)"


@query("at4_bisection", f"WITH {ITEMS_SQL}, {bisect_sql('a', 'items')} SELECT case_id, item, round(effect, 6) AS effect FROM a")
def at4_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return rounded(attribution.bisection(i.drop("effect"), i.select("case_id", "item", "effect"), 0.02, levels=3, margin=0.005))


@query("at5_greedy_bisection", f"""WITH {ITEMS_SQL}, {bisect_sql('a', 'items')},
rest AS (SELECT i.* FROM items i JOIN a ON a.case_id = i.case_id WHERE i.item <> a.item), {bisect_sql('b', 'rest')}
SELECT case_id, 1 AS found, item, round(effect, 6) AS effect FROM a UNION ALL SELECT case_id, 2, item, round(effect, 6) FROM b""")
def at5_greedy_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return rounded(attribution.greedy_bisection(i.drop("effect"), i.select("case_id", "item", "effect"), 0.02, levels=3, margin=0.005, culprits=2))


@query("at6_largest_change", """WITH c AS (SELECT p_brand AS case_id, p_partkey::VARCHAR AS item, p_partkey AS pos, p_name AS b, replace(p_name, ' ', lower(p_type)) AS a FROM part)
SELECT case_id, item, levenshtein(b, a) AS distance, row_number() OVER (PARTITION BY case_id ORDER BY levenshtein(b, a) DESC, pos) AS rank FROM c""")
def at6_largest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("case_id"), F.col("p_partkey").cast("string").alias("item"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("b"), F.replace(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("a"))
    return attribution.largest_change(p, "b", "a")


@query("tk2_top_k_hits", f"""WITH {ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY effect DESC, pos) AS rank, row_number() OVER (PARTITION BY case_id ORDER BY abs(effect) DESC, pos) <= 2 AS truth FROM items)
SELECT case_id, bool_and(rank <= 1) AS top1, bool_and(rank <= 3) AS top3, round(avg((rank <= 1)::INT), 6) AS recall1, round(avg((rank <= 3)::INT), 6) AS recall3 FROM r WHERE truth GROUP BY case_id""")
def tk2_top_k_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    truth = i.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.abs("effect")), "pos"))).where("_r <= 2").select("case_id", "item")
    return rounded(attribution.hits(attribution.ranked(i, "case_id", "effect", "pos"), truth))


@query("tk5_random_hits", """SELECT n_nationkey + 2 AS n, n_regionkey % 3 + 1 AS m, round(least(3.0, n_nationkey + 2) / (n_nationkey + 2), 6) AS top3,
  round(CASE n_regionkey % 3 + 1 WHEN 1 THEN least(1.0, 3.0 / n) WHEN 2 THEN least(1.0, 3.0 / n * 2.0 / greatest(1.0, n - 1)) ELSE least(1.0, 3.0 / n * 2.0 / greatest(1.0, n - 1) * 1.0 / greatest(1.0, n - 2)) END, 6) AS strict3
FROM (SELECT *, n_nationkey + 2 AS n FROM nation)""")
def tk5_random_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).alias("n"), (F.col("n_regionkey") % 3 + 1).alias("m"))
    return rounded(t.select("n", "m", attribution.random_hit(F.col("n"), 3).alias("top3"), attribution.random_hit(F.col("n"), 3, F.col("m")).alias("strict3")))


@query("tk9_shuffle", f"WITH {ITEMS_SQL} SELECT case_id, item, row_number() OVER (PARTITION BY case_id ORDER BY {rng.uniform_sql('pos + 1')}, pos) AS rank FROM items")
def tk9_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.shuffled(items(spark, sf_dir)).select("case_id", "item", "rank")


def pairs_sql(sims: int, tasks: int, delta: float) -> str:
    z = [rng.normal_sql(f"i * 48 + {12 * k + 1}", "server + 42") for k in range(4)]
    q = (1 - power.RHO * power.RHO) ** 0.5
    return f"""z AS (SELECT id // {tasks} AS server, id % {tasks} AS i, {tasks} AS n FROM range({sims * tasks}) AS g(id)),
zz AS (SELECT server, i, n, {', '.join(f'{x} AS z{k}' for k, x in enumerate(z))} FROM z),
tp AS (SELECT server, i, n, least(1.0, greatest(0.0, {power.RATE} + {power.TASK_SD} * z0)) AS b, least(1.0, greatest(0.0, {power.RATE + delta} + {power.TASK_SD} * ({power.RHO} * z0 + {q!r} * z1))) AS a, z2, z3 FROM zz),
tasks AS (SELECT server, i, n, least(1.0, greatest(0.0, b + {power.RESIDUAL_SD} * z2)) AS before, least(1.0, greatest(0.0, a + {power.RESIDUAL_SD} * z3)) AS after FROM tp)"""


@query("sm1_task_pairs", f"WITH {pairs_sql(10, 50, -0.1)} SELECT server, i, round(before, 6) AS before, round(after, 6) AS after FROM tasks")
def sm1_task_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power.task_pairs(spark, 10, 50, -0.1).drop("n"))


@query("sm3_task_mde", f"""WITH {pairs_sql(40, 50, -0.1)}, vals AS (SELECT server, i, n, after - before AS x FROM tasks), {replicates_sql('vals', 200)}
SELECT 50 AS n_tasks, round(avg((lo > 0 OR hi < 0)::INT), 6) AS power FROM ci""")
def sm3_task_mde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of the bisection: the power at a drop of ten points."""
    return rounded(power.detected(power.task_pairs(spark, 40, 50, -0.1)).select(F.lit(50).alias("n_tasks"), "power"))


@query("sm5_sequential")
def sm5_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and mean stopping size of a sequential design; draws depend on the data, so SQL cannot follow."""
    s = power.sequential(spark, -0.15)
    return s.groupBy("verdict").agg(F.count("*").alias("n"), F.avg("stopped_at").alias("mean_n"), F.median("stopped_at").alias("median_n"))
