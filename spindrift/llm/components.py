"""Connected components of a link table, by alternating large-star and small-star joins.

Every step is a grouped minimum and a join, so a node of very many links is
pre-aggregated before the shuffle, and nothing but two counts reaches the driver.
Each round is written to the shared folder; the number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_ROUNDS = 60


def _least(pairs: DataFrame) -> DataFrame:
    """For each node ``u`` the least of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component): ``component`` is the least node reachable; only nodes with links.

    ``links`` has two columns of one orderable type; direction and repeats do not
    matter, rows with a null or with equal ends are no link.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = scratch.stage(edges, "links")
    last = None
    for _ in range(MAX_ROUNDS):
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == last:
            break
        last = (n, total)
        after = scratch.stage(_small_star(_large_star(edges)), "star")
        scratch.drop(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
