"""Approximate nearest neighbours by cosine: NN-descent on Spark joins, then greedy graph search.

Distinct vectors are the nodes. Trees of hyperplanes, fitted on a bounded sample,
deal all nodes into small groups for a first graph of ``K`` neighbours a node.
Each round of NN-descent joins every node's neighbours and reverse neighbours with
their vectors and compares them with each other, so neighbours of neighbours meet;
a node keeps its best. Vectors travel as bytes there (one byte a component). Rounds
go on until one changes hardly an edge, so larger tables get more of them.

A query starts at its own node and expands the nodes of its beam whose neighbours
it has not seen, a round at a time. New nodes are compared where their vectors
lie: nodes are dealt into blocks of bounded size, and a block gets the vector of a
query once. The result is scored again in double precision on the given vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions

K = 20  # neighbours of a node in the graph
ROUNDS = 15  # of NN-descent at most
SETTLED = 0.01  # share of edges that a round changes, at or below which the graph is done
BEAM = 250  # nodes that a query keeps and expands
SEARCH_ROUNDS = 12
TREES = 3
SAMPLE = 4096  # vectors that the trees are fitted on at most
GROUP = 300  # nodes compared with each other at most, about, in the first graph
BLOCK = 8192  # vectors in a block, about
ASKED = 1 << 20  # comparisons in a group of a block's queries, about


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): rows whose vector is not null, empty, zero, or broken by nulls or non-finite numbers; zeros fill shorter ones up."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & v.isNotNull() & fine)
    least, most = rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if least == most:
        return rows
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("vec"))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that nothing over- or underflows."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, unit, bytes): distinct vectors under their least id; float32 and one-byte units."""
    distinct = vectors.groupBy("vec").agg(F.min("id").alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column("vec"))).astype("<f4")
                small = np.rint(unit * (127 / np.abs(unit).max(1, keepdims=True))).astype(np.int8)
                yield pa.record_batch([b.column("node"), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array([s.tobytes() for s in small], pa.binary())], names=["node", "unit", "bytes"])

    return distinct.mapInArrow(run, "node long, unit binary, bytes binary")


def _from_binary(values: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _small_units(values: list[bytes]) -> np.ndarray:
    m = _from_binary(values, "i1").astype(np.float32)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


class Tree:
    """Splits of a sample by random hyperplanes at the median, down to leaves."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self._split(sample, leaf, rng, 0)

    def _split(self, sample: np.ndarray, leaf: int, rng: np.random.Generator, depth: int) -> int:
        """The number of the new inner node, or of the new leaf as -1 - leaf."""
        if len(sample) > leaf and depth < 40:
            a, b = rng.choice(len(sample), 2, replace=False)
            plane = sample[a] - sample[b]
            side = sample @ plane
            cut = float(np.median(side))
            if 0 < (side > cut).sum() < len(sample):
                k = len(self.planes)
                self.planes.append(plane)
                self.cuts.append(cut)
                self.children.append([0, 0])
                self.children[k][0] = self._split(sample[side <= cut], leaf, rng, depth + 1)
                self.children[k][1] = self._split(sample[side > cut], leaf, rng, depth + 1)
                return k
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, m: np.ndarray) -> np.ndarray:
        if not self.planes:
            return np.zeros(len(m), np.int64)
        planes, cuts, children = np.array(self.planes), np.array(self.cuts), np.array(self.children)
        at = np.zeros(len(m), np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            side = np.einsum("ij,ij->i", m[inner], planes[at[inner]]) > cuts[at[inner]]
            at[inner] = children[at[inner], side.astype(int)]
        return -1 - at


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal consecutive keys, across batches; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            v = b.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for first, last in zip(edges, edges[1:]):
            part = b.slice(first, last - first)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


EDGES = "node long, nbr long, sim float"


def _edges(node: list[np.ndarray], nbr: list[np.ndarray], sim: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x), t)
    return pa.record_batch([cat(node, pa.int64()), cat(nbr, pa.int64()), cat(sim, pa.float32())], names=["node", "nbr", "sim"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest neighbours of each node."""
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    return edges.groupBy("node", "nbr").agg(F.max("sim").alias("sim")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def first_graph(scratch: Scratch, nodes: DataFrame, k: int = K) -> DataFrame:
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("bytes").collect()  # SAMPLE rows at most
    units = _small_units([bytes(r["bytes"]) for r in sample])
    n = nodes.count()
    leaf = max(16, int(len(units) * min(1.0, GROUP / max(1, n))))
    trees = [Tree(units, leaf, seed) for seed in range(TREES)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _small_units(b.column("bytes").to_pylist())
            for t, tree in enumerate(trees):
                yield pa.record_batch([pa.array(np.full(len(m), t, np.int32)), pa.array(tree.leaf_of(m)), b.column("node"), b.column("bytes")], names=["tree", "leaf", "node", "bytes"])

    dealt = scratch.stage(nodes.select("node", "bytes").mapInArrow(assign, "tree int, leaf long, node long, bytes binary"), "leaves")
    pieces = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(float(GROUP * 2))).cast("long").alias("pieces"))
    # A leaf that has outgrown the group size is dealt out evenly by a hash.
    grouped = dealt.join(pieces, ["tree", "leaf"]).withColumn("piece", F.pmod(F.xxhash64("node", "tree"), F.col("pieces"))).drop("pieces")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["tree", "leaf", "piece"]):
            ids = t.column("node").to_numpy()
            if len(ids) < 2:
                continue
            m = _small_units(t.column("bytes").to_pylist())
            sims = m @ m.T
            np.fill_diagonal(sims, -2)
            near = min(k, len(ids) - 1)
            at = np.argpartition(-sims, near - 1, axis=1)[:, :near]
            yield _edges([np.repeat(ids, near)], [ids[at].reshape(-1)], [np.take_along_axis(sims, at, 1).reshape(-1)])

    keys = ["tree", "leaf", "piece"]
    edges = grouped.repartition(partitions(scratch.spark), *keys).sortWithinPartitions(*keys).mapInArrow(compare, EDGES)
    return scratch.stage(_best(edges, k), "graph")


def descend(scratch: Scratch, nodes: DataFrame, graph: DataFrame, round_: int, k: int = K) -> DataFrame:
    """One round of NN-descent."""
    back = graph.select(F.col("nbr").alias("hub"), F.col("node").alias("member"))
    mixed = Window.partitionBy("hub").orderBy(F.xxhash64("member", F.lit(round_)))
    back = back.withColumn("_r", F.row_number().over(mixed)).where(F.col("_r") <= k).drop("_r")
    members = graph.select(F.col("node").alias("hub"), F.col("nbr").alias("member")).unionByName(back).distinct()
    worst = graph.groupBy("node").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    known = nodes.select("node", "bytes").join(worst, "node", "left").select(F.col("node").alias("member"), "bytes", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    carried = members.join(known, "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        held = 0
        for t in _runs(batches, ["hub"]):
            ids = t.column("member").to_numpy()
            if len(ids) < 2:
                continue
            m = _small_units(t.column("bytes").to_pylist())
            sims = m @ m.T
            np.fill_diagonal(sims, -3)
            a, b = np.nonzero(sims > t.column("worst").to_numpy()[:, None])
            for to, x in zip(out, (ids[a], ids[b], sims[a, b])):
                to.append(x)
            held += len(a)
            if held > 200_000:
                yield _edges(*out)
                out, held = ([], [], []), 0
        if held:
            yield _edges(*out)

    dealt = carried.repartition(partitions(scratch.spark), "hub").sortWithinPartitions("hub").mapInArrow(compare, EDGES)
    return scratch.stage(_best(graph.unionByName(dealt), k), "graph")


def search_lists(graph: DataFrame, k: int = K) -> DataFrame:
    """(node, nbrs): a node's own nearest and the ``k`` most similar of those that name it."""
    back = graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim")
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    back = back.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("node", "nbr")
    return graph.select("node", "nbr").unionByName(back).groupBy("node").agg(F.collect_set("nbr").alias("nbrs"))


def _dealt(asked: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``piece``: a block's queries by a hash into groups of about ASKED comparisons, its vectors once for each."""
    pieces = asked.groupBy("block").agg(F.ceil(F.sum(F.size("cands") + 64) / F.lit(float(ASKED))).cast("long").alias("pieces"))
    some = asked.join(pieces, "block").withColumn("piece", F.pmod(F.xxhash64("q", "block"), F.col("pieces"))).drop("pieces")
    return some, blocks.join(pieces, "block").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")


def _search(scratch: Scratch, nodes: DataFrame, graph: DataFrame, starts: DataFrame, beam: int, rounds: int) -> DataFrame:
    """(node, found): for each start node the nodes of its beam."""
    lists = scratch.stage(search_lists(graph), "lists")
    n_blocks = max(1, nodes.count() // BLOCK)
    block = F.pmod(F.xxhash64("node"), F.lit(n_blocks))
    blocks = scratch.stage(nodes.select(block.alias("block"), "node", "unit"), "blocks")
    state = starts.select("node", F.array("node").alias("fresh"), F.array("node").alias("seen"), F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"))
    state = scratch.stage(state, "state")
    units = nodes.select("node", "unit")

    def evaluate(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"q": [], "ids": [], "sims": []})
        order = np.argsort(vectors["node"].to_numpy())
        ids = vectors["node"].to_numpy()[order]
        m = _from_binary(vectors["unit"].tolist(), "<f4")[order]
        sims = []
        for unit, cands in zip(queries["unit"], queries["cands"]):
            sims.append(m[np.searchsorted(ids, cands)] @ np.frombuffer(unit, "<f4"))
        return pd.DataFrame({"q": queries["q"], "ids": queries["cands"], "sims": sims})

    for _ in range(rounds):
        expand = state.select(F.col("node").alias("q"), F.explode("fresh").alias("node"))
        reached = expand.join(lists, "node").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("cands"))
        reached = reached.join(state.select(F.col("node").alias("q"), "seen"), "q").select("q", F.array_except("cands", "seen").alias("cands")).where(F.size("cands") > 0)
        reached = scratch.stage(reached, "reached")
        if reached.isEmpty():
            break
        asked = reached.select("q", F.explode("cands").alias("node")).withColumn("block", block).groupBy("block", "q").agg(F.collect_list("node").alias("cands"))
        asked = scratch.stage(asked, "asked")
        some, vectors = _dealt(asked.join(units.withColumnRenamed("node", "q"), "q").select("block", "q", "unit", "cands"), blocks)
        met = some.groupBy("block", "piece").cogroup(vectors.groupBy("block", "piece")).applyInPandas(evaluate, "q long, ids array<long>, sims array<float>")
        new = met.groupBy("q").agg(F.flatten(F.collect_list("ids")).alias("new_ids"), F.flatten(F.collect_list("sims")).alias("new_sims"))
        joined = state.join(new.withColumnRenamed("q", "node"), "node", "left")

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    new = np.array(r["new_ids"] or [], np.int64)
                    ids = np.concatenate([np.array(r["ids"], np.int64), new])
                    sims = np.concatenate([np.array(r["sims"], np.float32), np.array(r["new_sims"] or [], np.float32)])
                    top = np.lexsort((ids, -sims))[:beam]
                    fresh = np.intersect1d(ids[top], new)
                    out.append((r["node"], fresh.tolist(), r["seen"] + new.tolist(), ids[top].tolist(), sims[top].tolist()))
                if out:
                    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float32())]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["node", "fresh", "seen", "ids", "sims"])

        before = state
        state = scratch.stage(joined.mapInArrow(advance, before.schema), "state")
        scratch.drop(before, reached, asked)
    return state.select("node", F.col("ids").alias("found"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: Column | None = None, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` nearest rows found for every query row.

    ``queries`` is a condition on the column ``id``; by default ids divisible by 50.
    Rows whose id or vector is null, whose vector is zero, empty, or holds a null or
    a non-finite number take no part; a vector that is shorter than others counts as if
    zeros followed. Equal vectors are
    one node of the graph and each a candidate, ties going to the smaller id. A query
    never finds its own id; of rows repeated under one id, one counts. Fewer than
    ``top`` candidates give fewer rows; an empty table gives none.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = scratch.stage(usable(vectors, id_col, vector_col).dropDuplicates(["id"]), "vectors")
    nodes = scratch.stage(nodes_of(rows), "nodes")
    empty = "query_id long, rank int, vec_id long, score double"
    if nodes.isEmpty():
        return scratch.spark.createDataFrame([], empty)
    graph = first_graph(scratch, nodes)
    for r in range(rounds):
        before, graph = graph, descend(scratch, nodes, graph, r)
        changed, edges = graph.join(before.select("node", "nbr"), ["node", "nbr"], "left_anti").count(), graph.count()
        scratch.drop(before)
        if changed <= SETTLED * edges:
            break

    # The top + 1 least ids of each node are enough: others of the node tie and are larger. Salted, as one vector may be very common.
    distinct = rows.groupBy("vec").agg(F.min("id").alias("node"))
    of = rows.join(distinct, "vec").select("id", "node")
    salt = F.pmod("id", F.lit(partitions(scratch.spark)))
    some = of.withColumn("_r", F.row_number().over(Window.partitionBy("node", salt).orderBy("id"))).where(F.col("_r") <= top + 1)
    members = some.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("_r") <= top + 1).select("node", "id")
    members = scratch.stage(members, "members")
    asked = scratch.stage(of.where(queries if queries is not None else F.col("id") % 50 == 0), "asked")

    found = _search(scratch, nodes, graph, asked.select("node").distinct(), beam, SEARCH_ROUNDS)
    near = found.select("node", F.explode(F.slice(F.col("found"), 1, 3 * top)).alias("cand")).unionByName(found.select("node", F.col("node").alias("cand")))
    vec_of = distinct.select("node", "vec")
    scored = near.join(vec_of.withColumnRenamed("vec", "a"), "node").join(vec_of.select(F.col("node").alias("cand"), F.col("vec").alias("b")), "cand")
    cosine = F.try_divide(_dot(F.col("a"), F.col("b")), F.sqrt(_dot(F.col("a"), F.col("a"))) * F.sqrt(_dot(F.col("b"), F.col("b"))))
    scored = scratch.stage(scored.select("node", "cand", cosine.alias("score")), "scored")
    pairs = asked.withColumnRenamed("id", "query_id").join(scored, "node").join(members.select(F.col("node").alias("cand"), F.col("id").alias("vec_id")), "cand").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
