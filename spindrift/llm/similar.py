"""One document of each group linked at a Jaccard similarity of 0.8 or more of word shingles.

Candidates first meet by their SimHashes: sets whose 64-bit fingerprints are linked by
meet-in-the-middle ball hashing (three bits, as in ``simhash``) each meet the least set
of their group. A SimHash differs in about ten bits at a similarity of 0.8, and a Hamming search that
wide meets far more unlike documents than like ones as the corpus grows. So what lies beyond
three bits meets on banded minima of the same shingle hashes: ``BANDS`` keys of ``ROWS`` minima each,
of which two documents of similarity J share one with a chance of 1 - (1 - J**ROWS)**BANDS
(0.9996 at 0.8). Every link is verified on the whole sets of shingles.

Equal sets are one node. Pairs are only made where they can change a group: first each
node meets one hub, then the pairs of a key whose ends are still in different groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, documents, never_broadcast, unused
from .simhash import SEED, fingerprint_groups, majority, shingle_hashes
from .tokens import sliced

BANDS = 20
ROWS = 5
_CHUNK = 2048  # shingles whose hashes are mixed at a time

_rng = np.random.default_rng(SEED)
_MASKS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words_in_shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words_in_shingle))


def node_of(hashes: np.ndarray) -> int:
    """A signed long that tells sets of shingles apart."""
    import xxhash

    return xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles as signed longs; none for the empty set."""
    import xxhash

    if not len(hashes):
        return np.empty(0, "<i8")
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        mixed = (hashes[k : k + _CHUNK, None] ^ _MASKS) * _FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0), out=least)
    keys = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(keys)], "<u8").view("<i8")


def _prints(docs: DataFrame, words_in_shingle: int) -> DataFrame:
    """doc_id, node, number of shingles, SimHash of the set and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingle_set(t.encode(), words_in_shingle) for t in b.column("text").to_pylist()]
            cols = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([majority(s) for s in sets], "<u8").view("<i8")), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.record_batch([b.column("doc_id"), *cols], names=["doc_id", "node", "n", "fp", "bands"])

    return documents(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, node long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words_in_shingle: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, each read from the document of its least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist()):
                hashes = shingle_set(text.encode(), words_in_shingle)
                # Rows repeated under one id may hold other texts.
                if node_of(hashes) == node:
                    rows.append((node, hashes.view("<i8")))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["node", "hashes"])

    texts = documents(docs).join(wanted, "doc_id").select("node", "text")
    return texts.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def similar_groups(scratch: Scratch, docs: DataFrame, distinct: DataFrame, words_in_shingle: int) -> DataFrame:
    """(node, component) of the nodes that have a link."""
    filed = distinct.select("node", "n", F.explode("bands").alias("band"))
    hubs = filed.groupBy("band").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1").drop("many")
    shared = scratch.stage(filed.join(never_broadcast(hubs), "band").select("band", "node", "n", "hub"), "shared")
    balls = fingerprint_groups(scratch, distinct.select("fp").distinct())
    balls = scratch.stage(distinct.select("node", "n", "fp").join(balls, "fp").select("node", "n", "group"), "balls")
    centres = balls.groupBy("group").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1").drop("many")
    close = scratch.stage(balls.join(centres, "group").select("node", "n", "hub"), "close")
    wanted = distinct.join(shared.select("node").unionByName(close.select("node")).distinct(), "node").select("node", F.col("least").alias("doc_id"))
    sets = scratch.stage(_sets(docs, wanted, words_in_shingle), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        # A similarity of 0.8 needs sizes that differ by a fifth at most.
        fit = pairs.where("5 * least(n, n2) >= 4 * greatest(n, n2)").select("node", "node2", "n", "n2").distinct()
        both = fit.join(sets, "node").join(sets.select(F.col("node").alias("node2"), F.col("hashes").alias("hashes2")), "node2")
        return scratch.stage(both.where("9 * size(array_intersect(hashes, hashes2)) >= 4 * (n + n2)").select("node", "node2"), "links")

    star = shared.where("node <> hub.node").groupBy("node", "n").agg(F.min("hub").alias("hub"))
    star = star.unionByName(close.where("node <> hub.node"))
    first = verified(star.select("node", "n", F.col("hub.node").alias("node2"), F.col("hub.n").alias("n2")))
    joined = connected_components(scratch, first)
    placed = shared.select("band", "node", "n").join(joined, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("c"))
    placed = scratch.stage(placed, "placed")
    split = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
    open_ = scratch.stage(placed.join(split, "band", "left_semi"), "open")
    other = open_.select("band", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    second = verified(open_.join(other, "band").where("c < c2"))
    return connected_components(scratch, first.unionByName(second))


def keep_one_similar(docs: DataFrame, words_in_shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` with the least id of their group; of rows repeated under that id, one.

    All columns are kept. Two documents are linked if the sets of their lower-cased (A-Z)
    word shingles have a Jaccard similarity of 0.8 or more; texts without words (null,
    empty, white space) are linked with each other. Rows without an id cannot be told
    apart: they are all kept and link nothing.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    prints = scratch.stage(_prints(docs, words_in_shingle), "prints")
    distinct = scratch.stage(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    groups = similar_groups(scratch, docs, distinct, words_in_shingle)
    grouped = scratch.stage(distinct.select("node", "least").join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("group")), "groups")
    least = grouped.groupBy("group").agg(F.min("least").alias("kept"))
    # A row stays if it holds the least id of its own group.
    of = prints.select("doc_id", "node").distinct().join(grouped.select("node", "group"), "node").join(least, "group")
    (id_,) = unused(docs, "_id")
    kept = of.where("doc_id = kept").select(F.col("doc_id").alias(id_)).distinct()
    one = docs.join(kept, F.col("doc_id").cast("long") == F.col(id_), "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null")).select(*docs.columns)
