"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit of one of their 32-bit halves. So every distinct fingerprint emits, for each
half, all values within half the radius (one bit: itself and 32 variants), and
meets the plain halves of the others in a shuffle on (half, value). Meetings are
deduplicated and verified on all 64 bits.

A first pass joins fingerprints up to two bits apart without pairs: those share a
full 64-bit variant one bit away, at most 65 fingerprints lie around a variant,
and each is linked to its predecessor there. The second pass emits only pairs
whose ends are still in different groups, so a dense group of near copies makes
no pairs of all its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, documents, never_broadcast
from .tokens import sliced

RADIUS = 3
SEED = 42



def shingle_hashes(text: bytes, words_in_shingle: int) -> np.ndarray:
    """64-bit hashes of lower-cased (A-Z) word shingles in order, repeats included; none for no words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_in_shingle + 1)
    first = (ends - np.fromiter(map(len, words), np.int64, len(words)))[:n].tolist()
    last = ends[min(words_in_shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], "<u8")


def fingerprint(text: bytes, words_in_shingle: int) -> int:
    """SimHash of lower-cased (A-Z) word shingles, repeats included; 0 for no words."""
    return majority(shingle_hashes(text, words_in_shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    raw = hashes.view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(raw[k : k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the 64 bits of the fingerprint in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = [fingerprint(t.encode(), words_in_shingle) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(np.array(fps, "<u8").view("<i8"))], names=["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def _flips(col: str, bits: int) -> Column:
    """The value itself and all values one bit away."""
    return F.explode(F.array(F.col(col), *[F.col(col).bitwiseXOR(F.lit(v if v < 1 << 63 else v - (1 << 64)).cast("long")) for v in (1 << k for k in range(bits))]))


def _low(col: str) -> Column:
    return F.col(col).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _high(col: str) -> Column:
    return F.shiftrightunsigned(F.col(col), 32)


def fingerprint_groups(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """(fp, group) of distinct fingerprints (column ``fp``) linked at RADIUS or fewer bits."""
    around = distinct.select("fp", _flips("fp", 64).alias("variant"))
    chain = Window.partitionBy("variant").orderBy("fp")
    close = around.withColumn("other", F.lag("fp").over(chain)).where("other is not null").select("fp", "other").distinct()
    near = scratch.stage(connected_components(scratch, close), "near")
    grouped = distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = scratch.stage(grouped.select("fp", F.coalesce("component", "fp").alias("g")), "grouped")

    half = F.explode(F.array(F.struct(F.lit(0).alias("half"), _low("fp").alias("value")), F.struct(F.lit(1).alias("half"), _high("fp").alias("value"))))
    plain = grouped.select("fp", "g", half.alias("h")).select("fp", "g", "h.half", "h.value")
    balls = plain.select(F.col("fp").alias("fp2"), F.col("g").alias("g2"), "half", _flips("value", 32).alias("value"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    met = plain.alias("p").join(never_broadcast(balls).alias("b"), (F.col("p.half") == F.col("b.half")) & (F.col("p.value") == F.col("b.value")) & (F.col("g") < F.col("g2")) & (apart <= RADIUS))
    links = met.select("g", "g2").distinct()
    merged = connected_components(scratch, links).withColumnRenamed("node", "g")
    return grouped.join(merged, "g", "left").select("fp", F.coalesce("component", "g").alias("group"))


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Documents are
    linked at three or fewer differing bits, whatever they hold: texts without words
    (null, empty, white space) have fingerprint zero and are linked with each other.
    ``component_id`` is the least ``doc_id`` reachable; rows repeated under one id
    count as one document each. A null id is never the least unless it is alone.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.stage(fingerprints(docs, words_in_shingle), "fingerprints")
    distinct = scratch.stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = scratch.stage(fingerprint_groups(scratch, distinct.select("fp")), "groups")
    # One row for each distinct fingerprint; a row for each group after the second aggregation.
    least = groups.join(distinct, "fp").groupBy("group").agg(F.min("least").alias("component_id"))
    by_fp = groups.join(least, "group").select("fp", "component_id")
    out = fps.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_in_shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` with the least id of their group; of rows repeated under that id, one.

    All columns are kept. Rows without an id cannot be told apart and are all kept.
    """
    kept = near_duplicates(docs, words_in_shingle).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null")).select(*docs.columns)
