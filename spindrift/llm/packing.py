"""Best-fit packing by exact-complement hashing.

Pieces of documents go into sequences of at most ``capacity`` tokens. Only the
histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus)
reaches the driver. There, an index of single, pair and triple length sums finds
combinations that fill a gap exactly; they are consumed under availability counts,
as many sequences at once as the counts allow. What has no exact complement is
packed best-fit, longest first. The plan is a table of slots; pieces are numbered
within their length by a salted rank and look their slot up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch, documents, never_broadcast, partitions

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def exact_fill(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Available lengths (one, two or three) that sum to ``gap``; the longest first."""
    if gap <= 0:
        return None
    if free[gap] > 0:
        return (gap,)

    def pair(total: int, most: int) -> tuple[int, int] | None:
        a = np.arange(total // 2 + total % 2, min(total, most + 1))
        if len(a) == 0:
            return None
        ok = (free[a] > 0) & (free[total - a] > 0) & ((2 * a != total) | (free[a] > 1))
        hit = np.flatnonzero(ok)
        return (int(a[hit[-1]]), int(total - a[hit[-1]])) if len(hit) else None

    if two := pair(gap, gap):
        return two
    lengths = np.flatnonzero(free[: gap - 1] > 0)
    for c in lengths[::-1].tolist():
        if 3 * c < gap:
            break
        free[c] -= 1
        rest = pair(gap - c, c)
        free[c] += 1
        if rest:
            return (c, *rest)
    return None


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: times}) patterns that use up ``histogram`` (counts by length)."""
    free = histogram.astype(np.int64).copy()
    patterns: list[tuple[int, dict[int, int]]] = []
    if free[capacity]:
        patterns.append((int(free[capacity]), {capacity: 1}))
        free[capacity] = 0
    for length in range(capacity - 1, capacity // 4 - 1, -1):
        while free[length]:
            free[length] -= 1
            found = exact_fill(free, capacity - length)
            free[length] += 1
            if found is None:
                break
            need: dict[int, int] = {}
            for x in (length, *found):
                need[x] = need.get(x, 0) + 1
            n = min(int(free[x]) // k for x, k in need.items())
            for x, k in need.items():
                free[x] -= n * k
            patterns.append((n, need))

    open_bins: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)

    def put(n: int, pattern: dict[int, int], gap: int) -> None:
        if gap == 0:
            patterns.append((n, pattern))
        else:
            open_bins[gap].append((n, pattern))
            filled[gap] = True

    for length in np.flatnonzero(free)[::-1].tolist():
        left = int(free[length])
        while left:
            hit = np.flatnonzero(filled[length:])
            if len(hit) == 0:
                each = capacity // length
                if n := left // each:
                    put(n, {length: each}, capacity - each * length)
                if rest := left % each:
                    put(1, {length: rest}, capacity - rest * length)
                break
            gap = length + int(hit[0])
            bins, pattern = open_bins[gap].pop()
            filled[gap] = bool(open_bins[gap])
            each = min(gap // length, left)
            n = min(bins, left // each)
            if n < bins:
                open_bins[gap].append((bins - n, pattern))
                filled[gap] = True
            put(n, pattern | {length: pattern.get(length, 0) + each}, gap - each * length)
            left -= n * each
    return patterns + [x for bins in open_bins for x in bins]


def slots(patterns: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each length the ranks that a pattern takes, and where they go; bounded like ``plan``."""
    rows, taken, base = [], {}, 0
    for n, pattern in patterns:
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, times, base, offset))
            taken[length] = first + n * times
            offset += length * times
        base += n
    out = pd.DataFrame(rows, columns=["length", "first", "times", "base", "offset"]).astype("int64")
    return out.sort_values(["length", "first"], ignore_index=True)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each text, each document ended by ``end_id``."""
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            out = pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names[: len(cols)])
            rows.clear()
            return out

        size = 0
        for doc_id, ids in tokens.encoded(batches, vocabulary):
            whole = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
            for k, start in enumerate(range(0, len(whole), capacity)):
                raw = whole[start : start + capacity].tobytes()
                rows.append((doc_id, k, start, len(raw) // 4, zlib.crc32(raw)) + ((raw,) if keep_ids else ()))
                size += len(raw) if keep_ids else 40
            if size > 8 << 20:
                yield flush()
                size = 0
        if rows:
            yield flush()

    return documents(docs).mapInArrow(cut, schema)


def place(scratch: Scratch, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (staged) with ``sequence_id`` and ``offset``."""
    spark = scratch.spark
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = scratch.stage(counts, "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # one row for each length: at most ``capacity``
        histogram[r["length"]] = r["n"]
    table = slots(plan(histogram, capacity))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(never_broadcast(before), ["length", "_salt"]).withColumn("_rank", F.col("_rank").cast("long") + F.col("_before") - 1).drop("_salt", "_before")

    length, first, times, base, offset = (table[c].to_numpy() for c in table)
    shift = np.int64(1) << 44  # ranks stay below 2^44
    keys = length * shift + first

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            k = np.searchsorted(keys, size * shift + rank, side="right") - 1
            past = rank - first[k]
            kept = [c for c in b.schema.names if c != "_rank"]
            yield pa.record_batch(
                [b.column(c) for c in kept] + [pa.array(base[k] + past // times[k]), pa.array(offset[k] + past % times[k] * size)],
                names=[*kept, "sequence_id", "offset"],
            )

    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or
    empty text is one end token. A document longer than ``capacity`` is cut into
    full pieces and a rest. Repeated rows (also of one ``doc_id``) are packed once
    each; null ids stay null. An empty table gives no rows. ``keep_ids`` adds the
    ids of each piece, little-endian unsigned 32-bit.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.stage(token_pieces(docs, vocabulary or tokens.default_vocabulary(), capacity, end_id, keep_ids), "pieces")
    out = place(scratch, pieces, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
