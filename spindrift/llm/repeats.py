"""Exact long repeats by a sparse enhanced suffix array, spread over the cluster.

A string of ``passage`` bytes always holds the least hash of its ``GRAM``-byte
windows at the same place, so it is enough to look at those anchors: their
suffixes form a sparse suffix array. Anchors with equal surroundings of
``length`` bytes to either side are counted, not compared. The others are dealt
out by their gram; a task sorts the suffixes of a gram, takes the common prefixes
of neighbours and scans them with a stack, which yields the intervals of the
common-prefix tree. In each interval the left extensions are sorted in turn:
where they differ lies the left end of a maximal repeat, and every run of them
that is long enough is one repeat group with all its occurrences. Strings of
``length`` bytes are taken out; those of ``passage`` bytes and more, which are fewer
than fifty words of prose take, are reported beside them.

A gram with more than ``MOST`` different surroundings is never put in one task:
its anchors are filed again under longer strings (one half of the offsets at a
time), counted again, and so on until the groups are small; at a single offset
equal strings are merely counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, partitions
from .tokens import sliced

LENGTH = 400
PASSAGE = 240
GRAM = 48
MOST = 4096
SEGMENT = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept from call to call."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of every ``gram``-byte window."""
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes): the least gram (the first of equals) of every window of ``length`` bytes."""
    n = len(raw)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = length - gram + 1
    places, hashes = [], []
    mask = np.uint64((1 << 20) - 1)
    for first in range(0, n - length + 1, SEGMENT):
        h = gram_hashes(raw[first : min(n, first + SEGMENT + length - 1)], gram)
        m = len(h)
        key = (h & ~mask) | np.arange(m, dtype=np.uint64)
        blocks = np.full(-(-m // k) * k, np.iinfo(np.uint64).max)
        blocks[:m] = key
        blocks = blocks.reshape(-1, k)
        before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(after[: m - k + 1], before[k - 1 : m])
        at = np.unique((least & mask).astype(np.int64))
        places.append(at + first)
        hashes.append(h[at].view(np.int64))
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    places, once = np.unique(places, return_index=True)
    return places, hashes[once]


def _common(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of two byte matrices whose common length is ``size``."""
    same = a == b
    return np.minimum(np.where(same.all(1), a.shape[1], same.argmin(1)), size)


def _matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    wide = max(1, int(sizes.max()))
    out = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(len(strings), wide)
    return out, sizes


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of the common-prefix tree, by one scan with a stack."""
    stack: list[tuple[int, int]] = []
    for k, depth in enumerate([*common.tolist(), -1]):
        first = k
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, k
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeat_groups(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(row, bytes to the left, bytes to the right, group) of every occurrence of a long repeat.

    ``rights`` begin at the anchors, ``lefts`` end there. A group's occurrences share
    at least ``length`` bytes around the anchor; a row is listed with the longest
    stretch that it shares with another of its interval.
    """
    m = len(rights)
    order = sorted(range(m), key=rights.__getitem__)
    right, right_size = _matrix([rights[k] for k in order])
    common = _common(right[1:], right[:-1], np.minimum(right_size[1:], right_size[:-1]))
    turned = [lefts[k][::-1] for k in order]
    left, left_size = _matrix(turned)
    rank = np.empty(m, np.int64)
    rank[sorted(range(m), key=turned.__getitem__)] = np.arange(m)
    out, group = [], 0
    for depth, first, last in intervals(common):
        need = length - depth
        rows = np.arange(first, last + 1)
        rows = rows[np.argsort(rank[rows])]
        shared = _common(left[rows[1:]], left[rows[:-1]], np.minimum(left_size[rows[1:]], left_size[rows[:-1]]))
        enough = shared >= need  # between neighbours in the order of their left extensions
        if not enough.any():
            continue
        runs = np.cumsum(~np.concatenate([[False], enough]))
        best = np.maximum(np.concatenate([[-1], np.where(enough, shared, -1)]), np.concatenate([np.where(enough, shared, -1), [-1]]))
        out += [(order[r], int(b), depth, group + int(g)) for r, b, g in zip(rows.tolist(), best, runs) if b >= 0]
        group += int(runs[-1]) + 1
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and ``row``: 128 bits that stand for both."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))


def _anchor_table(rows: DataFrame, length: int, passage: int) -> DataFrame:
    """row, pos, gram and the hash of the surroundings of every anchor of a string of ``passage`` bytes."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in sliced(batches):
            row, pos, gram, around, left, right = [], [], [], [], [], []
            for r, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                raw = t.encode()
                places, hashes = anchors(np.frombuffer(raw, np.uint8), passage)
                n = len(raw)
                row += [r] * len(places)
                pos.append(places)
                gram.append(hashes)
                left.append(np.minimum(places, reach))
                right.append(np.minimum(n - places, length))
                around += [digest(raw[max(0, p - reach) : p + length], min(p, reach)) for p in places.tolist()]
            if row:
                cols = [pa.array(row, pa.binary()), *(pa.array(np.concatenate(c)) for c in (pos, gram)), pa.array(around, pa.binary()), *(pa.array(np.concatenate(c), pa.int32()) for c in (left, right))]
                yield pa.record_batch(cols, names=["row", "pos", "gram", "around", "l", "r"])

    return rows.select("row", "text").mapInArrow(run, "row binary, pos long, gram long, around binary, l int, r int")


WITH_STRINGS = "gram binary, single boolean, row binary, pos long, left binary, right binary, lo int, hi int"


def _strings(rows: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The surroundings of the chosen anchors, cut out of the texts."""
    reach = length - GRAM
    by_row = chosen.groupBy("row").agg(F.collect_list(F.struct("gram", "single", "pos")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for r, t, wanted in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                raw = t.encode()
                for w in wanted:
                    p = w["pos"]
                    out.append((w["gram"].to_bytes(8, "big", signed=True), w["single"], r, p, raw[max(0, p - reach) : p], raw[p : p + length], 0, reach))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _STRING_TYPES)], names=_STRING_NAMES)

    return rows.select("row", "text").join(by_row, "row").mapInArrow(run, WITH_STRINGS)


_STRING_NAMES = [x.split()[0] for x in WITH_STRINGS.split(", ")]
_STRING_TYPES = [pa.binary(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
SPANS = "row binary, first long, last long"
_SPAN_NAMES = ["row", "first", "last"]
_SPAN_TYPES = [pa.binary(), pa.int64(), pa.int64()]


def _halves(strings: DataFrame, length: int) -> DataFrame:
    """Each anchor under two longer strings: the bytes common to all windows of one half of its offsets."""
    schema = WITH_STRINGS + ", around binary, first long, last long"
    reach = length - GRAM  # of a window before its anchor; the strings themselves reach further

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                left, right = r["left"], r["right"]
                top = min(r["hi"], reach)
                mid = (r["lo"] + top) // 2
                for lo, hi in ((r["lo"], mid), (mid + 1, top)):
                    a, z = max(lo, length - len(right)), min(hi, len(left))  # bytes that a window takes on the left
                    if a > z:
                        continue
                    both = left + right
                    core = both[len(left) - lo : len(left) + length - hi]
                    whole = both[len(left) - z : len(left) + length - a]
                    key = hashlib.blake2b(core + bytes(f"{lo}:{hi}", "ascii"), digest_size=16).digest()
                    around = hashlib.blake2b(whole + bytes(f"{a}:{z}", "ascii"), digest_size=16).digest()
                    out.append((key, r["single"], r["row"], r["pos"], left, right, lo, hi, around, r["pos"] - z, r["pos"] + length - a))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [*_STRING_TYPES, pa.binary(), pa.int64(), pa.int64()])], names=[*_STRING_NAMES, "around", "first", "last"])

    return strings.mapInArrow(run, schema)


def _in_groups(strings: DataFrame, length: int) -> DataFrame:
    """Spans of the repeats among anchors that share a gram, by the suffix arrays of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(rows: list[dict]) -> list[tuple]:
            if len(rows) < 2:
                return []
            lo = rows[0]["lo"]  # the shared string begins ``lo`` bytes before the anchors
            cut = [len(r["left"]) - lo for r in rows]
            lefts = [r["left"][:c] for r, c in zip(rows, cut)]
            rights = [r["left"][c:] + r["right"] for r, c in zip(rows, cut)]
            found = repeat_groups(lefts, rights, length)
            return [(rows[k]["row"], rows[k]["pos"] - lo - l, rows[k]["pos"] - lo + r) for k, l, r, _ in found if rows[k]["single"]]

        held, out = [], []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["gram"] != r["gram"]:
                    out += spans(held)
                    held = []
                held.append(r)
            if len(out) > 20_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _SPAN_TYPES)], names=_SPAN_NAMES)
                out = []
        out += spans(held)
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _SPAN_TYPES)], names=_SPAN_NAMES)

    dealt = strings.repartition(partitions(strings.sparkSession), "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, SPANS)


def repeated_spans(scratch: Scratch, rows: DataFrame, length: int = LENGTH, most: int = MOST, passage: int = PASSAGE) -> DataFrame:
    """(row, first, last): byte ranges that start elsewhere too, of ``passage`` bytes and more.

    The ranges of ``length`` bytes and more cover just the bytes of strings of
    ``length`` bytes that are repeated, all ranges those of ``passage`` bytes.
    """
    table = scratch.stage(_anchor_table(rows, length, passage), "anchors")
    place = F.struct("row", "pos")
    kinds = scratch.stage(table.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(place).alias("one")), "kinds")
    grams = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    grams = scratch.stage(grams, "grams")
    copies = kinds.where("n > 1").select("gram", "around")
    spans = table.join(copies, ["gram", "around"]).select("row", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + F.col("r")).alias("last"))
    whole = scratch.stage(spans, "copies")

    chosen = kinds.join(grams.where("kinds > 1"), "gram").select("gram", (F.col("n") == 1).alias("single"), "one.row", "one.pos", "kinds")
    chosen = scratch.stage(chosen, "chosen")
    strings = scratch.stage(_strings(rows, chosen, length), "strings")
    scratch.drop(table)
    large = grams.where(F.col("kinds") > most).select("gram")
    parts = [whole]
    if large.isEmpty():
        parts.append(scratch.stage(_in_groups(strings, passage), "repeats"))
    else:
        sized = strings.join(chosen.groupBy("gram").agg(F.first("kinds").alias("kinds")).withColumn("gram", _eight_bytes("gram")), "gram")
        parts.append(scratch.stage(_in_groups(sized.where(F.col("kinds") <= most).drop("kinds"), passage), "repeats"))
        # Small groups give ranges in full length; of equal strings of one offset only that length is known, so both are looked for.
        for size in sorted({passage, length}):
            parts += _in_large_groups(scratch, sized.where(F.col("kinds") > most).drop("kinds"), size, most)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _in_large_groups(scratch: Scratch, open_rows: DataFrame, length: int, most: int) -> list[DataFrame]:
    """Ranges of ``length`` bytes and more among anchors of very many different surroundings."""
    place = F.struct("row", "pos")
    parts = []
    while True:
        halves = scratch.stage(_halves(open_rows, length), "halves")
        counted = halves.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(place).alias("one"))
        counted = scratch.stage(counted, "counted")
        sizes = counted.groupBy("gram").agg(F.count("*").alias("kinds"))
        equal = halves.where("single").join(counted.where("n > 1").select("gram", "around"), ["gram", "around"]).select("row", "first", "last")
        parts.append(scratch.stage(equal, "equal"))
        lone = counted.join(sizes.where("kinds > 1"), "gram").select("gram", "around", "n", "kinds", "one.row", "one.pos")
        rest = halves.join(lone, ["gram", "around", "row", "pos"]).withColumn("single", F.col("single") & (F.col("n") == 1)).where("lo < hi")
        rest = scratch.stage(rest.dropDuplicates(["gram", "around"]).select(*_STRING_NAMES, "kinds"), "rest")
        parts.append(scratch.stage(_in_groups(rest.where(F.col("kinds") <= most).drop("kinds"), length), "repeats"))
        open_rows = rest.where(F.col("kinds") > most).drop("kinds")
        scratch.drop(halves)
        if open_rows.isEmpty():
            return parts


def _eight_bytes(col: str) -> Column:
    """The bytes of a long, highest first, as ``int.to_bytes(8, 'big')`` gives them."""
    return F.unhex(F.lpad(F.hex(col), 16, "0"))


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges without overlap or contact that cover the same bytes."""
    if len(first) == 0:
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]])
    return first[new], last[np.append(new[1:], True)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST, keep_text: bool = False, passage: int = PASSAGE) -> DataFrame:
    """Take every byte out that lies in a string of ``length`` bytes which also starts elsewhere.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Texts are
    UTF-8 bytes (null: empty), matches stay inside a text, and strings are judged
    on the input. Rows repeated under one id are copies of each other. Texts below
    ``length`` bytes stay whole. An empty table gives no rows. Result: doc_id,
    n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the kept bytes;
    n_passages and longest_passage are the maximal runs of bytes that lie in strings
    of ``passage`` bytes (at most ``length``) which also start elsewhere, and the
    bytes of the longest run (0 without one).
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = _rows(docs)
    spans = repeated_spans(scratch, rows, length, most, passage)
    by_row = spans.where(F.col("last") - F.col("first") >= passage).distinct().groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, longest_passage long" + (", kept binary" if keep_text else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.binary()] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            lists = b.column("spans")
            for k, (doc_id, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())):
                raw = t.encode()
                kept, removed, n, runs, longest = raw, 0, 0, 0, 0
                if lists[k].is_valid:
                    own = lists[k].values.flatten()
                    first, last = (x.to_numpy(zero_copy_only=False) for x in own[:2])
                    a, z = merged(first, last)
                    runs, longest = len(a), int((z - a).max(initial=0))
                    long = last - first >= length
                    first, last = merged(first[long], last[long])
                    n, removed = len(first), int((last - first).sum())
                    edges = [0, *np.ravel(np.column_stack([first, last])).tolist(), len(raw)]
                    kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                out.append((doc_id, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), runs, longest) + ((kept,) if keep_text else ()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.join(by_row, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
