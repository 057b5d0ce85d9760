"""Sums of bootstrap replicates, a block of values and a range of replicates at a time.

A block holds ``HELD`` values at most and is sent to several tasks, each of which makes
the draws of its replicates from their positions in the stream and adds up the values
that they hit in the block. Draws are never shuffled, only blocks and sums.

The stream takes each of its 2^31 states once and then begins anew, and the greater the state
the greater the value that it picks. So the states that pick a value of a block are one
range. A block of a large group goes through its range of states instead of through all draws
of the group, works out at which draw each of them comes, and adds its value to the
replicates that this draw belongs to. All blocks of a group together go through 2^31 states,
whatever the group's size and the number of replicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small_batches
from .rng import MASK, jumps

HELD = 1 << 20
#: States that cost as much as one draw to go through, and the states of a row of work.
DEAR, STATES = 8, 1 << 26
#: Draws that one row of work makes, and the least number of its replicates.
DRAWS, LEAST = 1 << 24, 16
_WIDE = 1 << 16
_CHUNK = 1 << 14  # states that are gone through at a time


@cache
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and increments of 0, 1, ..., ``_WIDE`` - 1 steps of the generator."""
    by, plus = np.ones(1, np.int64), np.zeros(1, np.int64)
    for a, c in jumps()[:16]:
        by, plus = np.concatenate([by, by * a & MASK]), np.concatenate([plus, (plus * a + c) & MASK])
    return by, plus


def _jump(k: int) -> tuple[int, int]:
    """Multiplier and increment of ``k`` steps."""
    by, plus = 1, 0
    for bit, (a, c) in enumerate(jumps()):
        if k >> bit & 1:
            by, plus = by * a & MASK, (plus * a + c) & MASK
    return by, plus


def drawn_sums(x: np.ndarray, n: int, low: int, stride: int, offset: int, first: int, to: int, seed: int, point: float | None) -> np.ndarray:
    """One sum for each of the replicates ``first`` to ``to`` - 1 over the values ``x`` at ``low`` and on of ``n``.

    Without ``point`` every draw picks one of the ``n`` values; with it draw i gives the
    deviation of value i from ``point`` a random sign.
    """
    by, plus = _steps()
    begin, width = (1 + offset, n) if point is None else (1 + offset + low, len(x))
    starts = np.empty(to - first, np.int64)
    a, c = _jump(first * stride + begin)
    state = ((seed & MASK) * a + c) & MASK
    a, c = _jump(stride)
    for r in range(to - first):
        starts[r] = state
        state = (state * a + c) & MASK
    sums = np.zeros(to - first)
    for at in range(0, width, _WIDE):
        m = min(_WIDE, width - at)
        rows = _WIDE // m
        for r in range(0, to - first, rows):
            u = ((starts[r : r + rows, None] * by[:m] + plus[:m]) & MASK) / float(MASK)
            if point is not None:
                sums[r : r + rows] += np.where(u >= 0.5, 1.0, -1.0) @ (x[at : at + m] - point)
                continue
            hit = np.minimum((u * n).astype(np.int64), n - 1)
            if len(x) == n:
                sums[r : r + rows] += x[hit].sum(1)
            else:
                here = (hit >= low) & (hit < low + len(x))
                sums[r : r + rows] += np.where(here, x[np.where(here, hit - low, 0)], 0.0).sum(1)
        a, c = _jump(m)
        starts = (starts * a + c) & MASK
    return sums


@cache
def _digits() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each byte of a number of steps: multipliers and increments of its 256 jumps, and the jump that changes the
    byte of a state by a given amount, by the state's lowest byte (on which alone that depends)."""
    out, low = [], np.arange(256)
    for byte in range(4):
        by, plus = np.array([_jump(k << 8 * byte) for k in range(256 if byte < 3 else 128)], np.int64).T
        change = (((low[:, None] * by + plus) & MASK) >> 8 * byte) - (low[:, None] >> 8 * byte) & (255 if byte < 3 else 127)
        way = np.zeros((256, 256), np.uint8)
        way[low[:, None], change] = np.arange(len(by))
        out.append((by, plus, way.reshape(-1)))
    return out


def draw_of(states: np.ndarray, seed: int) -> np.ndarray:
    """The number of steps, below 2^31, from ``seed`` to each of ``states``: a jump of k 256^j steps leaves the bytes below j, so the bytes are found one after the other."""
    now, steps, low = np.full(len(states), seed & MASK, np.int64), np.zeros(len(states), np.int64), states & 255
    for byte, (by, plus, way) in enumerate(_digits()):
        change = (states >> 8 * byte) - (now >> 8 * byte) & (255 if byte < 3 else 127)
        k = way[((now & 255) << 8) + change]
        now = (now * by[k] + plus[k]) & MASK
        steps |= k.astype(np.int64) << 8 * byte
    return steps


def first_state(i: int, n: int) -> int:
    """The least state that picks value ``i`` or a later one of ``n``; 2^31 if there is none."""
    lo, hi = 0, MASK + 1
    while lo < hi:
        mid = (lo + hi) // 2
        if min(int(mid / float(MASK) * n), n - 1) >= i:
            hi = mid
        else:
            lo = mid + 1
    return lo


def state_sums(x: np.ndarray, n: int, low: int, stride: int, offset: int, resamples: int, begin: int, end: int, seed: int) -> np.ndarray:
    """What the states ``begin`` to ``end`` - 1, which all pick values of the block ``x`` at ``low``, add to each replicate."""
    cycle = MASK + 1
    starts = (1 + offset + np.arange(resamples, dtype=np.int64) * stride) % cycle
    laps, rest = divmod(n, cycle)
    # Draws between two ends of replicates belong to the same ones.
    cuts = np.unique(np.concatenate([[0], starts, (starts + rest) % cycle]))
    held = np.zeros(len(cuts))
    for at in range(begin, end, _CHUNK):
        states = np.arange(at, min(at + _CHUNK, end), dtype=np.int64)
        hit = np.minimum((states / float(MASK) * n).astype(np.int64), n - 1) - low
        held += np.bincount(np.searchsorted(cuts, draw_of(states, seed), "right") - 1, x[hit], len(cuts))
    before = np.concatenate([[0.0], np.cumsum(held)])
    a, b = np.searchsorted(cuts, starts), np.searchsorted(cuts, (starts + rest) % cycle)
    over = np.where(starts + rest > cycle, before[-1], 0.0) if rest else np.zeros(resamples)
    last = np.where((starts + rest) == cycle, before[-1], before[b])
    return laps * before[-1] + over + (last - before[a] if rest else 0.0)


def value_blocks(placed: DataFrame, keys: tuple[str, ...], parts: int) -> DataFrame:
    """One row for each block ``_b`` of a group: its columns, and the values ``x`` in the order of ``i`` as ``_x``.

    Rows come sorted and a task holds the numbers of one block: in an aggregation each value would be an object of its own, of up to 128 blocks at once.
    """
    same = [*keys, "_b"]
    kept = [f for f in placed.schema if f.name not in ("i", "x")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key, held = None, "", []

        def whole() -> pa.RecordBatch:
            x = np.concatenate(held)
            return pa.record_batch([*(head.column(f.name) for f in kept), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], names=[*(f.name for f in kept), "_x"])

        for b in batches:
            if not b.num_rows:
                continue
            marks = [pc.dictionary_encode(b.column(k), null_encoding="encode").indices.to_numpy() for k in same]
            cuts = [0, *(np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist(), b.num_rows]
            x = b.column("x").to_numpy()
            for a, z in zip(cuts, cuts[1:]):
                now = repr([b.column(k)[a].as_py() for k in same])
                if head is not None and now != key:
                    yield whole()
                    head = None
                if head is None:
                    head, key, held = b.slice(a, 1), now, []
                held.append(x[a:z].copy())
        if head is not None:
            yield whole()

    return placed.repartition(parts, *same).sortWithinPartitions(*same, "i").mapInArrow(run, schema)


def replicate_sums(values: DataFrame, resamples: int, seed: int, keys: tuple[str, ...], stride: Column, offset: Column, point: Column | None = None, held: int = HELD, dear: float = DEAR) -> DataFrame:
    """(keys, n, r, s): sums of the replicates of ``values`` (keys, i, n, x); ``x`` is never null.

    Replicate r takes its draws from position r * ``stride`` + ``offset`` on; both, and
    ``point``, are constant within a group.
    """
    column = F.lit(None).cast("double") if point is None else point.cast("double")
    placed = values.select(*keys, "i", "n", F.col("x").cast("double").alias("x"), (F.col("i") / held).cast("int").alias("_b"), stride.cast("long").alias("_stride"), offset.cast("long").alias("_offset"), column.alias("_point"))
    small_batches(values.sparkSession)  # a row of work holds up to ``held`` values
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = value_blocks(placed, keys, parts)
    step = F.greatest(F.lit(LEAST), F.lit(DRAWS) / F.col("n")).cast("int")
    # By draws or by states, whichever is less work; signs are not picks, and each block makes only its own.
    by_state = F.lit(point is None) & (F.col("n") * F.lit(float(resamples)) > F.lit(float(dear)) * F.size("_x") / F.col("n") * F.lit(MASK + 1.0))
    pieces = F.ceil(F.size("_x") / F.col("n") * F.lit(MASK + 1.0) / STATES).cast("int")
    first_ = F.when(by_state, F.sequence(F.lit(0), pieces - 1)).otherwise(F.sequence(F.lit(0), F.lit(resamples - 1), step))
    work = blocks.withColumn("_pieces", F.when(by_state, pieces)).withColumn("_r", F.explode(first_)).withColumn("_to", F.least(F.col("_r") + step, F.lit(resamples)))
    work = work.repartition(parts, *keys, "_b", "_r")
    fields = [work.schema[k] for k in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n long", "r int", "s double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_x")
            numbers = zip(*(b.column(c).to_pylist() for c in ("n", "_b", "_stride", "_offset", "_r", "_to", "_point", "_pieces")))
            for row, (n, block, gap, skip, r, to, middle, pieces) in enumerate(numbers):
                x = lists[row].values.to_numpy(zero_copy_only=False)
                if pieces:
                    a, z = first_state(block * held, n), first_state(block * held + len(x), n)
                    sums = state_sums(x, n, block * held, gap, skip, resamples, a + (z - a) * r // pieces, a + (z - a) * (r + 1) // pieces, seed)
                    r, to = 0, resamples
                else:
                    sums = drawn_sums(x, n, block * held, gap, skip, r, to, seed, middle)
                same = [pa.array([b.column(k)[row].as_py()] * (to - r), b.schema.field(k).type) for k in keys]
                yield pa.record_batch([*same, pa.array([n] * (to - r), pa.int64()), pa.array(np.arange(r, to), pa.int32()), pa.array(sums)], names=[*keys, "n", "r", "s"])

    part = work.mapInArrow(run, schema)
    return part.groupBy(*keys, "r").agg(F.first("n").alias("n"), F.sum("s").alias("s"))
