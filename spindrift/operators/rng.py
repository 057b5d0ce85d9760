"""The reproducible random stream, by position.

The generator is s' = (1103515245 s + 12345) mod 2^31 and u = s / (2^31 - 1), the
first draw after one step, so u may be exactly 1. Draw k of a seed is reached by
skipping ahead: k steps are the product of the steps of its bytes, each a multiplier
and an increment taken from a table made beforehand. So any row computes its own draw,
and no task depends on another. Each step names the state once; otherwise a filter on
the result would repeat the expression beyond measure.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator.
MULTIPLIER, INCREMENT, MASK = 1103515245, 12345, 0x7FFFFFFF


#: Bits of a position: the period is 2^31, so a position counts modulo that.
BITS = 31


def jumps() -> list[tuple[int, int]]:
    """(multiplier, increment) of 1, 2, 4, ... steps."""
    out, a, c = [], MULTIPLIER, INCREMENT
    for _ in range(BITS):
        out.append((a, c))
        a, c = a * a & MASK, (a * c + c) & MASK
    return out


@cache
def _byte_jumps(byte: int) -> tuple[str, str]:
    """SQL arrays of the multipliers and increments of 0, 1, ..., 255 times 256^``byte`` steps."""
    a, c = (jumps() + [(1, 0)])[8 * byte]
    table = [(1, 0)]
    for _ in range(255):
        m, i = table[-1]
        table.append((m * a & MASK, (i * a + c) & MASK))
    return tuple("array(" + ",".join(f"{x[side]}L" for x in table) + ")" for side in (0, 1))


def state(k: Column, seed: Column | int = 42) -> Column:
    """The state after ``k`` steps: one jump for each byte of ``k``."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    s = seed.cast("long").bitwiseAND(F.lit(MASK).cast("long"))
    for byte in range(4):
        at = F.shiftright(k, 8 * byte).bitwiseAND(F.lit(255 if byte < 3 else 127).cast("long")).cast("int")
        by, plus = (F.get(F.expr(x), at) for x in _byte_jumps(byte))
        s = (s * by + plus).bitwiseAND(F.lit(MASK).cast("long"))
    return s


def uniform(k: Column, seed: Column | int = 42) -> Column:
    """Draw ``k`` (the first is 1), in [0, 1] with both ends."""
    return state(k.cast("long"), seed) / F.lit(float(MASK))


def pick(k: Column, n: Column, seed: Column | int = 42) -> Column:
    """An index below ``n`` from draw ``k``; a draw of exactly 1 is the last."""
    return F.least(F.floor(uniform(k, seed) * n), n - 1).cast("long")


def normal(first: Column, seed: Column | int = 42) -> Column:
    """Sum of twelve draws from ``first`` on, less six."""
    total = uniform(first, seed)
    for i in range(1, 12):
        total = total + uniform(first + i, seed)
    return total - 6.0


def state_sql(k: str, seed: str = "42") -> str:
    """The same for DuckDB."""
    s = f"(({seed})::BIGINT & {MASK})"
    for i, (a, c) in enumerate(jumps()):
        on = f"((({k})::BIGINT >> {i}) & 1) = 1"
        s = f"(({s} * CASE WHEN {on} THEN {a}::BIGINT ELSE 1 END + CASE WHEN {on} THEN {c} ELSE 0 END) & {MASK})"
    return s


def uniform_sql(k: str, seed: str = "42") -> str:
    return f"({state_sql(k, seed)} / {float(MASK)})"


def normal_sql(first: str, seed: str = "42") -> str:
    return "(" + " + ".join(uniform_sql(f"{first} + {i}", seed) for i in range(12)) + " - 6.0)"
