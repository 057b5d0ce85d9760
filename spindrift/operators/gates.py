"""Cheap checks before dear work."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Gated:
    """``result`` where nothing blocks, else ``blocking`` (the result is None and was never planned). ``status``: 0 or 2."""

    result: DataFrame | None
    blocking: DataFrame

    @property
    def status(self) -> int:
        return 0 if self.result is not None else 2


def gated(findings: DataFrame, work: Callable[[], DataFrame]) -> Gated:
    """Do ``work`` only if ``findings`` (check, severity, subject, detail) block nothing.

    Findings are looked for until the first that blocks, and ``work`` is not even planned where there is one. Warnings do not count.
    """
    blocking = findings.where(F.col("severity") == "block")
    return Gated(work() if blocking.isEmpty() else None, blocking)
