"""Mixing sources to target weights by Poisson replication.

A source with share ``w`` of the target and size ``s`` of a corpus of size ``S``
is to be seen ``w * S / s`` times on average. Each document draws its number of
copies from the Poisson distribution with that mean: a hash of seed and document
is the uniform number, inverted through the distribution function. The draw needs
no state, so any number of executors draw the same. Copies are dealt out and
sorted by another hash, which is a global shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, partitions

#: Digits of md5 that make a uniform number: 13 hexadecimal digits are 52 bits.
_DIGITS = 13
#: Beyond this mean the distribution function begins 12 standard deviations and 30 below it, where it is 0 in doubles.
_LARGE_MEAN = 4096.0
#: Copies of a document that one task makes from one row.
_COPIES = 1024


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the md5 of ``key`` joined by colons; 52 bits, exact in doubles."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(1 << 4 * _DIGITS))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): mean copies of a document of each source; one row for each source.

    Sizes are characters of whole texts (a document counts one at least). Without
    ``weights`` all sources weigh the same; a source that ``weights`` leaves out has
    none. Weights are normalised over the sources that are there.
    """
    spark = docs.sparkSession
    size = F.greatest(F.lit(1), F.char_length(F.coalesce("text", F.lit("")))).cast("long")
    sizes = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), size.alias("n")).groupBy("source").agg(F.sum("n").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = spark.createDataFrame(list(weights.items()), "source string, weight double")
        weighed = sizes.join(given, "source", "left").fillna(0.0, ["weight"])
    total = weighed.agg(F.sum("size").alias("total"), F.sum("weight").alias("all_weight"))  # one row
    return weighed.crossJoin(F.broadcast(total)).select("source", F.coalesce(F.try_divide(F.col("weight") * F.col("total") * F.lit(float(epochs)), F.col("all_weight") * F.col("size")), F.lit(0.0)).alias("rate"))


def poisson(rate: float) -> tuple[int, np.ndarray]:
    """The first count and the Poisson distribution function from there up to where it is 1 in doubles."""
    if rate <= 0:
        return 0, np.ones(1)
    wide = 12 * np.sqrt(rate) + 30
    first = 0 if rate <= _LARGE_MEAN else int(rate - wide)
    k = np.arange(first + 1, int(np.ceil(rate + wide)) + 1)
    # Logarithms of the terms over the first one; what is left out is below 1e-30, so they sum to one.
    logs = np.concatenate([[0.0], np.cumsum(np.log(rate / k))])
    steps = np.cumsum(np.exp(logs - logs.max()))
    return first, steps / steps[-1]


def distribution(rates: DataFrame) -> DataFrame:
    """(source, first, steps): the distribution function at ``first``, ``first`` + 1, ... up to where it is 1 in doubles.

    A row holds about 24 times the root of the mean; ``first`` is 0 up to ``_LARGE_MEAN``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, rate in zip(b.column("source").to_pylist(), b.column("rate").to_pylist()):
                first, steps = poisson(rate)
                yield pa.record_batch([pa.array([source], pa.string()), pa.array([first], pa.int64()), pa.array([steps], pa.list_(pa.float64()))], names=["source", "first", "steps"])

    return rates.select("source", "rate").mapInArrow(run, "source string, first long, steps array<double>")


def _copied(drawn: DataFrame, n_parts: int) -> DataFrame:
    """A row for each of the ``_n`` copies, numbered by ``copy``; documents of very many are dealt out first."""
    few = drawn.where(F.col("_n") <= _COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    dealt = drawn.where(F.col("_n") > _COPIES).withColumn("_part", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / _COPIES).cast("int"))))
    dealt = dealt.repartition(n_parts, "doc_id", "_part")
    start = F.col("_part") * _COPIES
    many = dealt.withColumn("copy", F.explode(F.sequence(start, F.least(start + _COPIES, F.col("_n")).cast("int") - 1))).drop("_part")
    return few.unionByName(many)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, globally shuffled; adds ``copy`` and ``shuffle_key``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; all columns are kept (columns
    named ``copy`` or ``shuffle_key`` are replaced). A null source is the source ''.
    A null text counts as one character. Repeated rows of one id draw the same count,
    a null id draws as the id ''. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("copy", "shuffle_key")
    steps = scratch.stage(distribution(rates(docs, weights, epochs)), "steps").select(F.col("source").alias("_source"), F.col("first").alias("_first"), F.col("steps").alias("_steps"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    joined = docs.join(steps, F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_source"))
    u = uniform(F.lit(seed), key)
    n = F.col("_first") + F.size(F.filter("_steps", lambda c: c <= F.col("_u")))
    drawn = joined.withColumn("_u", u).withColumn("_n", n).where("_n > 0").select(*docs.columns, "_n")
    n_parts = partitions(docs.sparkSession)
    copies = _copied(drawn, n_parts)
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), key, F.col("copy")).cast("binary")))
    dealt = keyed.drop("_n").repartition(n_parts, "shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key")


#: The same for DuckDB, over ``documents``; one row for each copy.
MIX_SQL = """
WITH size AS (
  SELECT coalesce(source, '') AS source, sum(greatest(1, length(coalesce(text, '')))) AS size FROM documents GROUP BY 1),
rate AS (
  SELECT source, (sum(size) OVER ())::DOUBLE / (count(*) OVER () * size) AS rate FROM size),
term AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM rate)),
step AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM term),
draw AS (
  SELECT doc_id, source AS own_source, coalesce(source, '') AS source, coalesce(text, '') AS text,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
n AS (
  SELECT d.doc_id, d.source, count(*) AS n FROM (SELECT DISTINCT doc_id, source, u FROM draw) d JOIN step s ON s.source = d.source AND s.f <= d.u
  GROUP BY d.doc_id, d.source)
SELECT doc_id, own_source AS source, copy::INT AS copy, md5('42:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key,
       length(text) AS n_chars, md5(text) AS text_md5
FROM (SELECT d.doc_id, d.own_source, d.text, unnest(generate_series(0, n.n - 1)) AS copy
      FROM draw d JOIN n ON n.doc_id IS NOT DISTINCT FROM d.doc_id AND n.source = d.source)
"""
