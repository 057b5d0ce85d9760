"""Toxicity by cumulative-link ordinal regression on sparse text features.

The log-odds that a document's grade is at least k are ``w . x - theta_k``: one
weight vector for all ordered thresholds. Features are the words of a text and
their first three to six letters, present or not. The model is fitted on a
bounded sample of labelled documents (``max_labelled``), on every feature whose
share among the toxic ones differs significantly (``LEAST_Z``), however many there
are. The labels say toxic or not, so toxic documents are graded by the number of
their telling features (``LEAST_RATIO`` times as common among toxic documents):
severe above the median number. A share of the words was tried instead; then long
texts are mild ones, common words get negative weights, and one toxic document in
twenty was missed against one in two hundred. Every document is scored with the
expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, documents
from .tokens import sliced

MAX_LABELLED = 12_000  # documents the model is fitted on at most
LEAST_Z = 3.0  # standard deviations between a feature's shares among toxic and other documents, from which it is in the model
LEAST_RATIO = 8  # and how much larger the first share is
PREFIXES = (3, 4, 5, 6)
GRADES = 3
_MARKS = r"[\s\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def chunk_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word of each place, text of each place) of lower-cased texts."""
    lower = pc.utf8_lower(pc.replace_substring_regex(text.cast(pa.large_string()), _MARKS, " "))
    lists = pc.split_pattern(lower, " ")
    words = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return words.dictionary, words.indices.to_numpy(), np.repeat(np.arange(len(text)), np.diff(at))


def word_features(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)] if word else []


def _pairs(text: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of the features that are ``known``, in the order of the texts."""
    words, of, doc = chunk_words(text)
    listed = [[known[f] for f in word_features(w) if f in known] for w in words.to_pylist()]
    sizes = np.fromiter(map(len, listed), np.int64, len(listed))
    pool = np.array([f for fs in listed for f in fs], np.int64)
    starts = np.cumsum(sizes) - sizes
    hit = np.flatnonzero(sizes[of] > 0)
    n = sizes[of[hit]]
    ends = np.cumsum(n)
    feature = pool[np.repeat(starts[of[hit]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    pair = np.unique(np.repeat(doc[hit], n) * np.int64(max(1, len(known))) + feature)
    return pair // max(1, len(known)), pair % max(1, len(known))


@dataclass
class OrdinalModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -500, 500)))


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the penalised likelihood (Adam on the whole sample)."""
    n = len(grade)
    rates = np.array([np.clip((grade >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, grades)])
    first = np.log(1 / rates - 1)
    gaps = np.log(np.maximum(np.diff(first), 0.1))
    x = np.concatenate([np.zeros(n_features), first[:1], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    rows = np.arange(n)
    for t in range(1, steps + 1):
        w, theta = x[:n_features], np.cumsum(np.concatenate([x[n_features : n_features + 1], np.exp(x[n_features + 1 :])]))
        score = np.bincount(doc, w[feature], n)
        above = np.ones((n, grades + 1))
        above[:, 1:grades] = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -500, 500)))
        above[:, grades] = 0
        slope = above * (1 - above)
        p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
        d_score = (slope[rows, grade] - slope[rows, grade + 1]) / p
        d_theta = np.zeros(grades + 1)
        np.add.at(d_theta, grade, -slope[rows, grade] / p)
        np.add.at(d_theta, grade + 1, slope[rows, grade + 1] / p)
        d_theta = d_theta[1:grades]
        g = np.empty_like(x)
        g[:n_features] = np.bincount(feature, d_score[doc], n_features) - l2 * w
        g[n_features] = d_theta.sum()
        g[n_features + 1 :] = np.exp(x[n_features + 1 :]) * np.cumsum(d_theta[::-1])[::-1][1:]
        g /= n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:n_features], np.cumsum(np.concatenate([x[n_features : n_features + 1], np.exp(x[n_features + 1 :])]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """Fit on at most ``max_labelled`` labelled documents, taken by a hash of their ids.

    ``labels`` needs ``doc_id`` and ``toxic`` (0 or 1; nulls are left out, the worst
    of repeated labels counts). Without both classes the model scores all 0.
    """
    given = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    scratch = Scratch(docs.sparkSession, "toxicity")
    # Bounded by max_labelled rows of two numbers, so it can go to every executor.
    labelled = scratch.stage(documents(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic"), "labelled")

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words, of, doc = chunk_words(b.column("text"))
            for k in range(b.num_rows):
                own = {f for w in words.take(pa.array(np.unique(of[doc == k]))).to_pylist() for f in word_features(w)}
                yield pa.record_batch([pa.array(sorted(own), pa.string())], names=["feature"])

    by_class = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(by_class) != {0, 1}:
        return OrdinalModel({}, np.zeros(0), np.full(GRADES - 1, 40.0) + np.arange(GRADES - 1))
    n1, n0 = by_class[1], by_class[0]
    seen = labelled.where("toxic = 1").select("text").mapInArrow(toxic_features, "feature string").groupBy("feature").count()
    # As many as the toxic documents of the sample have, three times each at least.
    names = sorted(r["feature"] for r in seen.where(F.col("count") >= max(3, n1 // 200)).collect())
    candidates = {f: k for k, f in enumerate(names)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(candidates)), np.int64)
        for b in sliced(batches):
            doc, feature = _pairs(b.column("text"), candidates)
            toxic = b.column("toxic").to_numpy()[doc]
            for k in (0, 1):
                total[k] += np.bincount(feature[toxic == k], minlength=len(candidates))
        some = np.flatnonzero(total.any(0))
        yield pa.record_batch([pa.array(some.astype("int32")), *map(pa.array, total[:, some])], names=["feature", "n0", "n1"])

    c0, c1 = np.zeros(len(names)), np.zeros(len(names))
    for r in labelled.mapInArrow(counted, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():  # a row a candidate
        c0[r["feature"]], c1[r["feature"]] = r["n0"], r["n1"]
    p = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = (c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero(np.abs(z) >= LEAST_Z)
    known = {names[k]: i for i, k in enumerate(chosen.tolist())}
    telling = (z > LEAST_Z)[chosen] & (c1 * n0 > LEAST_RATIO * c0 * n1)[chosen]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            doc, feature = _pairs(b.column("text"), known)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32()), pa.array(feature, pa.int32()))
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), lists], names=["doc_id", "toxic", "features"])

    sparse = labelled.mapInArrow(rows, "doc_id long, toxic int, features array<int>").toArrow().sort_by("doc_id")
    toxic = sparse.column("toxic").to_numpy()
    lists = sparse.column("features").combine_chunks()
    feature = lists.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(toxic)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    strength = np.bincount(doc, telling[feature], len(toxic))
    grade = np.where(toxic == 0, 0, np.where(strength > np.median(strength[toxic == 1]), 2, 1))
    return OrdinalModel(known, *fit_ordinal(doc, feature, grade, len(known)))


SCORES = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Expected severity (0 to 2), P(toxic), the likeliest grade, and whether toxic (P >= 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            doc, feature = _pairs(b.column("text"), model.features)
            s = np.bincount(doc, model.weights[feature], b.num_rows) if len(model.weights) else np.zeros(b.num_rows)
            above = model.at_least(s)
            each = -np.diff(np.hstack([np.ones((len(s), 1)), above, np.zeros((len(s), 1))]), axis=1)
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(each.argmax(1).astype("int32")), pa.array(above[:, 0] >= 0.5)],
                names=[x.split()[0] for x in SCORES.split(", ")],
            )

    return documents(docs).mapInArrow(run, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Scores of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or
    empty text has no features and the base rate's score. Repeated rows and null
    ids are scored each. An empty table gives no rows; without labels of both
    classes nothing is toxic.
    """
    return score(docs, fit(docs, labels, max_labelled))


def keep_clean(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns kept; scoring is a scan, nothing is shuffled."""
    model = fit(docs, labels, max_labelled)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_text"):
            doc, feature = _pairs(b.column("_text"), model.features)
            s = np.bincount(doc, model.weights[feature], b.num_rows) if len(model.weights) else np.zeros(b.num_rows)
            yield b.filter(pa.array(model.at_least(s)[:, 0] < 0.5)).select(columns)

    whole = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return whole.mapInArrow(run, docs.schema)
