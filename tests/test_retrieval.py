"""Scores by the restricted index against loops over all terms, and what goes through a shuffle."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.operators import retrieval

WORDS = ["Fox", "dog.", "(hen)", "the", "...", "owl", "cat!", "ant", "bee?", "cow"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    # Ids 0 to 4 stand for two rows each; two rows have no terms.
    docs = [(k % 40, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30)))) for k in range(45)] + [(90, None), (91, "the")]
    return docs, [(1, "fox hen fox"), (2, "owl ... Cow"), (3, "unknown"), (4, "the")]


def loop_terms(text):
    bare = [w.strip(retrieval.MARKS) for w in (text or "").lower().split()]
    return [w for w in bare if w not in retrieval.STOP_WORDS]


def loops(docs, queries):
    tf = {}
    for k, t in docs:
        if terms := loop_terms(t):
            tf.setdefault(k, Counter()).update(terms)
    n, df = len(docs), Counter(t for c in tf.values() for t in c)
    mean = sum(map(Counter.total, tf.values())) / n
    idf = {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in df}
    norm = lambda c: math.sqrt(sum(((1 + math.log(k)) * idf[t]) ** 2 for t, k in c.items() if t in idf))
    bm, cos = {}, {}
    for q, text in queries:
        asked = Counter(loop_terms(text))
        for k, c in tf.items():
            if both := asked.keys() & c.keys():
                bm[q, k] = sum(asked[t] * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t in both)
                cos[q, k] = sum((1 + math.log(asked[t])) * (1 + math.log(c[t])) * idf[t] ** 2 for t in both) / norm(asked) / norm(c)
    return bm, cos


def test_scores_and_shuffles(spark, corpus):
    rows, items = corpus
    docs, queries = spark.createDataFrame(rows, "id int, text string"), retrieval.query_terms(spark.createDataFrame(items, "q int, text string"), "q", "text")
    n = docs.agg(F.count("*").alias("n"))
    whole = retrieval.postings(docs, "id", "text")
    bm, cos = loops(rows, items)
    # The index of the passages' terms, with lengths in rows without a term.
    few = retrieval.postings(docs, "id", "text", queries)
    assert few.agg(F.sum("tf")).first()[0] == whole.agg(F.sum("tf")).first()[0]
    for scores, expect in ((retrieval.bm25(few, queries, n), bm), (retrieval.bm25(whole, queries, n), bm), (retrieval.tf_idf_cosine(whole, queries, n), cos)):
        got = {(r["query"], r.doc): r.score for r in scores.collect()}
        assert got.keys() == expect.keys() and all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in expect.items())
        # Pairs of query and document are added up where the document is.
        assert "hashpartitioning(query" not in scores._jdf.queryExecution().executedPlan().toString()
