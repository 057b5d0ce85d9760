"""Toxicity on held-out labels, neighbours against brute force, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import neighbours, toxicity

SF = "/root/testdata/sf0.001"


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    bad = ["nasty", "vile", "rotten"]
    rows = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(60)]
        toxic = k % 6 == 0
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad).upper() + "!"
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_held_out_toxicity(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows] + [(901, None, 0.1), (902, "", 0.1), (None, "nasty vile rotten", 0.1)], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 600] + [(5, None), (7777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[k].toxic, bool(y)) for k, _, y in rows if k >= 600]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert not got[901].toxic and not got[902].toxic and got[None].toxic
    assert all(0 <= r.severity <= 2 for r in got.values())
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if not r.toxic}


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.toxic for r in toxicity.toxicity(docs, labels).collect()] == [False]
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 3))
    latent = x @ np.array([3.0, 0.0, -2.0]) + rng.logistic(size=3000)
    grade = (latent > 0.5).astype(int) + (latent > 2.5).astype(int)
    doc, feature = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(doc, feature, grade, 3, l2=0.01, steps=800)
    assert w == pytest.approx([3.0, 0.0, -2.0], abs=0.3)
    assert theta == pytest.approx([0.5, 2.5], abs=0.3)


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 16)) + 2 * rng.normal(size=(10, 16))[rng.integers(0, 10, n)]
    m[10:20] = m[10]  # equal vectors
    return m.astype("f4").astype(float)


def test_neighbours_recall_and_scores(spark):
    m = vectors(1500, 3)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(m)]
    rows += [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [float("nan")] * 16, 1), (2150, [None] + [1.0] * 15, 1), (2200, [float("inf")] * 16, 1), (None, m[0].tolist(), 1)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50))
    norm = np.sqrt((m * m).sum(1))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = m @ m[q] / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((np.arange(len(m)), -s))[:5]
        hits += len({f[1] for f in found} & set(best.tolist()))
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [f[2] for f in found] == pytest.approx([s[f[1]] for f in found], abs=1e-12)
    assert hits / (5 * len(got)) >= 0.9


def test_search_list_of_a_hub_keeps_its_own_nearest(spark):
    edges = [(0, k, 0.99 - k / 1000) for k in range(1, 21)] + [(k, 0, 0.5 + k / 2000) for k in range(100, 700)]
    lists = {r.node: set(r.nbrs) for r in neighbours.search_lists(spark.createDataFrame(edges, neighbours.EDGES)).collect()}
    assert lists[0] == {*range(1, 21), *range(680, 700)}
    assert lists[100] == {0} and lists[7] == {0}


def test_queries_of_a_block_are_dealt_into_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKED", 1000)
    asked = spark.createDataFrame([(0, q, [1, 2]) for q in range(300)] + [(1, 5, [3])], "block long, q long, cands array<long>")
    blocks = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "block long, node long")
    some, vectors = neighbours._dealt(asked, blocks)
    groups = {(r.block, r.piece): r["count"] for r in some.groupBy("block", "piece").count().collect()}
    assert sum(groups.values()) == 301 and max(groups.values()) < 40
    assert vectors.count() == 2 * 20 + 1 and set(groups) <= {(r.block, r.piece) for r in vectors.collect()}


def test_few_and_equal_vectors(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(60)] + [(100, [2.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, k, k) for k in range(1, 6)] + [(50, k + 1, k) for k in range(5)] + [(100, k + 1, k) for k in range(5)]
    two = neighbours.nearest(df.where("vec_id in (0, 1)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 1)]
    assert neighbours.nearest(df.where("false")).count() == 0


def test_shorter_vectors_count_as_filled_up_with_zeros(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(1, 1.0), (2, 0.707107), (3, 0.0)]


def test_the_graph_is_refined_until_it_settles(spark, monkeypatch):
    done = []
    plain = neighbours.descend
    monkeypatch.setattr(neighbours, "descend", lambda *a, **k: done.append(1) or plain(*a, **k))
    monkeypatch.setattr(neighbours, "TREES", 1)
    m = vectors(900, 5)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>")
    neighbours.nearest(df)
    settled = len(done)
    assert 1 <= settled < neighbours.ROUNDS
    neighbours.nearest(df, rounds=1)
    assert len(done) == settled + 1


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "line dedup":
            assert docs.count() == before.count()
            assert docs.agg(F.sum(F.length("text"))).first()[0] < before.agg(F.sum(F.length("text"))).first()[0]
            assert docs.where("n_chars <> char_length(text)").count() == 0
    assert counts[1] < counts[0] and counts[3] < counts[2]
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]
