"""The pipeline's near-duplicate stage against brute force on exact Jaccard similarity."""

import random

import corpus_pipeline
from test_dedup import grouped

from spindrift.llm import similar


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return w


def test_near_dedup_links_at_similarity_alone(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 300))]
        texts += [" ".join(edited(rng, base, e)) for e in (0, 0, 1, 2, 3, 4, 6, 9)]
    # One large group of near copies.
    base = [f"h{k}" for k in range(120)]
    texts += [" ".join(edited(rng, base, 1)) for _ in range(120)] + [None, "", " \t", "One", "one ", "two words"]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    expect = grouped(len(texts), links)
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)] + [(None, texts[0], "a")], "doc_id long, text string, band string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(expect))
    assert [r.text for r in got if r.doc_id is None] == [texts[0]]


def test_exploded_bands_are_not_broadcast(spark, monkeypatch):
    """Spark takes the twenty bands of a set for one row."""
    plans, stage = {}, similar.Scratch.stage
    monkeypatch.setattr(similar.Scratch, "stage", lambda self, df, what: (plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString()), stage(self, df, what))[1])
    docs = spark.createDataFrame([(k, " ".join(f"w{k // 2 + j}" for j in range(30))) for k in range(20)], "doc_id long, text string")
    assert similar.keep_one_similar(docs).count() > 0
    assert "SortMergeJoin" in plans["shared"] and "Broadcast" not in plans["shared"]


def test_rows_repeated_under_one_id(spark):
    t = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(2, t), (2, t), (1, "other"), (1, t + " x"), (3, t)], "doc_id int, text string")
    assert sorted(r.doc_id for r in similar.keep_one_similar(docs).collect()) == [1]
    assert similar.keep_one_similar(docs.where("false")).count() == 0


def test_near_copies_meet_by_simhash(spark, monkeypatch):
    """Without any band, sets three bits apart or less still meet; each link is verified."""
    import numpy as np

    from spindrift.llm import simhash

    fp = lambda t: simhash.majority(similar.shingle_set(t.encode(), 5))
    base = " ".join(f"w{k}" for k in range(300))
    near = next(t for k in range(500) if 0 < (fp(base) ^ fp(t := f"{base} x{k}")).bit_count() <= 3)
    monkeypatch.setattr(similar, "bands", lambda hashes: np.empty(0, "<i8"))
    docs = spark.createDataFrame([(1, base), (2, near), (3, " ".join(f"v{k}" for k in range(300)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one_similar(docs).collect()) == [1, 3]
