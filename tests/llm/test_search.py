"""Ranked search against scoring every document, and exact duplicates against grouping by text."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from oracle import duck_rows, spark_rows

from spindrift.llm import exact, ranked, registry

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 100 - 75 + 75 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["The", "the", "Ünder", "a1"]
    some = lambda most: "".join(rng.choice(words[: rng.choice([5, 20, 64])]) + rng.choice([" ", "-", "\x00", ". ", "_"]) for _ in range(rng.randrange(most)))
    docs = [(k, some(40)) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .- "), (None, docs[3][1]), (5, docs[3][1]), (3, docs[3][1]), (n + 3, "w1 " * 20_000)]
    return docs, [(k, some(12)) for k in range(15)] + [(20, None), (21, "w1 w1 w2"), (21, "w1 w1 w2"), (None, "w7"), (22, "unheard"), (23, "the the")]


@pytest.mark.parametrize("seed", range(3))
def test_search_against_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(ranked, "QUERIES", 7)
    monkeypatch.setattr(ranked, "WAVES", (1, 2, 4))
    docs, items = made(seed, 120)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, block int, query string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = ranked.search(d, q, block_docs=4, block_postings=200)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr) == brute_search(docs, items)


def test_search_prunes_blocks(spark):
    rows = [(k, f"common word{k % 7} filler text {'rare gem ' * (k == 500)}") for k in range(1000)]
    scratch = ranked.Scratch(spark, "ranked")
    index = scratch.stage(ranked.index_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), block_docs=10), "index")
    queries = ranked.Queries([b"rare gem common"])
    n_docs, n_terms, df = ranked._statistics(index, queries)
    assert (n_docs, dict(zip(queries.terms, df.tolist()))) == (1000, {b"common": 1000, b"gem": 1, b"rare": 1})
    queries.weigh(df, n_docs)
    bounds = {r.block: r.bound for r in ranked._bounds(index, queries, n_docs, n_terms).collect()}
    best = ranked._search(scratch, index, queries, 1).collect()
    assert [r.doc_id for r in best] == [500]
    assert sum(b >= best[0].score for b in bounds.values()) == 1


def test_few_blocks_are_unpacked_at_once(spark, monkeypatch):
    """A task that reads the index holds all rows of a row group, up to 4096, in memory."""
    kept, stage = [], ranked.Scratch.stage
    monkeypatch.setattr(ranked.Scratch, "stage", lambda *args: (kept.append(stage(*args)), kept[-1])[1])
    docs = spark.createDataFrame([(k, f"common word{k % 7}") for k in range(300)], "doc_id long, text string").coalesce(1)
    assert ranked.search(docs, spark.createDataFrame([(1, "word3")], "item_id long, text string"), block_docs=4).count() == 10
    (file,) = kept[0].inputFiles()  # the index
    parts = pq.ParquetFile(urlparse(file).path).metadata
    assert parts.num_rows == 75
    assert max(parts.row_group(k).num_rows for k in range(parts.num_row_groups)) <= ranked.READ_BLOCKS


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(d.where("false"), q).count() == 0
    assert ranked.search(d, q.where("false")).count() == 0
    assert ranked.search(d, q).columns == ["item_id", "rank", "doc_id", "score"]


def test_impacts_beyond_64_bits():
    import numpy as np

    big = 1 << 40
    got = ranked.impacts(np.array([3, 1]), np.array([big, 2]), 1 << 20, 1 << 45)
    m = [25 + 75 * n * (1 << 20) // (1 << 45) for n in (big, 2)]
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * x) for t, x in zip((3, 1), m)]


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_exact_dedup"])
def test_against_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck_rows(registry.ORACLE_SQL[name], SF)


def brute_exact(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (max if keep == "largest" else min)(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, stays, len(ids), i == stays and first, sha))
            first = first and i != stays
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,trie_bytes,parts", [("largest", exact.TRIE_BYTES, 2), ("smallest", 4_000, 3), ("largest", 700, 5)])
def test_exact_against_grouping(spark, monkeypatch, keep, trie_bytes, parts):
    monkeypatch.setattr(exact, "MOST_IDS", 8)
    rng = random.Random(3)
    texts = [None, "", " ", "é", "é", "x" * 300_000, *("".join(rng.choice("ab") for _ in range(rng.choice([1, 4, 4, 9, 400]))) for _ in range(150))]
    rows = [(k, rng.choice(texts)) for k in range(500)] + [(1000 + k, "hot text") for k in range(200)] + [(7, "hot text"), (1199, "hot text"), (None, "hot text"), (None, "lone")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, row int, keep_id string").repartition(parts)
    got = exact.exact_duplicates(docs, keep, trie_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == brute_exact(rows, keep)


def test_exact_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_duplicates(docs).count() == 0
    with pytest.raises(ValueError):
        exact.exact_duplicates(docs, "first")


@pytest.mark.parametrize("seed", range(20))
def test_a_text_is_kept_or_given_up_whole(seed):
    rng = random.Random(seed)
    tries, all_, gone = exact.RadixTries(), defaultdict(list), defaultdict(list)
    for k in range(200):
        text = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 3, 5, 5, 8, 20])))
        all_[text].append(k)
        found = tries.place(text)
        (gone[text] if found is None else found).append(k)
        if rng.random() < 0.03:
            for path, given in tries.give_up(tries.size // 2, mark=True):
                gone[path] += given
    held = {p: f for p, f in tries.everything()}
    assert not set(held) & set(gone)
    assert {p: sorted(f) for p, f in (held | gone).items()} == dict(all_)
    assert tries._bytes(tries.top) - exact.NODE_BYTES >= tries.size - 1
