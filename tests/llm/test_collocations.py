"""Collocations against plain counting, and the bounded automaton against one built word by word."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import duck_rows, spark_rows

from spindrift.llm import collocations as co
from spindrift.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def brute(rows, depth=3, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, depth + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= least}
    out = []
    for (lang, p), a in found.items():
        longer = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(own)]
    return sorted(ranked)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "x\x1cy", "Σ", "b-b", "c", "dd"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?", "\x0b", " ;"]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 2, 30, 200])))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_counting(spark, seed):
    rows = [*made(seed), (None, None), ("en", ""), ("en", " . "), ("fr", "only once"), *[("hot", "new york city. new york times")] * 12]
    # extra columns whose names clash with those of the result or of the steps between
    docs = spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    assert result(co.collocations(docs, shard_bytes=500)) == brute(rows)
    assert result(co.collocations(docs.repartition(3), least=3, top=7, depth=4, subsumed_percent=80)) == brute(rows, 4, 3, 80, 7)


def test_long_text_and_empty_table(spark):
    rows = [("en", "alpha beta gamma " * 40_000), ("en", "alpha beta. " * 3)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert result(co.collocations(docs)) == brute(rows)
    assert co.collocations(docs.where("false")).count() == 0


def test_against_sql(spark):
    name = "op11_collocations"
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck_rows(registry.ORACLE_SQL[name], SF)


def online_classes(sequences, depth):
    """{substring of at most ``depth`` words: (shortest of its endpos class, count)} by comparing endpos sets."""
    ends = {}
    for s, words in enumerate(sequences):
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + depth) + 1):
                ends.setdefault(tuple(words[i:j]), set()).add((s, j))
    return {p: (min(len(q) for q in ends if p[len(p) - len(q) :] == q and ends[q] == e), len(e)) for p, e in ends.items()}


@pytest.mark.parametrize("seed", range(4))
def test_states_are_the_endpos_classes(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab c.") + rng.choice(["", " "]) for _ in range(120))
    words, codes, place = co.words_of(pa.array([text, None or "", "a b. a", "b a"]))
    automaton = co.SuffixAutomaton(codes, place, len(words), 3)
    classes = online_classes([w for t in (text, "a b. a", "b a") for w in pieces(t) if w], 3)
    got = {}
    for (strings, counts), shortest in zip(automaton.phrases(words), automaton.shortest):
        got |= {tuple(p.split(" ")): (int(s), int(n)) for p, n, s in zip(strings.to_pylist(), counts, shortest)}
    assert got == classes
    assert sum(len(at) for _, at in automaton.states()) == len({(p[len(p) - s :], n) for p, (s, n) in classes.items()})


def test_extensions_to_the_left():
    words, codes, place = co.words_of(pa.array(["a b. a b c. b b c", "a b"]))
    automaton = co.SuffixAutomaton(codes, place, len(words), 3)
    strings = [s.to_pylist() for s, _ in automaton.phrases(words)]
    assert dict(zip(strings[1], automaton.lefts(words, 1).to_pylist())) == {"a b": ":3", "b b": ":1", "b c": ":2 a b"}
    assert dict(zip(strings[0], automaton.lefts(words, 0).to_pylist())) == {"a": ":3", "b": ":5 a:3 b", "c": ":2 b:2"}


def test_words_of_sliced_arrays():
    texts = pa.array(["x y", "A b.C", "", "d"], pa.string())
    words, codes, place = co.words_of(texts.slice(1))
    assert words.take(pa.array(codes)).to_pylist() == ["a", "b", "c", "d"]
    assert place.tolist() == [0, 1, 0, 0]
    assert len(co.words_of(texts.slice(2, 1))[1]) == 0
    assert np.array_equal(co.words_of(pa.array([], pa.string()))[2], [])
