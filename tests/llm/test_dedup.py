"""Long repeats, fuzzy lines and SimHash groups against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import components, lines, repeats, simhash
from spindrift.llm.scratch import Scratch


def grouped(n, links):
    least = list(range(n))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randrange(30, 200))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        for k in range(9, len(w), 10):
            w[k] += "\n"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def texts():
    return [*random_texts(1, 80), None, "", " \t", "One", "one ", "ONE two", "É é", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "a", 7) for k, t in enumerate(texts)], "doc_id long, text string, fp string, pos int")


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[k : k + 3]), seed=42).intdigest() for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, texts):
    fps = [brute_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    expect = grouped(len(fps), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{fps[k]:016x}", expect[k]) for k in range(len(fps))}
    kept = {r.doc_id for r in simhash.keep_one(docs, 3).select("doc_id").collect()}
    assert kept == set(expect)


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_ball_hashing_finds_every_distance(spark, distance):
    rng = random.Random(distance)
    rows, base = [], [rng.getrandbits(64) for _ in range(40)]
    for f in base:
        g = f
        for bit in rng.sample(range(64), distance):
            g ^= 1 << bit
        rows += [(f,), (g,)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for (f,) in rows]
    groups = {r.fp: r.group for r in simhash.fingerprint_groups(Scratch(spark, "t"), spark.createDataFrame(signed, "fp long").distinct()).collect()}
    together = [groups[a[0]] == groups[b[0]] for a, b in zip(signed[::2], signed[1::2])]
    assert all(together) if distance <= 3 else not any(together)


@pytest.fixture
def plans(monkeypatch):
    """The plan of every table that is written from now on, by its name."""
    seen, stage = {}, Scratch.stage
    monkeypatch.setattr(Scratch, "stage", lambda self, df, what: (seen.setdefault(what, []).append(df._jdf.queryExecution().executedPlan().toString()), stage(self, df, what))[1])
    return seen


def test_exploded_balls_are_not_broadcast(spark, plans):
    """Spark takes the 33 variants of a half for one row, and would collect them all on the driver."""
    fps = spark.range(200).select((F.xxhash64("id")).alias("fp"))
    simhash.fingerprint_groups(Scratch(spark, "t"), fps)
    met = [p for p in plans["links"] if "bit_count" in p]
    assert len(met) == 1 and "SortMergeJoin" in met[0] and "Broadcast" not in met[0]


def test_exploded_slots_are_not_broadcast(spark, plans):
    docs = spark.createDataFrame([(k, f"some words of line {'abcdefghij'[k % 10]} here\nand again {'xyz'[k % 3]} of them all") for k in range(40)], "doc_id long, text string")
    assert lines.dedup_lines(docs).count() == 40
    for name in ("near", "members"):
        (plan,) = plans[name]
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300), (301, None)]
    got = {r.node: r.component for r in components.connected_components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    expect = grouped(302, real)
    assert got == {n: expect[n] for pair in real for n in pair}


def brute_lines(texts):
    import regex

    def norm(line):
        return regex.sub(r"[^\p{L}0]+", " ", re.sub("[0-9]+", "0", line.lower())).strip()

    def fingerprint(n):
        words = set(n.split(" "))
        if len(words) < 4:
            return xxhash.xxh64(n.encode(), seed=42).intdigest()
        h = np.array([xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words], "<u8")
        ones = np.unpackbits(h.view("u1").reshape(len(h), 8), axis=1, bitorder="little").sum(0)
        return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    places, names = [], {}
    for doc, t in enumerate(texts):
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            if n := norm(line):
                places.append((doc, pos, names.setdefault(n, len(names))))
    distinct = list(names)
    fps = [fingerprint(n) for n in distinct]
    links = []
    for a in range(len(distinct)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                most = max(len(distinct[a]), len(distinct[b]))
                if edits(distinct[a], distinct[b]) <= int((0.2 + 1e-9) * most):
                    links.append((a, b))
    group = grouped(len(distinct), links)
    first, gone = {}, collections.defaultdict(set)
    for doc, pos, n in places:
        if first.setdefault(group[n], (doc, pos)) != (doc, pos):
            gone[doc].add(pos)
    return len(links), [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in enumerate(texts)], gone


def test_lines(spark, texts):
    near = "the quick brown fox jumps over the lazy dog and runs far away from here today my friend of old times and places unknown"
    more = [near, near + " x1", near.upper() + "!!", near.replace("quick", "quickk"), "a\n\n---\na", "12 34\n5 6", "w " * 400, "w " * 400 + "v"]
    whole = [*texts, *more]
    docs = spark.createDataFrame([(k, t, 5, "x") for k, t in enumerate(whole)], "doc_id long, text string, n_removed int, key string")
    n_links, expect, gone = brute_lines(whole)
    assert n_links > 0
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert {k: r.text for k, r in got.items()} == dict(enumerate(expect))
    assert {k: r.n_removed for k, r in got.items()} == {k: len(gone[k]) for k in range(len(whole))}
    assert got[0].key == "x"


def brute_line_fingerprint(norm):
    words = set(norm.split(" "))
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    if len(words) < 4:
        return xxhash.xxh64(norm.encode(), seed=42).intdigest()
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_line_fingerprints_of_all_lengths(spark):
    rng = random.Random(8)
    norms = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in [1, 2, 3, 4, 5, 7, 31, 63, 64, 126, 127, 128, 129, 254, 255, 600, 3000]]
    norms += ["the " * 500 + "end", " ".join(f"w{k}" for k in range(127)), " ".join(f"w{k}" for k in range(128))]
    got = [r.fp % (1 << 64) for r in lines.with_simhash(spark.createDataFrame([(n,) for n in norms], "norm string").coalesce(1)).collect()]
    assert got == [brute_line_fingerprint(n) for n in norms]


def test_many_variants_of_one_line(spark):
    """Long lines, each with another word somewhere, and some with the same words in other order."""
    rng = random.Random(9)
    base = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    texts = []
    for k in range(80):
        w = list(base)
        w[rng.randrange(100)] = "z" + "".join(rng.choice("abcdef") for _ in range(6))
        texts.append(" ".join(w))
    for _ in range(8):
        rng.shuffle(base)
        texts.append(" ".join(base))
    _, expect, _ = brute_lines_of_few_edits(texts)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(expect))


def brute_lines_of_few_edits(texts):
    """As ``brute_lines`` for texts of one line of equal word counts: edit similarity by the words that differ where it is certain."""
    fps = [brute_line_fingerprint(t) for t in texts]
    words = [t.split(" ") for t in texts]
    links = []
    for a in range(len(texts)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and sum(x != y for x, y in zip(words[a], words[b])) <= 2:
                links.append((a, b))
    group = grouped(len(texts), links)
    return len(links), [t if group[k] == k else "" for k, t in enumerate(texts)], group


def test_first_meeting_is_met_once(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        f = rng.getrandbits(63)
        g = f
        for bit in rng.sample(range(63), rng.randrange(1, 4)):
            g ^= 1 << bit
        rows.append((min(f, g), max(f, g)))
    d = spark.createDataFrame(rows, "fp long, fp2 long")
    a = lines._filed(d.select("fp").distinct())
    b = lines._filed(d.select("fp2").distinct().withColumnRenamed("fp2", "fp")).withColumnRenamed("fp", "fp2")
    met = a.join(b, "slot").join(d, ["fp", "fp2"]).where(lines._first_meeting())
    assert met.count() == len(set(rows)) and met.select("fp", "fp2").distinct().count() == len(set(rows))


def test_lines_of_no_table_and_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "same line"), (None, "same line"), (1, "same line"), (2, "Same  line!")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(docs).collect()) == [(0, "same line"), (0, "same line"), (1, "same line"), (2, "")]
    assert lines.dedup_lines(docs.where("false")).count() == 0


def brute_repeats(texts, length):
    seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                covered[k] += 1
                covered[k + length] -= 1
        c = np.cumsum(covered)[: len(t)] > 0
        kept = np.frombuffer(t, "u1")[~c].tobytes()
        edge = np.diff(np.concatenate([[0], c.astype(int), [0]]))
        runs = np.flatnonzero(edge < 0) - np.flatnonzero(edge > 0)
        out.append((len(t), int(c.sum()), len(runs), hashlib.sha256(kept).hexdigest(), int(runs.max(initial=0))))
    return out


@pytest.mark.parametrize("most", [512, 2])
def test_repeats(spark, most):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefg é\n") for _ in range(1500)) for _ in range(3)]
    docs = []
    for _ in range(30):
        b = rng.choice(base)
        a = rng.randrange(0, 700)
        t = list(b[a : a + rng.randrange(380, 800)])
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = "X"
        docs.append("".join(rng.choice("hijk") for _ in range(rng.randrange(300))) + "".join(t) + "".join(rng.choice("lmno") for _ in range(rng.randrange(300))))
    docs += [None, "", "a" * 399, "a" * 1000, "b" * 400, "b" * 400, "xyz " * 300]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(docs)], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in repeats.remove_repeats(df, most=most).collect()}
    raw = [(t or "").encode() for t in docs]
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == {k: x[:4] for k, x in enumerate(brute_repeats(raw, 400))}
    assert {k: (r.n_passages, r.longest_passage) for k, r in got.items()} == {k: (x[2], x[4]) for k, x in enumerate(brute_repeats(raw, 240))}


def test_repeats_in_rows_repeated_under_one_id(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(450))
    df = spark.createDataFrame([(1, t), (1, t), (None, t + "z"), (None, "short")], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect()) == [(5, 0), (450, 450), (450, 450), (451, 450)]
    assert repeats.remove_repeats(df.where("false")).count() == 0


def test_repeat_intervals_by_stack_scan():
    assert sorted(repeats.intervals(np.array([3, 5, 5, 1]))) == [(1, 0, 4), (3, 0, 3), (5, 1, 3)]


def test_edits_by_words_are_no_fewer_than_the_distance(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        a = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(0, 2)] = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))] * rng.randrange(0, 2)
            b = b or ["a"]
        rows.append((a, b))
    rows += [(["a"], ["b"]), (["a"], ["a", "b"]), (["a", "b"], ["b"]), (["é", "x"], ["x", "é"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").selectExpr("a = b AS same", "levenshtein(array_join(a, ' '), array_join(b, ' ')) AS least", f"{lines._edits_by_words('a', 'b')} AS n").collect()
    assert all(r.least <= r.n and (r.n == 0) == r.same for r in got)
    assert sum(r.n <= r.least + 3 for r in got) > len(got) / 2  # near enough to be of use


def test_alike_is_the_edit_similarity(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    pairs = []
    for _ in range(200):
        a = [rng.choice(words) for _ in range(rng.randrange(1, 25))]
        b = [w for w in a if rng.random() > 0.1]
        for _ in range(rng.randrange(0, 5)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(words))
        pairs.append((" ".join(a), " ".join(b) or "x"))
    df = spark.createDataFrame(pairs, "norm string, norm2 string")
    plain = df.where("levenshtein(norm, norm2) <= floor((1 - 0.8 + 1e-9) * greatest(char_length(norm), char_length(norm2)))")
    kept = lines._alike(df, 0.8)
    assert 0 < plain.count() < len(pairs)
    assert sorted(map(tuple, kept.select("norm", "norm2").collect())) == sorted(map(tuple, plain.collect()))
    # What pairs are compared by is worked out in one place of the plan, not again wherever it is named.
    assert kept._jdf.queryExecution().executedPlan().toString().count("split(norm#") == 1
