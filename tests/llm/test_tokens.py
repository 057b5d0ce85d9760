"""Token ids, token files and packing against plain encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spindrift.llm import packing, token_files, tokens

TEXTS = [
    None, "", " ", "  a\tb ", "It's <|endoftext|>x' 's don't\x1c é é ̈ Σας ΣΑΣ 12 3a\r\nq", "<|startoftext|><|endoftext|>",
    " a​b <| x |> ª º KK Å ǅ. İ ﬁ,ß.", "word " * 6000, "Same text.", "Same text.", "A.B,c;d:e!f?g", "a, b. c\n\nd.", "日本語 テキスト。", "naïve, CAFÉ.",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(TEXTS)] + [(None, "no id", "x", 2), (3, "again 3", "x", 3), (3, "again 3", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")


def test_ids_are_those_of_plain_encoding(plain):
    rng = random.Random(5)
    made = ["".join(rng.choice("abcXYZ .,'!?;:\n\t-é12ÀΣ<|>") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts = [t or "" for t in TEXTS] + made
    flat, at = tokens.tokenizer(tokens.default_vocabulary()).encode(pa.array(texts))
    assert [flat[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [plain(t) for t in texts]


def test_a_memo_that_is_full_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 3000)
    monkeypatch.setattr(tokens, "PASSING_BYTES", 2000)
    coder = tokens.ChunkTokenizer(tokens.default_vocabulary())
    rng = random.Random(6)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcde,.") for _ in range(rng.choice([3, 5, 90]))) for _ in range(40)) for _ in range(4)]
        flat, at = coder.encode(pa.array(texts))
        assert [flat[at[k] : at[k + 1]].tolist() for k in range(4)] == [plain(t) for t in texts]
        assert coder._kept_bytes <= 3000 and coder._passing_bytes <= 2000
    assert max(map(len, coder._kept)) <= tokens.LONGEST_CHUNK


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS]
    flat, at = tokens.ChunkTokenizer(path).encode(pa.array(texts))
    assert [flat[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_and_places(spark, docs, plain):
    got = packing.pack_documents(docs, capacity=256, keep_ids=True).collect()
    expect = []
    for doc_id, t in docs.select("doc_id", "text").toArrow().to_pandas().itertuples(index=False):
        whole = np.array([*plain(t), 1], "<u4")
        expect += [(None if doc_id != doc_id else int(doc_id), k, s, len(whole[s : s + 256]), zlib.crc32(whole[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(whole), 256))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(expect, key=key)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_counts_of_lengths_are_not_broadcast(spark, docs):
    """They are rows for each length and partition, in files of a byte or two a row."""
    plan = packing.pack_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_empty_tables(spark, docs):
    nothing = docs.where("false")
    assert packing.pack_documents(nothing).count() == 0
    assert token_files.token_file_digest(nothing).count() == 0


def test_token_files(spark, docs, plain):
    got = token_files.token_file_digest(docs).collect()
    assert len(got) == docs.count()
    assert sum(r.n_tokens for r in got) == sum(len(plain(r.text)) + 1 for r in docs.collect())
    by_start = sorted(got, key=lambda r: r.start)
    assert by_start[0].doc_id is None
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in by_start[1:]]
    assert ids == sorted(ids)
    crc = lambda text: zlib.crc32(np.array([*plain(text), 2], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(r.text) for r in docs.collect())
    assert all(r.ids_crc32 == crc(TEXTS[r.doc_id]) for r in got if r.doc_id not in (None, 3))


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_fills_well(seed):
    rng = np.random.default_rng(seed)
    cap = 512
    sizes = np.minimum(cap, rng.geometric([0.2, 0.01, 0.004, 0.02, 0.5, 0.008][seed], 3000))
    histogram = np.bincount(sizes, minlength=cap + 1)
    patterns = packing.plan(histogram, cap)
    used = np.zeros(cap + 1, np.int64)
    for n, pattern in patterns:
        assert sum(size * k for size, k in pattern.items()) <= cap
        for size, k in pattern.items():
            used[size] += n * k
    assert (used == histogram).all()
    least = -(-int(sizes.sum()) // cap)
    assert sum(n for n, _ in patterns) <= max(least + 1, int((sizes > cap // 2).sum()) + least // 50 + 1)


def test_exact_fill_prefers_one_then_two_then_three():
    free = np.zeros(101, np.int64)
    free[[10, 20, 30]] = 1
    assert packing.exact_fill(free, 30) == (30,)
    assert packing.exact_fill(free, 50) == (30, 20)
    assert packing.exact_fill(free, 60) == (30, 20, 10)
    assert packing.exact_fill(free, 40) == (30, 10)
    assert packing.exact_fill(free, 20) == (20,)
    assert packing.exact_fill(free, 70) is None
    free[10] = 0
    assert packing.exact_fill(free, 40) is None
