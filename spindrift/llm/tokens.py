"""Token ids of whole texts by a public tokenizer file, with a bounded memo of chunks.

Of a vocabulary file that lower-cases and whose pieces never reach across white
space (``_by_chunks`` looks for that in the file) the ids of a text are those of its
space-separated chunks in a row. Words repeat: Arrow finds the distinct chunks of a
batch, a memo bounded in bytes keeps the ids of those seen before, and the tokenizer
is asked for new ones only. Texts of any other file are encoded whole.
``tests/llm/test_tokens.py`` holds this against plain ``encode``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the memo that a worker keeps for good (the chunks met first), and on top until they are used up.
KEPT_BYTES, PASSING_BYTES = 24 << 20, 8 << 20
#: Chunks of more bytes are never kept; bytes that an entry takes besides its chunk and ids.
LONGEST_CHUNK, ENTRY_BYTES = 64, 200
#: Bytes of text handled at a time.
SLICE_BYTES = 2 << 20
_WORD_END = "</w>"
_MARKS = "([a-z])([.,;:!?])( |$)"
_loaded: dict[str, ChunkTokenizer] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_chunks(path: str) -> bool:
    """Whether a file lower-cases, takes any white space as one space and cuts at it, and keeps letters and marks apart."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    steps = (parts.get("normalizer") or {}).get("normalizers", [])
    spaces = [n for n in steps if n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " "]
    cuts = [p for p in (parts.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"]
    pieces = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    apart = bool(cuts) and cuts[0].get("pattern") == {"Regex": pieces} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    model = parts.get("model") or {}
    return bool(spaces) and any(n.get("type") == "Lowercase" for n in steps) and apart and model.get("end_of_word_suffix") == _WORD_END and not model.get("dropout")


class ChunkTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._chunked = _by_chunks(path)
        size = self._tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._ends_word = np.zeros(size, bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._ends_word[i] = token.endswith(_WORD_END)
        self._kept: dict[str, bytes] = {"": b""}
        self._passing: dict[str, bytes] = {}
        self._kept_bytes = self._passing_bytes = 0

    def plain(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: one call, cut apart after the tokens that end a word."""
        out: list[bytes] = []
        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self._ends_word[ids]) + 1).tolist()
            if len(ends) == len(part):
                out += [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]
            else:
                out += map(self.plain, part)
        return out

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        words = [c for c in chunks if c.isalpha()]
        learnt = dict(zip(words, self._words(words)))
        others = [c for c in chunks if c not in learnt]
        for c, coded in zip(others, self._tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            learnt[c] = np.array(coded.ids, self.dtype).tobytes()
        return learnt

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self._kept.get, chunks))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            rest = [k for k in missing if (ids := self._passing.get(chunks[k])) is None or found.__setitem__(k, ids)]
            if rest:
                learnt = self._learn([chunks[k] for k in rest])
                for k in rest:
                    found[k] = learnt[chunks[k]]
                self._remember({c: ids for c, ids in learnt.items() if len(c) <= LONGEST_CHUNK})
        return found

    def _remember(self, learnt: dict[str, bytes]) -> None:
        size = sum(len(c) + len(ids) + ENTRY_BYTES for c, ids in learnt.items())
        if self._kept_bytes + size <= KEPT_BYTES:
            self._kept |= learnt
            self._kept_bytes += size
        elif size <= PASSING_BYTES:
            if self._passing_bytes + size > PASSING_BYTES:
                self._passing, self._passing_bytes = {}, 0
            self._passing |= learnt
            self._passing_bytes += size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin and end."""
        if len(texts) == 0:
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        if not self._chunked:
            ids = [np.frombuffer(self.plain(t), self.dtype) for t in texts.to_pylist()]
            return np.concatenate(ids), np.cumsum([0, *map(len, ids)])
        # A tokenizer piece holds letters or marks, never both, and ASCII letters lose their case anyway.
        text = pc.ascii_lower(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "))  # in this order: ascii_lower needs an unsliced array
        lists = pc.split_pattern(pc.replace_substring_regex(text, _MARKS, r"\1 \2\3"), " ")
        chunks = lists.flatten().dictionary_encode()
        ids = self._lookup(chunks.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(ids), self.dtype)
        starts = np.cumsum(sizes) - sizes
        at = chunks.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        flat = pool[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return flat, np.concatenate([[0], ends])[offsets]


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]


def sliced(batches, column: str = "text", most: int = SLICE_BYTES):
    """Arrow batches cut so that the text of each is about ``most`` bytes, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1) if batch.num_rows else []:
            yield batch.slice(int(part[0]), len(part))


def encoded(batches, path: str):
    """(doc_id, ids) of Arrow batches with columns doc_id and text (no nulls in text), in their order."""
    coder = tokenizer(path)
    for part in sliced(batches):
        flat, at = coder.encode(part.column("text"))
        for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
            yield doc_id, flat[at[k] : at[k + 1]]
