"""Phrase collocations by generalised suffix automata, one for each shard of a language.

A task gathers the texts of a language up to ``SHARD_BYTES`` and builds the suffix
automaton of their pieces, bounded to strings of ``depth`` words. The automaton is
built through its suffix links instead of word by word: the links form the trie of
the reversed strings, and the nodes of a depth are found together by sorting, so the
work is in numpy. Strings that end at the same places (a node and its only extension
to the left, with the same count) are one state. The shard's substrings are read
off the states with their endpos counts, and Spark adds the counts up by phrase.

A phrase that lies inside a longer candidate lies inside one that is longer by a
word and at least as frequent. So subsumption takes, of every candidate, its suffix
link (the phrase without its first word) and the phrase without its last word, and
keeps the greatest count for each: no pairs of a phrase and all its extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import sliced

DEPTH = 3
LEAST = 10
SUBSUMED_PERCENT = 50
TOP = 2000
#: Bytes of text of one automaton; texts held at a time by a task, over all languages.
SHARD_BYTES, HELD_BYTES = 8 << 20, 16 << 20
#: Parts of a language that are ranked apart before the language is, and of a word that joins to many phrases.
PARTS, SALTS = 256, 8
OUT_ROWS = 50_000
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _joined(first: pa.Array | pa.Scalar, second: pa.Array, mark: str) -> pa.Array:
    return pc.binary_join_element_wise(first, second, pa.scalar(mark, pa.large_string()))


class SuffixAutomaton:
    """Suffix automaton of the pieces of a shard, bounded to strings of ``depth`` words.

    ``word[d]``, ``link[d]`` and ``count[d]`` describe the strings of ``d + 1`` words: the code
    of the first word, the string without it (a place in depth ``d - 1``), and the size
    of the endpos set. ``shortest[d]`` is the length of the shortest string of its state.
    """

    def __init__(self, codes: np.ndarray, place: np.ndarray, size: int, depth: int = DEPTH):
        node = codes.astype(np.int64)
        at = np.arange(len(node))
        self.word = [np.arange(size)]
        self.link = [np.full(size, -1)]
        self.count = [np.bincount(node, minlength=size)]
        self.shortest = [np.ones(size, np.int64)]
        for d in range(1, depth):
            inside = place[at] >= d
            at, node = at[inside], node[inside]
            key, node, count = np.unique(node * size + codes[at - d], return_inverse=True, return_counts=True)
            link = key // max(size, 1)
            self.word.append(key % max(size, 1))
            self.link.append(link)
            self.count.append(count)
            self.shortest.append(np.where(count == self.count[-2][link], self.shortest[-1][link], d + 1))

    def states(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each length, the strings that are the longest of their state."""
        for d, shortest in enumerate(self.shortest):
            longest = np.ones(len(shortest), bool)
            if d + 1 < len(self.shortest):
                longest[self.link[d + 1][self.shortest[d + 1] <= d + 1]] = False
            yield d + 1, np.flatnonzero(longest)

    def phrases(self, words: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(strings, endpos counts) of all lengths, written with the words that the codes stand for."""
        text = words
        yield text, self.count[0]
        for d in range(1, len(self.word)):
            text = _joined(words.take(pa.array(self.word[d])), text.take(pa.array(self.link[d])), " ")
            yield text, self.count[d]

    def lefts(self, words: pa.Array, d: int) -> pa.Array:
        """For each string of ``d + 1`` words, as one text, its count and the words that its extensions to the left begin with.

        ``:12 the of:3``: the string occurs 12 times, once after "the" and three times after "of"; no word holds a colon.
        """
        count = self.count[d + 1]
        number = _joined(pa.scalar(":", pa.large_string()), pa.array(count).cast(pa.large_string()), "")
        items = _joined(words.take(pa.array(self.word[d + 1])), pc.if_else(pa.array(count > 1), number, pa.scalar("", pa.large_string())), "")
        own = _joined(pa.scalar(":", pa.large_string()), pa.array(self.count[d]).cast(pa.large_string()), "")
        ends = np.searchsorted(self.link[d + 1], np.arange(len(own) + 1))  # links are sorted, as the strings were found by sorting
        after = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), items), pa.scalar(" ", pa.large_string()))
        return pc.if_else(pa.array(np.diff(ends) > 0), _joined(own, after, " "), own)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, its place in its piece) of the texts in a row, A-Z lower-cased."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.int64)
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    kind = _KIND[raw]
    inside = kind == _WORD
    first = np.ones(len(raw), bool)
    first[1:] = ~inside[:-1]
    heads = edges[:-1] - edges[0]
    heads = heads[heads < len(raw)]
    first[heads] = True
    breaks = kind == _BREAK
    starts = np.flatnonzero(inside & first)
    # A piece ends at a mark or at the end of a text; the number of either before a word tells pieces apart.
    new_text = np.zeros(len(raw), np.int64)
    np.add.at(new_text, heads, 1)
    piece = (np.cumsum(breaks) + np.cumsum(new_text))[starts]
    kept = _LOWER[raw[inside]]
    at = np.append((np.cumsum(inside) - 1)[starts], len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)]).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    order = np.arange(len(starts))
    head = np.ones(len(starts), bool)
    head[1:] = piece[1:] != piece[:-1]
    return words.dictionary, codes, order - np.maximum.accumulate(np.where(head, order, 0))


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, n) of all strings of one to ``depth`` words that occur ``least`` times; the empty phrase counts all words.

    The longest strings travel with their suffix link, as its extensions to the left, and
    are added up only where the suffix link itself occurs ``least`` times.
    """

    def count(lang: str, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        words, codes, place = words_of(pa.concat_arrays(texts))
        if len(codes) == 0:
            return
        shard = SuffixAutomaton(codes, place, len(words), depth)
        head = pa.scalar(lang + "\t", pa.large_string())
        yield pa.record_batch([pa.array([lang + "\t"]), pa.array([len(codes)], pa.int64()), pa.array([f":{len(codes)}"])], names=["key", "n", "lefts"])
        for d, (text, n) in enumerate(shard.phrases(words)):
            if d == depth - 1:
                break
            lefts = shard.lefts(words, d) if d == depth - 2 else _joined(pa.scalar(":", pa.large_string()), pa.array(n).cast(pa.large_string()), "")
            for k in range(0, len(n), OUT_ROWS):
                part = slice(k, k + OUT_ROWS)
                keys = _joined(head, text[part], "").cast(pa.string())
                yield pa.record_batch([keys, pa.array(n[part].astype(np.int64)), lefts[part].cast(pa.string())], names=["key", "n", "lefts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        for b in sliced(batches):
            lang = b.column("lang")
            for one in lang.unique().to_pylist():
                texts = b.column("text").filter(pc.equal(lang, one))
                held.setdefault(one, []).append(texts)
                size[one] = size.get(one, 0) + pc.sum(pc.binary_length(texts)).as_py()
            while size and (max(size.values()) > shard_bytes or sum(size.values()) > HELD_BYTES):
                full = max(size, key=size.__getitem__)
                size.pop(full)
                yield from count(full, held.pop(full))
        for one, texts in held.items():
            yield from count(one, texts)

    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = text.mapInArrow(run, "key string, n long, lefts string")
    # A key has one row for each shard at most, and what follows needs no other partitioning.
    often = counted.repartition("key").withColumn("f", F.sum("n").over(Window.partitionBy("key")))
    often = often.where((F.col("f") >= least) | F.col("key").endswith("\t"))
    item = F.explode(F.split("lefts", " ")).alias("item")
    left, n = F.substring_index("item", ":", 1), F.when(F.col("item").contains(":"), F.substring_index("item", ":", -1).cast("long")).otherwise(1)
    whole = often.select("key", item).select("key", left.alias("left"), n.alias("n")).groupBy("key", "left").agg(F.sum("n").alias("n"))
    whole = whole.where((F.col("n") >= least) | F.col("key").endswith("\t"))
    cut = F.length("key") - F.locate("\t", F.reverse("key"))
    suffix = F.substring_index("key", "\t", -1)
    return whole.select(F.substring("key", 1, cut).alias("lang"), F.when(F.col("left") == "", suffix).otherwise(F.concat_ws(" ", "left", suffix)).alias("phrase"), "n")


def _salted(phrases: DataFrame, parts: DataFrame, by: str, name: str) -> DataFrame:
    """``phrases`` with the count of the part in column ``by`` as ``name``; a part of very many phrases is spread."""
    copies = parts.select("lang", F.col("phrase").alias(by), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return phrases.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS))).join(copies, ["lang", by, "salt"]).drop("salt")


def _words(words: Column, first: int | Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, subsumed_percent: int = SUBSUMED_PERCENT, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The best-scored phrases of two to ``depth`` words of every language.

    ``docs`` needs ``lang`` and ``text``; other columns are ignored. A null language is
    ``und``, a null text empty. Texts are cut into pieces at ``. , ; : ! ?`` and line
    ends, pieces into words at spaces and tabs, A-Z lower-cased; phrases never cross
    pieces. Repeated rows count again. Candidates occur ``least`` times; the score is
    floor(10^6 a^2 / (l r)) of the worst cut into two phrases that occur l and r times
    (ties: the shortest first part). Candidates inside a longer one with
    ``subsumed_percent`` of their count are dropped. Result: lang, rank, phrase, a, l,
    r, n, score by score, count and phrase (UTF-8 bytes); ``n`` counts the language's
    words. Products are decimals of 38 digits. A shard holds ``shard_bytes`` of text or
    one longer text. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, depth, least, shard_bytes)
    counts = scratch.stage(counts.withColumn("size", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))), "frequent")
    totals = counts.where("size = 0").select("lang", F.col("n").alias("all"))
    found = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    parts = counts.where(F.col("size").between(1, depth - 1))

    shorter = F.explode(F.array(_words("words", 2, F.col("size") - 1), _words("words", 1, F.col("size") - 1)))
    inside = found.where("size > 2").select("lang", shorter.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = found.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed_percent * F.col("a")))

    k = F.col("k")
    cuts = found.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("words", F.lit(1), k).alias("head"), _words("words", k + 1, F.col("size") - k).alias("tail"))
    cuts = _salted(_salted(cuts, parts, "head", "l"), parts, "tail", "r")
    score = F.expr("(cast(1000000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(19,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    worst = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.hash("phrase"), F.lit(PARTS))
    near = worst.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score")


#: The same for DuckDB, over ``documents``.
COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
inside AS (SELECT lang, unnest([array_to_string(w[2:3], ' '), array_to_string(w[1:2], ' ')]) AS phrase, a FROM c WHERE size = 3),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 50 * c.a)),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
        FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, cut.k, h.a AS l, t.a AS r, ((1000000::HUGEINT * cut.a * cut.a) // (h.a::HUGEINT * t.a))::BIGINT AS score
           FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = cut.head JOIN f t ON t.lang = cut.lang AND t.phrase = cut.tail),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang)
"""
