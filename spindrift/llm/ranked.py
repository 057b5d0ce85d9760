"""Ranked lexical search with block-max pruning over a forward index of document ranges.

The index is a table of the shared folder with one row a block: a run of documents in
storage order, of at most ``BLOCK_DOCS`` documents and ``BLOCK_POSTINGS`` postings (or one
larger document). A block holds its terms with the per-term maxima (the greatest
count of a document, the least length of one that has the term, how many have it) and the
forward index (for each document the places of its terms in that list and their
counts). The maxima bound a score from above whatever the statistics of the whole table are, so the
index is written in one pass, and searching reads the columns that it needs.

A search takes the blocks of each query by falling bound and scores them in waves, each
longer than the one before; after a wave all blocks whose bound is below the query's
threshold (its worst of ``top`` scores so far) are left out, and the search ends when none is
left. The last wave takes all blocks that pass. Equal bounds stay in, as equal scores are ranked by id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, documents
from .tokens import sliced

TOP = 10
BLOCK_DOCS, BLOCK_POSTINGS = 64, 1 << 17
#: Blocks that a task unpacks at a time when it reads the index: some 60 bytes a posting, so 63 MB in full blocks.
READ_BLOCKS = 8
#: Queries searched at a time, and bytes of their text: what the driver and each worker hold of them.
QUERIES, QUERY_BYTES = 1024, 4 << 20
#: Blocks of each query that are scored before the threshold is raised; then all that pass it.
WAVES = (8, 64, 512)
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

INDEX = """block long, doc_ids array<long>, lengths array<long>, terms array<binary>, max_tf array<long>, min_length array<long>, df array<long>,
    sizes array<int>, places array<int>, tfs array<int>"""
_INDEX_TYPES = [pa.int64(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.int32())] * 3]
_INDEX_NAMES = ["block", "doc_ids", "lengths", "terms", "max_tf", "min_length", "df", "sizes", "places", "tfs"]


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TO_TERMS).split()


def block_row(number: int, ids: list, counted: list[Counter]) -> tuple:
    """The index row of documents given by their term counts."""
    place: dict[bytes, int] = {}
    places = np.fromiter((place.setdefault(t, len(place)) for c in counted for t in c), np.int64)
    tfs = np.fromiter((n for c in counted for n in c.values()), np.int64, len(places))
    sizes = np.array([len(c) for c in counted], np.int64)
    lengths = np.array([c.total() for c in counted], np.int64)
    max_tf = np.zeros(len(place), np.int64)
    np.maximum.at(max_tf, places, tfs)
    least = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(least, places, np.repeat(lengths, sizes))
    return number, ids, lengths, list(place), max_tf, least, np.bincount(places, minlength=len(place)), sizes.astype(np.int32), places.astype(np.int32), tfs.astype(np.int32)


def index_documents(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The blocks of all documents that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list = []
        counted: list[Counter] = []
        postings = 0
        for b in sliced(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                counts = Counter(terms_of(text))
                if not counts:
                    continue
                if ids and (len(ids) >= block_docs or postings + len(counts) > block_postings):
                    yield _batch([block_row(number, ids, counted)], _INDEX_TYPES, _INDEX_NAMES)
                    number, ids, counted, postings = number + 1, [], [], 0
                ids.append(doc_id)
                counted.append(counts)
                postings += len(counts)
        if ids:
            yield _batch([block_row(number, ids, counted)], _INDEX_TYPES, _INDEX_NAMES)

    return documents(docs).mapInArrow(run, INDEX)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated counts: (10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 length N) div L, exact."""
    if len(length) and 75 * int(length.max()) * n_docs >= 1 << 63:
        m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in length], np.int64)
    else:
        m = 25 + 75 * length * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Queries:
    """A bounded block of queries: ``terms`` and, for each term, the queries that have it and how often."""

    def __init__(self, texts: list[bytes]):
        asked = [Counter(terms_of(t)) for t in texts]
        self.size = len(texts)
        self.terms = sorted({t for c in asked for t in c})
        at = {t: k for k, t in enumerate(self.terms)}
        rows = sorted((at[t], q, n) for q, c in enumerate(asked) for t, n in c.items())
        self.term, self.query, self.often = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
        self.first = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def places(self, terms: pa.Array) -> np.ndarray:
        """The number of each term among those asked for, -1 for others."""
        found = pc.index_in(terms, value_set=pa.array(self.terms, terms.type))
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def bounds(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each query the sum of weight times value over its terms among ``term``."""
        out = np.zeros(self.size, np.int64)
        n = self.first[term + 1] - self.first[term]
        rows = np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(out, self.query[rows], np.repeat(self.weight[term] * value, n) * self.often[rows])
        return out

    def factors(self, query: int) -> np.ndarray:
        """Weight times repeats of every term in one query."""
        out = np.zeros(len(self.terms), np.int64)
        own = self.query == query
        out[self.term[own]] = self.weight[self.term[own]] * self.often[own]
        return out


def _values(column: pa.Array, k: int) -> pa.Array:
    return column[k].values


def _numbers(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _statistics(index: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each term asked for): one row a term and task at most, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.terms) + 2, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                lengths = _numbers(b.column("lengths"), k)
                df[-2:] += (len(lengths), int(lengths.sum()))
                term = queries.places(_values(b.column("terms"), k))
                df[term[term >= 0]] += _numbers(b.column("df"), k)[term >= 0]
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], names=["term", "n"])

    rows = index.select("lengths", "terms", "df").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(queries.terms) + 2, np.int64)
    for r in rows:
        df[r.term] = r.n
    return int(df[-2]), int(df[-1]), df[:-2]


def _bounds(index: DataFrame, queries: Queries, n_docs: int, n_terms: int) -> DataFrame:
    """(query, block, bound) with a bound above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                term = queries.places(_values(b.column("terms"), k))
                own = term >= 0
                most = impacts(_numbers(b.column("max_tf"), k)[own], _numbers(b.column("min_length"), k)[own], n_docs, n_terms)
                bound = queries.bounds(term[own], most)
                at = np.flatnonzero(bound)
                block = np.full(len(at), b.column("block")[k].as_py())
                yield pa.record_batch([pa.array(at), pa.array(block), pa.array(bound[at])], names=["query", "block", "bound"])

    return index.select("block", "terms", "max_tf", "min_length").mapInArrow(run, "query long, block long, bound long")


def _scores(blocks: DataFrame, queries: Queries, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(query, doc_id, score): the best ``top`` of each block for each query in its list ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                term = queries.places(_values(b.column("terms"), k))
                asked = term[_numbers(b.column("places"), k)]
                lengths, sizes = _numbers(b.column("lengths"), k), _numbers(b.column("sizes"), k)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                own = asked >= 0
                asked, doc = asked[own], doc[own]
                impact = impacts(_numbers(b.column("tfs"), k)[own].astype(np.int64), lengths[doc], n_docs, n_terms)
                ids = b.column("doc_ids")[k].as_py()
                out: list[tuple] = []
                for q in b.column("wanted")[k].as_py():
                    score = np.zeros(len(sizes), np.int64)
                    np.add.at(score, doc, queries.factors(q)[asked] * impact)
                    found = sorted(((-int(score[d]), ids[d] is None, ids[d] or 0) for d in np.flatnonzero(score)))[:top]
                    out += [(q, None if null else i, -s) for s, null, i in found]
                if out:
                    yield _batch(out, [pa.int64()] * 3, ["query", "doc_id", "score"])

    columns = ["lengths", "doc_ids", "terms", "sizes", "places", "tfs", "wanted"]
    return blocks.select(*columns).mapInArrow(run, "query long, doc_id long, score long")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _search(scratch: Scratch, index: DataFrame, queries: Queries, top: int) -> DataFrame | None:
    """(query, rank, doc_id, score) of a block of queries."""
    n_docs, n_terms, df = _statistics(index, queries)
    if n_docs == 0 or not queries.terms:
        return None
    queries.weigh(df, n_docs)
    open_ = scratch.stage(_bounds(index, queries, n_docs, n_terms), "bounds")
    best: DataFrame | None = None
    for wave in (*WAVES, None):
        chosen, rest = open_, None
        if wave is not None:
            order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
            ranked = open_.withColumn("at", F.row_number().over(order)).where(F.col("at") <= wave).drop("at")
            chosen = scratch.stage(ranked, "chosen")
            cut = F.broadcast(chosen.groupBy("query").agg(F.min(F.struct("bound", (-F.col("block")).alias("block"))).alias("cut")))  # a row a query of the block
            rest = open_.join(cut, "query").where(F.struct("bound", (-F.col("block")).alias("block")) < F.col("cut")).select("query", "block", "bound")
        wanted = chosen.groupBy("block").agg(F.collect_list("query").alias("wanted"))  # a row's list is no longer than a block of queries
        if wave is not None:
            wanted = F.broadcast(wanted)  # at most ``wave`` blocks for each of QUERIES queries
        scored = _scores(index.join(wanted, "block"), queries, n_docs, n_terms, top)
        last, before = best, open_
        best = scratch.stage(_ranked(scored if last is None else scored.unionByName(last.drop("rank")), top), "best")
        if rest is not None:
            floor = F.broadcast(best.where(F.col("rank") == top).select("query", F.col("score").alias("floor")))  # a row a query of the block
            open_ = scratch.stage(rest.join(floor, "query", "left").where("floor is null or bound >= floor").select("query", "block", "bound"), "open")
            scratch.drop(chosen)
        scratch.drop(before, *([last] if last is not None else []))
        if rest is None or open_.isEmpty():
            break
    return best


def _query_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Rows (item_id, text) in bounded blocks."""
    held: list[tuple] = []
    size = 0
    for r in items.toLocalIterator():
        if held and (len(held) >= QUERIES or size + len(r.text) > QUERY_BYTES):
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


RESULT = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``; other columns are
    ignored. Terms are runs of letters, digits and characters above 127 in the whole
    text, A-Z lower-cased; a null text has none. Documents without terms are not counted,
    items without terms or hits have no rows. Scores are 64-bit integers; equal
    ones are ranked by ascending id, a null id after all others. Rows repeated under one id
    are documents (or items) of their own. An empty table gives no rows. Items are
    searched ``QUERIES`` at a time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    index = scratch.stage(index_documents(docs, block_docs, block_postings), "index", READ_BLOCKS)
    parts = []
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for block in _query_blocks(items):
        found = _search(scratch, index, Queries([text.encode() for _, text in block]), top)
        if found is not None:
            names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], "query long, item_id long")
            parts.append(found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    out = spark.createDataFrame([], RESULT)
    for p in parts:
        out = out.unionByName(p)
    return out


#: The same for DuckDB, over ``documents`` and ``benchmark``.
SEARCH_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
s AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT N FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
m AS (SELECT d, 100 - 75 + ((75 * n * (SELECT N FROM s)) // (SELECT L FROM s)) AS m FROM n),
i AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM tf JOIN m USING (d) JOIN w USING (term)),
sc AS (SELECT q, item_id, d, doc_id, sum(part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM sc QUALIFY rank <= 10
"""
