"""Exact duplicates by compressed radix tries that own their texts.

A task inserts its texts into tries (one for each length, so that no text is a prefix
of another) and gives out one row for each different text with the ids that it met: a
text that fills a third of the table leaves each task as one row. These rows are dealt
out by length and content hash, and the owners' tries take the full bytes; a terminal
node keeps the id that stays, the number of rows and the numbers of the rows that
reached it. Only those numbers travel back, to where the ids were left.

Tries that hold more than their bound in bytes give up their largest subtrees. Before the
shuffle a subtree's texts just leave as rows. An owner marks the place, and all
texts of the subtree, those that come later too, are dealt out again over twice as
many owners: a text is decided in one round or wholly in a later one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, documents, partitions
from .tokens import sliced

#: Bytes of text that the tries of a task hold; ids gathered in one row; what a node takes besides its bytes.
TRIE_BYTES, MOST_IDS, NODE_BYTES = 32 << 20, 1 << 16, 300
#: Bytes of text in an Arrow batch of results, and its rows.
OUT_BYTES, OUT_ROWS = 4 << 20, 20_000


class Node:
    """``label``: the bytes on the edge to this node; ``found``: what a text that ends here has; ``gone``: given up."""

    __slots__ = ("label", "children", "found", "gone")

    def __init__(self, label: bytes, found: list | None = None):
        self.label = label
        self.children: dict[int, Node] = {}
        self.found = found
        self.gone = False


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving (comparisons of slices run at the speed of memory)."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTries:
    """A radix trie for each length, under one node. ``size`` is the number of bytes held, nodes included."""

    def __init__(self) -> None:
        self.top = Node(b"")
        self.size = 0
        self.texts = 0

    def place(self, text: bytes) -> list | None:
        """The list kept at the text's terminal node, new and empty at first; None where the subtree was given up."""
        node = self.top.children.get(len(text))
        if node is None:
            node = self.top.children[len(text)] = Node(b"")
            self.size += NODE_BYTES
        at = 0
        while True:
            if node.gone:
                return None
            if at == len(text):
                if node.found is None:  # the empty text ends at the root of its length
                    node.found = []
                    self.texts += 1
                return node.found
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = leaf = Node(text[at:], [])
                self.size += len(text) - at + NODE_BYTES
                self.texts += 1
                return leaf.found
            if not text.startswith(child.label, at):
                k = _shared(child.label, text[at : at + len(child.label)])
                fork = Node(child.label[:k])
                child.label = child.label[k:]
                fork.children[child.label[0]] = child
                node.children[text[at]] = child = fork
                self.size += NODE_BYTES
            at += len(child.label)
            node = child

    @staticmethod
    def _walk(top: Node, before: bytes) -> Iterator[tuple[bytes, Node]]:
        """(bytes up to and with the node's label, node) of a subtree, without recursion."""
        open_ = [(before + top.label, top)]
        while open_:
            path, node = open_.pop()
            yield path, node
            open_ += [(path + c.label, c) for c in node.children.values()]

    def everything(self) -> Iterator[tuple[bytes, list]]:
        return ((path, node.found) for path, node in self._walk(self.top, b"") if node.found is not None)

    @staticmethod
    def _bytes(top: Node) -> int:
        open_, size = [top], 0
        while open_:
            node = open_.pop()
            size += len(node.label) + NODE_BYTES
            open_ += node.children.values()
        return size

    def give_up(self, to: int, mark: bool) -> Iterator[tuple[bytes, list]]:
        """Take the largest subtrees out until ``to`` bytes or one text are left; ``mark`` closes their places."""
        node, before = self.top, b""
        while True:
            sizes = sorted(((self._bytes(c), key) for key, c in node.children.items() if not c.gone), reverse=True)
            for size, key in sizes:
                if self.size <= to or self.texts <= 1:
                    return
                child = node.children[key]
                if size > self.size - to and any(not c.gone for c in child.children.values()):
                    node, before = child, before + child.label  # a part of it is enough
                    break
                out = [(path, x.found) for path, x in self._walk(child, before) if x.found is not None]
                self.texts -= len(out)
                self.size -= size
                if mark:
                    self.size += len(child.label) + NODE_BYTES
                    child.children, child.found, child.gone = {}, None, True
                else:
                    del node.children[key]
                yield from out
            else:
                return


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], text: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, bounded by the bytes in column ``text``."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[text] or b"")
        if size > OUT_BYTES or len(held) >= OUT_ROWS:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _best(keep: str, ids: list) -> int | None:
    """The id that stays of a list; null only if there is no other."""
    known = [i for i in ids if i is not None]
    return (max(known) if keep == "largest" else min(known)) if known else None


def local_texts(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each different text of a task: its number ``row``, bytes, hash, best id and ids."""
    names = ["row", "body", "sha256", "best", "ids"]
    types = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33

        def rows() -> Iterator[tuple]:
            tries, n, gathered = RadixTries(), first, 0

            def row(body: bytes, ids: list) -> tuple:
                nonlocal n
                n += 1
                return n, body, hashlib.sha256(body).hexdigest(), _best(keep, ids), list(ids)

            for b in sliced(batches):
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                    ids = tries.place(text)
                    ids.append(doc_id)
                    gathered += 1
                    if len(ids) >= MOST_IDS:
                        yield row(text, ids)
                        gathered -= len(ids)
                        ids.clear()
                    if tries.size + 8 * gathered > trie_bytes:
                        for body, ids in tries.give_up(trie_bytes // 2, mark=False):
                            gathered -= len(ids)
                            if ids:
                                yield row(body, ids)
            for body, ids in tries.everything():
                if ids:
                    yield row(body, ids)

        yield from _batches(rows(), names, types, 1)

    return documents(docs).mapInArrow(run, "row long, body binary, sha256 string, best long, ids array<long>")


OWNED = "row long, keep_id long, group_size long, owner boolean, body binary, sha256 string, best long, n long"


def owned(rows: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """For each row its owner's verdict, or (with ``body``) the row itself where its subtree was given up.

    ``rows`` are dealt out by length and hash; of equal best ids the row of the least number owns the text.
    """
    names = [x.split()[0] for x in OWNED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def again(body: bytes, sha256: str, r: tuple) -> tuple:
            return r[0], None, None, None, body, sha256, r[1], r[2]

        def rows() -> Iterator[tuple]:
            tries = RadixTries()
            for b in sliced(batches, "body"):
                for number, body, sha256, best, n in zip(*(b.column(c).to_pylist() for c in ("row", "body", "sha256", "best", "n"))):
                    found = tries.place(body)
                    if found is None:
                        yield again(body, sha256, (number, best, n))
                        continue
                    found.append((number, best, n))
                    if tries.size > trie_bytes:
                        for path, given in tries.give_up(trie_bytes // 2, mark=True):
                            sha = hashlib.sha256(path).hexdigest()
                            yield from (again(path, sha, r) for r in given)
            for _, found in tries.everything():
                stays = _best(keep, [r[1] for r in found])
                owner = min(r[0] for r in found if r[1] == stays)
                size = sum(r[2] for r in found)
                yield from ((r[0], stays, size, r[0] == owner, None, None, None, None) for r in found)

        yield from _batches(rows(), names, types, 4)

    return rows.select("row", "body", "sha256", "best", "n").mapInArrow(run, OWNED)


def exact_duplicates(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Texts are equal
    when their UTF-8 bytes are (null: empty). ``keep`` says whether the row with the
    largest or the smallest id of a group stays; a null id stays only where the group
    has no other, and of rows repeated under the id that stays one is kept. An empty
    table gives no rows. A trie never gives up its only text, so a task holds
    ``trie_bytes`` or one longer text.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    texts = scratch.stage(local_texts(docs, keep, trie_bytes), "texts")
    rest = texts.select("row", "body", "sha256", "best", F.size("ids").cast("long").alias("n"))
    parts, owners = [], partitions(spark)
    while True:
        verdicts = scratch.stage(owned(rest.repartition(owners, F.length("body"), "sha256"), keep, trie_bytes), "owned")
        parts.append(verdicts.where("owner is not null").select("row", "keep_id", "group_size", "owner"))
        rest, owners = verdicts.where("owner is null"), 2 * owners
        if rest.isEmpty():
            break
    decided = parts[0]
    for p in parts[1:]:
        decided = decided.unionByName(p)
    # Rows hold a bounded number of ids, whatever the size of their group.
    order = F.sort_array("ids", asc=False) if keep == "largest" else F.array_sort("ids")
    by_row = texts.select("row", F.col("sha256").alias("text_sha256"), order.alias("ids")).join(decided, "row")
    return by_row.select(F.posexplode("ids").alias("at", "doc_id"), "keep_id", "group_size", (F.col("owner") & (F.col("at") == 0)).alias("kept"), "text_sha256").drop("at")


#: The same for DuckDB, over ``documents``.
EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t
"""
