"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id; a task writes one ``.bin`` file of ids
(16 bits wide where the vocabulary allows, else 32) and one ``.idx`` file of
64-bit offsets and document ids. A manifest has a row for each file; the base
of a partition is the prefix sum of the tokens of those before it. Files carry
the attempt in their name and only those in the manifest count, so a task that
is run again leaves at most an orphan.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch, documents, partitions

END_ID = 2
NULL_ID = np.iinfo(np.int64).min  # stands for a null doc_id in an index file
MANIFEST = "part int, file string, width int, n_docs long, n_tokens long, first_doc long, last_doc long"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, n: int | None = None) -> DataFrame:
    """Write the files; the result is the manifest (evaluate it once, e.g. stage it)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        name = f"{part:06d}-{uuid.uuid4().hex[:8]}"
        offsets, ids_of = [0], []
        out, width = None, tokens.tokenizer(vocabulary).dtype.itemsize
        for doc_id, ids in tokens.encoded(batches, vocabulary):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.bin")
            out.write(np.append(ids, ids.dtype.type(end_id)).tobytes())
            offsets.append(offsets[-1] + len(ids) + 1)
            ids_of.append(NULL_ID if doc_id is None else doc_id)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(np.array(offsets, "<i8").tobytes())
            index.write(np.array(ids_of, "<i8").tobytes())
        row = [part, name, width, len(ids_of), offsets[-1], ids_of[0], ids_of[-1]]
        types = [pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    ordered = documents(docs).withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n or partitions(docs.sparkSession), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return ordered.select("doc_id", "text").mapInArrow(write, MANIFEST)


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest (a row for each file) with the tokens before each file."""
    return manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


class TokenFile:
    """One memory-mapped pair of files (read whole where the store cannot map)."""

    def __init__(self, folder: str, name: str, width: int, n_docs: int):
        store, root = pafs.FileSystem.from_uri(folder)
        if isinstance(store, pafs.LocalFileSystem):
            self.ids = np.memmap(f"{root}/{name}.bin", f"<u{width}", "r")
            index = np.memmap(f"{root}/{name}.idx", "<i8", "r")
        else:
            with store.open_input_file(f"{root}/{name}.bin") as f:
                self.ids = np.frombuffer(f.read(), f"<u{width}")
            with store.open_input_file(f"{root}/{name}.idx") as f:
                index = np.frombuffer(f.read(), "<i8")
        self.offsets, self.doc_ids = index[: n_docs + 1], index[n_docs + 1 :]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k] : self.offsets[k + 1]]


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                f = TokenFile(folder, r["file"], r["width"], r["n_docs"])
                crc = [zlib.crc32(f[k].astype("<u4").tobytes()) for k in range(len(f))]
                ids = np.asarray(f.doc_ids)
                yield pa.record_batch(
                    [pa.array(ids, mask=ids == NULL_ID), pa.array(r["base"] + f.offsets[:-1]), pa.array(np.diff(f.offsets)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = partitions(manifest.sparkSession)
    return manifest.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents as token files in ascending ``doc_id`` order and read them back.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text
    is the end id alone. Null ids come first; rows of one id follow each other in
    the order of a hash of their texts. An empty table gives no file and no rows.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = scratch.path("files")
    manifest = scratch.stage(write_tokens(docs, folder, vocabulary or tokens.default_vocabulary(), end_id), "manifest")
    return read_tokens(with_bases(manifest), folder)
