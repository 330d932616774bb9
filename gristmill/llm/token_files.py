"""Token ids of all documents in binary files, in ascending order of ``doc_id``, coded by ``range_coder``.

Rows are dealt to tasks by ranges of (``doc_id``, hash of the text), so that an id that many rows share is many tasks;
a task encodes its documents and writes one file, whatever their number.  A task's memory holds a block of ids and a
bounded table of words, besides one text.

File format (integers little-endian): eight bytes ``MAGIC``, the number of ids in the vocabulary (32 bits), then blocks
until the end.  A block is three 32-bit numbers (bytes of its table, bytes of its ids, checksum of the table), the table
of its documents and its ids.  The table, packed by zlib, has for each document ``doc_id`` (64 bits), what of the block
it takes (64 bits) and flags (a byte: 1 id is null, 2 begins here, 4 ends here); a document may go on in the next block.
Blocks are coded, checked and decoded independently.

A task names its file itself, so a retry or a second attempt writes another one; only files that a row of the written
list (``file``, ``part``, ``documents``, ``ids``, ``bytes``) names are ever read.  The list has one row a file.

Defined results: a null text counts as empty; an empty text has only the end id; null ids come first; rows that share an
id come by a hash of their texts, then by text, and repeated rows are rows like any other; further columns are ignored;
an empty table writes no file and reads as no rows.  A damaged or cut file is an error.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import range_coder
from gristmill.llm.bpe_codec import Words, _splitter, _tokenizer
from gristmill.llm.common import slices, texts_of, tidy
from gristmill.session import local_frame, scratch_root, stage

MAGIC = b"IDBLOCK1"
END_ID = 2
# A task holds the ids of twice as many words, about 200 bytes each.
HELD_WORDS = 500_000
NULL, BEGINS, ENDS = 1, 2, 4

_HEAD, _SIZES = struct.Struct("<8sI"), struct.Struct("<III")
_FILES = "file string, part int, documents long, ids long, bytes long"


def open_store(folder: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


@lru_cache(1)
def _words(path: str) -> Words:
    return Words(path, HELD_WORDS)


@lru_cache(2)
def vocabulary_size(path: str, end_id: int) -> int:
    return max(end_id, *_tokenizer(path).get_vocab().values()) + 1


class Writer:
    """Cuts a stream of documents into blocks and writes them."""

    def __init__(self, out, vocabulary: int):
        self.out, self.vocabulary = out, vocabulary
        self.held, self.table, self.size = [], [], 0
        self.documents = self.ids = 0
        self.bytes = out.write(_HEAD.pack(MAGIC, vocabulary))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        kind = (NULL if doc_id is None else 0) | BEGINS
        self.documents += 1
        self.ids += len(ids)
        at = 0
        while True:
            part = ids[at : at + range_coder.BLOCK - self.size]
            at += len(part)
            self.held.append(part)
            self.table.append((doc_id or 0, len(part), kind | (ENDS if at == len(ids) else 0)))
            self.size += len(part)
            kind &= NULL
            if self.size == range_coder.BLOCK:
                self.flush()
            if at == len(ids):
                return

    def flush(self) -> None:
        if self.table:
            names, sizes, kinds = zip(*self.table)
            table = zlib.compress(np.array(names, "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + bytes(kinds))
            coded = range_coder.encode(np.concatenate(self.held), self.vocabulary)
            for data in (_SIZES.pack(len(table), len(coded), zlib.crc32(table)), table, coded):
                self.bytes += self.out.write(data)
        self.held, self.table, self.size = [], [], 0


def blocks(data) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """``doc_id``s, sizes, flags and ids of every block of an open file."""

    def take(size: int) -> bytes:
        got = data.read(size)
        if len(got) < size:
            raise ValueError("damaged file: it ends inside a block")
        return got

    magic, vocabulary = _HEAD.unpack(take(_HEAD.size))
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    while head := data.read(_SIZES.size):
        if len(head) < _SIZES.size:
            raise ValueError("damaged file: it ends inside a block")
        table_size, coded_size, check = _SIZES.unpack(head)
        table = take(table_size)
        if zlib.crc32(table) != check:
            raise ValueError("damaged block: its table doesn't match its checksum")
        table = zlib.decompress(table)
        n = len(table) // 17
        yield np.frombuffer(table, "<i8", n), np.frombuffer(table, "<i8", n, 8 * n), table[16 * n :], range_coder.decode(take(coded_size), vocabulary)


def write(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all documents' ids, each followed by ``end_id``; the list of files, in the order of the documents."""
    spark = docs.sparkSession
    folder = (folder or f"{scratch_root(spark)}/gristmill/ids-{uuid.uuid4().hex}").rstrip("/")
    docs = texts_of(docs).withColumn("code", F.xxhash64("text"))
    docs = docs.repartitionByRange("doc_id", "code").sortWithinPartitions("doc_id", "code", "text").select("doc_id", "text")

    @tidy
    def run(batches):
        split, known, size = _splitter(path), _words(path), vocabulary_size(path, end_id)
        end = np.array([end_id], "<u4")
        out = writer = None
        try:
            for batch in batches:
                for piece in slices(batch):
                    if writer is None and piece.num_rows:
                        store, root = open_store(folder)
                        store.create_dir(root, recursive=True)
                        part = TaskContext.get().partitionId()
                        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                        out = store.open_output_stream(f"{root}/{name}")
                        writer = Writer(out, size)
                    for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                        writer.add(doc_id, np.concatenate([known.of(split(text)), end]))
            if writer:
                writer.flush()
        finally:
            if out:
                out.close()
        if writer:
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "part": part, "documents": writer.documents, "ids": writer.ids, "bytes": writer.bytes}], schema=schema)

    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
    return stage(docs.mapInArrow(run, _FILES), "id-files")


def _dealt(files: DataFrame) -> DataFrame:
    """The list with ``start``, the ids in all files before, a file in each task."""
    rows = sorted((r["part"], r["file"], r["ids"]) for r in files.collect())
    starts = np.cumsum([0, *(r[2] for r in rows)]).tolist()
    told = [(name, start, ids) for (_, name, ids), start in zip(rows, starts)]
    return local_frame(files.sparkSession, told, "file string, start long, ids long").coalesce(1).repartition(max(1, len(rows)))


def _documents(file: str, start: int, ids: int):
    """(doc_id, place of the first id, is first part, is last part, ids) of each part of a document in a block."""
    folder, name = file.rsplit("/", 1)
    store, root = open_store(folder)
    at = start
    with store.open_input_stream(f"{root}/{name}") as data:
        for names, sizes, kinds, own in blocks(data):
            used = 0
            for doc_id, n, kind in zip(names.tolist(), sizes.tolist(), kinds):
                yield None if kind & NULL else doc_id, at, kind & BEGINS, kind & ENDS, own[used : used + n]
                at, used = at + n, used + n
        if at != start + ids:
            raise ValueError(f"damaged file: {file} lacks blocks that were written")


def _read(files: DataFrame, schema: str, first, more, last) -> DataFrame:
    """A row ``last(state)`` for each document, where ``first`` and ``more`` take up its parts one after the other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out, held, state = [], 0, None
                for doc_id, at, begins, ends, ids in _documents(row["file"], row["start"], row["ids"]):
                    state = more(first(doc_id, at) if begins else state, ids)
                    if ends:
                        out.append(last(state))
                        held += len(ids)
                    if len(out) >= 10_000 or held >= range_coder.BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return _dealt(files).mapInArrow(run, schema)


def read(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids``, from the files."""

    def more(state, ids):
        state[2].append(ids)
        return state

    return _read(
        files, "doc_id long, start long, ids array<int>",
        lambda doc_id, at: [doc_id, at, []], more, lambda s: (s[0], s[1], np.concatenate(s[2]).astype(np.int32)),
    )


def digests(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian 32-bit numbers), from the files."""

    def more(state, ids):
        return (*state[:2], state[2] + len(ids), zlib.crc32(ids.astype("<u4").tobytes(), state[3]))

    return _read(
        files, "doc_id long, start long, n_tokens long, ids_crc32 long",
        lambda doc_id, at: (doc_id, at, 0, 0), more, lambda s: s,
    )
