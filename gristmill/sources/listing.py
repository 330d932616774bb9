"""Folder listing: file metadata only, no content.

A folder of this machine's file system (or of one that is mounted alike on all machines, which ``file:`` asks for anyway)
may hold any number of small files: they are listed into a staged table, and tasks open the files whose names they are
given.  What the driver knows of them is their number and size.  Spark's own readers, whose index holds every file on the
driver, read files that they may split, and files of other file systems.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_frame, scratch_root

# Bytes read from the head of a file to tell what it is.
HEAD_BYTES = 1 << 16
# A path of its own costs a file several calls on the driver and a row of a listing job, so more files than these are
# found by one listing of their folder.  Lines of others of their ending that lie there are dropped: by name where these
# are up to LEFT_OUT, by a join with their names where they are more, unless they are bigger than what is asked for.
NAMED = 256
LEFT_OUT = 1000
# A file up to this size, and up to the least that Spark makes a split, is a small one.  Opening a file costs as much as
# reading some bytes more; a task has files of about this cost or of a split's, or fewer where there are not that many.
SMALL_BYTES = 4 << 20
OPEN_BYTES = 64 << 10
TASK_BYTES = 64 << 20
# Files that are listed at a time.
LISTED = 50_000
ENDINGS = ("csv", "pdf", "eml", "txt")
_LISTING = "source_file string, size_bytes bigint, ending string, place bigint"


@dataclass(frozen=True)
class Folder:
    """A folder without folders inside: its place, and the sizes of its files by name."""

    uri: str
    sizes: dict[str, int]


@dataclass(frozen=True)
class SourceFile:
    name: str
    uri: str
    size: int
    folder: Folder | None = field(default=None, repr=False, compare=False)


@dataclass(frozen=True)
class Listing:
    """Files of a folder: ``source_file``, ``size_bytes``, ``ending`` (empty: none of ``ENDINGS``) and ``place`` of each.

    ``place`` is where a small file's bytes begin among those of its ending, all laid end to end; ``small`` has their
    number and their bytes, by ending.  It is null for files that have no bytes, whose names Spark refuses, and that
    Spark reads: these are ``named``.
    """

    table: DataFrame
    counts: dict[str, int]  # files by ending
    named: list[SourceFile]
    path: str = ""  # of the small files
    small: dict[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of_files(cls, spark: SparkSession, files: Sequence[SourceFile]) -> Listing:
        """Files that Spark reads, all of them."""
        rows = [(f.name, f.size, ending_of(f.name), None) for f in files]
        counts = defaultdict(int)
        for r in rows:
            counts[r[2]] += 1
        return cls(local_frame(spark, rows, _LISTING), dict(counts), list(files))

    def only(self, *endings: str) -> Listing:
        return replace(
            self,
            table=self.table.where(F.col("ending").isin(*endings)),
            counts={e: n for e, n in self.counts.items() if e in endings},
            named=[f for f in self.named if ending_of(f.name) in endings],
            small={e: s for e, s in self.small.items() if e in endings},
        )

    @property
    def n_small(self) -> int:
        return sum(n for n, _ in self.small.values())

    def small_names(self, among: DataFrame | None = None) -> DataFrame | None:
        """Names of the small files (of those ``among`` has), dealt to the tasks that are to read them."""
        spark, parts = self.table.sparkSession, []
        cores = spark.sparkContext.defaultParallelism
        for ending, (n, cost) in self.small.items():
            tasks = min(n, max(cores, -(-cost // min(TASK_BYTES, split_size(spark)))))
            rows = self.table.where((F.col("ending") == ending) & F.col("place").isNotNull())
            if among is not None:
                rows = rows.join(among, "source_file", "left_semi")
            task = F.least(F.floor(F.col("place") / F.lit(cost / tasks)), F.lit(tasks - 1)).cast("int")
            parts.append(rows.repartitionById(tasks, task).select("source_file"))
        return reduce(DataFrame.unionByName, parts) if parts else None


def ending_of(name: str) -> str:
    return next((e for e in ENDINGS if name.lower().endswith("." + e)), "")


def list_folder(spark: SparkSession, folder: str) -> Listing:
    """The files of :func:`list_files`, of which the driver holds but some at a time if they lie in a local folder."""
    root = _root(spark, folder)
    found = _staged_listing(spark, root) if root.startswith("file:") else None
    return found or Listing.of_files(spark, list_files(spark, folder))


def _staged_listing(spark: SparkSession, root: str) -> Listing | None:
    """Files of a folder of this machine; none if a name is no text."""
    conf = spark._jsparkSession.sessionState().conf()
    limit = min(SMALL_BYTES, split_size(spark), int(conf.filesOpenCostInBytes()))
    target = f"{scratch_root(spark)}/gristmill/listing-{uuid.uuid4().hex}"
    counts, small, named, rows, written = defaultdict(int), {}, [], [], False

    def write():
        nonlocal written
        if rows or not written:
            local_frame(spark, rows, _LISTING).coalesce(1).write.mode("append").parquet(target)
            written = True
            rows.clear()

    for found in _scan(root):
        if found is None:
            return None
        name, uri, size = found
        if size is None or name.startswith("."):
            continue
        ending, place = ending_of(name), None
        counts[ending] += 1
        refused = name.startswith("_") and "=" not in name
        if size and not refused:
            if size <= limit and not name.startswith("_"):
                n, place = small.get(ending, (0, 0))
                small[ending] = n + 1, place + size + OPEN_BYTES
            elif ending:
                named.append(SourceFile(name, uri, size))
        rows.append((name, size, ending, place))
        if len(rows) >= LISTED:
            write()
    write()
    return Listing(spark.read.schema(_LISTING).parquet(target), dict(counts), named, _local_path(root), small)


def small_texts(batches, path: str) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of the files whose names a task was given."""
    for batch in batches:
        for name in batch.column("source_file").to_pylist():
            with open(f"{path}/{name}", "rb") as file:
                yield name, file.read()


def text_lines(content: bytes, line_feeds: bool = False) -> list[bytes]:
    """Lines as Spark's reader of texts tells them: after a byte order mark, each ended by a line feed, a carriage
    return or both, or by a line feed alone."""
    content = content.removeprefix(b"\xef\xbb\xbf")
    if not line_feeds:
        return content.splitlines()
    lines = content.split(b"\n")
    return lines if lines[-1] else lines[:-1]


def read_small(names: DataFrame, path: str, rows: Callable[[str, bytes], tuple[list, ...]], schema: str) -> DataFrame:
    """What ``rows`` makes of each file, a list for each column, handed on in batches of a few MB."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        columns, size = [[] for _ in arrow], 0
        for name, content in small_texts(batches, path):
            for column, values in zip(columns, rows(name, content)):
                column += values
            size += len(content)
            if size >= SMALL_BYTES or len(columns[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
                columns, size = [[] for _ in arrow], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return names.mapInArrow(run, schema)


def _root(spark: SparkSession, folder: str) -> str:
    """A folder's place in full.  A missing folder raises."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    return fs.makeQualified(path).toUri().toString()


def list_files(spark: SparkSession, folder: str) -> list[SourceFile]:
    """Regular files directly in ``folder``, sorted by name; names that start
    with a point are skipped.  A missing folder raises.

    Spark's own file sources would drop empty files and names that start with
    an underscore, which must still get a decision, hence the file-system API.
    """
    root = _root(spark, folder)
    found = _local_files(root) if root.startswith("file:") else None
    if found is None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [
            (s.getPath().getName(), s.getPath().toUri().toString(), s.getLen() if s.isFile() else None)
            for s in fs.listStatus(path)
        ]
    inside = Folder(root, {name: size for name, _, size in found if size is not None})
    flat = len(inside.sizes) == len(found)
    files = [SourceFile(*f, inside if flat else None) for f in found if f[2] is not None and not f[0].startswith(".")]
    return sorted(files, key=lambda f: f.name)


def _local_files(root: str) -> list[tuple[str, str, int | None]] | None:
    """Name, place and size (null: not a file) of what lies in a folder of this machine, without a call to the JVM for
    each; none if a name is no text."""
    found = list(_scan(root))
    return None if None in found else found


def _local_path(root: str) -> str:
    return unquote(urlsplit(root).path)


def _scan(root: str) -> Iterator[tuple[str, str, int | None] | None]:
    """The same as they are found, and nothing after a name that is no text (null)."""
    with os.scandir(_local_path(root)) as entries:
        for entry in entries:
            try:
                uri = f"{root.rstrip('/')}/{quote(entry.name)}"
            except UnicodeEncodeError:
                yield None
                return
            if entry.is_dir() or entry.is_file():
                yield entry.name, uri, entry.stat().st_size if entry.is_file() else None


def read_head(spark: SparkSession, file: SourceFile, size: int = HEAD_BYTES) -> bytes:
    """The first bytes of one file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file.uri))
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def hidden(file: SourceFile) -> bool:
    """Names Spark's file sources refuse to read."""
    return file.name.startswith("_")


def split_size(spark: SparkSession) -> int:
    """A file up to this size is one task's work in any case."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def read_paths(files: Sequence[SourceFile]) -> list[str]:
    """Paths for a reader, which takes glob characters literally only escaped."""
    return [_literal(f.uri) for f in files]


def _literal(uri: str) -> str:
    path = unquote(uri)
    for mark in "\\{}[]*?":
        path = path.replace(mark, "\\" + mark)
    return path


def read_text(spark: SparkSession, files: Sequence[SourceFile], *columns: Column, **options) -> DataFrame:
    """``columns`` of the text of files that aren't hidden.

    Many files of one ending are read as their folder.  A file that came there after it was listed is read with them;
    it has no decision, so nothing of it goes on.
    """
    kinds, named, parts = defaultdict(list), [], []
    for f in files:
        kinds[f.folder and f.folder.uri, f.name.rpartition(".")[2]].append(f)
    others = _others(kinds)
    for (folder, ending), those in kinds.items():
        left_out = others.get((folder, ending))
        if len(those) <= NAMED or left_out is None or len(left_out) > LEFT_OUT and _bytes(those, left_out) > sum(f.size for f in those):
            named += those
            continue
        rows = spark.read.text(_literal(folder), pathGlobFilter=f"*.{ending}", **options)
        if len(left_out) > LEFT_OUT:
            names = F.broadcast(local_frame(spark, [(n,) for n in left_out], "left_out string"))
            told = rows.select(file_name().alias("__file"), *columns)
            parts.append(told.join(names, F.col("__file") == F.col("left_out"), "left_anti").drop("__file"))
        else:
            parts.append((rows.where(~file_name().isin(left_out)) if left_out else rows).select(*columns))
    if named:
        parts.append(spark.read.text(read_paths(named), **options).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def _bytes(those: list[SourceFile], names: list[str]) -> int:
    """Size of other files of the folder that some files lie in."""
    sizes = those[0].folder.sizes
    return sum(sizes[n] for n in names)


def _others(kinds: dict[tuple, list[SourceFile]]) -> dict[tuple, list[str]]:
    """Names of the other files of each folder and plain ending that a reader of the folder would read."""
    wanted = {k: {f.name for f in v} for k, v in kinds.items() if k[0] and k[1].isascii() and k[1].isalnum()}
    out = {k: [] for k in wanted}
    for folder in {v[0].folder.uri: v[0].folder for k, v in kinds.items() if k in wanted}.values():
        for name, size in folder.sizes.items():
            kind = folder.uri, name.rpartition(".")[2]
            if size and kind in wanted and name not in wanted[kind] and not name.startswith("."):
                out[kind].append(name)
    return out


def file_name() -> Column:
    """Plain file name of the row being read (the metadata column is URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
