"""Delimited files of any size, parsed in two map passes over their splits.

A record may span lines, so where records begin in a split depends on whether the split starts inside a quoted field.

1. Each task reads its splits' lines once and reports, for both possibilities, whether a split ends inside quotes, how
   long its records are, and (at the head of a file) the header.  These reports compose, one row a split: they say where
   every split starts, without a look at any line.
2. Each task cuts its splits into records and parses them where they are.  Only what a record has on either side of a
   split's edge is shuffled, at most two pieces a split; only files with such a record are asked for it.  A file that is
   one split has no edge: only its header and validity are asked for in the first pass.

Files of all sizes and headers of all shapes take this one way, in one plan; small files are one split each, and their
lines go from the file to the parser in one task.  No content comes to the driver, only the names of files that can't be
parsed and the splits that start inside quotes (16 bytes for each, at most one for every split of the input).
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.repair import Feeds
from ..session import local_frame, stage
from .listing import Listing, SourceFile, file_name, hidden, read_text, small_texts, text_lines
from .segments import RECORD_LIMIT, oversize_files

# Quoted content up to its closing quote, one delimited field that starts outside quotes, and a field still open at the
# end of the line.  A quote opens a field only as its first character; elsewhere it is text.
_CONTENT = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_CONTENT}"[^,]*+|[^",][^,]*+|)'
_OPEN_TAIL = rf'"{_CONTENT}\Z'
OPENS = re.compile(rf"(?:{_FIELD},)*+{_OPEN_TAIL}")
STAYS = re.compile(rf"{_CONTENT}\Z")
REOPENS = re.compile(rf'{_CONTENT}"[^,]*+,(?:{_FIELD},)*+{_OPEN_TAIL}')

_REPORT = (
    "source_file string, block long, valid boolean, header array<string>, header_pos long,"
    " end0 boolean, first0 long, longest0 long, last0 long, open0 long,"
    " end1 boolean, first1 long, longest1 long, last1 long, open1 long"
)
_START = "source_file string, block long, open_pos long"
_RECORD = "source_file string, pos long, part long, text string, values array<string>"


@dataclass(frozen=True)
class CsvSource:
    feeds: Feeds | None
    unreadable: list[str]  # names that cannot be read
    invalid: list[str]  # names whose bytes are not valid text
    oversize: list[str]  # names with a record too long to be one value


@dataclass(frozen=True)
class Lines:
    """Lines in the order of the file, each with its split: tasks read a split from its start to its end."""

    read: DataFrame | None  # by Spark's reader
    names: DataFrame | None  # of small files, which tasks read themselves
    path: str = ""

    def map(self, run: Callable, schema: str) -> DataFrame:
        path, parts = self.path, []

        def read(batches):
            return run(_small_lines(batches, path))

        if self.read is not None:
            parts.append(self.read.mapInArrow(run, schema))
        if self.names is not None:
            parts.append(self.names.mapInArrow(read, schema))
        return reduce(DataFrame.unionByName, parts)

    def of_files(self, names: set[str], how: str = "left_semi") -> Lines:
        """Lines of some files.  Where Spark splits a file depends on all that is read with it, so all passes read the
        same files and drop lines afterwards."""
        return Lines(*(rows if rows is None else _of_files(rows, names, how) for rows in (self.read, self.names)), self.path)


def read_feeds(spark: SparkSession, files: Listing | Sequence[SourceFile]) -> CsvSource:
    """All delimited files as one table of records and one of headers."""
    files = files if isinstance(files, Listing) else Listing.of_files(spark, files)
    refused = files.table.where(F.startswith("source_file", F.lit("_"))).select("source_file")
    unreadable = sorted(r["source_file"] for r in refused.collect())
    readable = [f for f in files.named if not hidden(f) and f.size > 0]
    if not readable and not files.n_small:
        return CsvSource(None, unreadable, [], [])
    lines = Lines(_lines(spark, readable) if readable else None, files.small_names(), files.path)
    reports = stage(_reports(lines), "splits")
    whole = stage(_composed(reports), "split-starts")
    facts = whole.where("open_pos IS NULL")
    told = facts.where("NOT valid OR cut").select("source_file", "valid").collect()
    invalid = sorted(r["source_file"] for r in told if not r["valid"])
    lengths = facts.select("source_file", F.col("longest").alias("bytes"), F.lit(0).alias("record"))
    oversize = [name for name in oversize_files(lengths, "record") if name not in invalid]
    bad, named = {*invalid, *oversize}, {f.name for f in readable}
    if not named - bad and files.n_small <= len(bad - named):
        return CsvSource(None, unreadable, invalid, oversize)
    starts = _starts(spark, whole.where("open_pos IS NOT NULL"))
    cut = {r["source_file"] for r in told} - bad
    # Spark's reader of a folder may find files that came after it was listed; files that tasks open are listed ones.
    listed = named - bad if not files.n_small else None
    headers = _headers(reports, lines, starts, cut, bad, listed)
    rows = records(lines.of_files(bad, "left_anti"), starts, cut)
    return CsvSource(_feeds(rows, headers), unreadable, invalid, oversize)


def _lines(spark: SparkSession, files: Sequence[SourceFile]) -> DataFrame:
    block = F.col("_metadata.file_block_start").alias("block")
    only = (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")) & (F.col("_metadata.file_size") <= RECORD_LIMIT)
    return read_text(spark, files, file_name().alias("source_file"), block, only.alias("only"), F.col("value").cast("binary").alias("line"))


def _small_lines(batches, path: str) -> Iterator[pa.RecordBatch]:
    """The same of small files: all of a file is one split."""
    for name, content in small_texts(batches, path):
        lines = pa.array(text_lines(content), pa.binary())
        if n := len(lines):
            columns = [pa.repeat(name, n), pa.repeat(0, n), pa.repeat(True, n), lines]
            yield pa.RecordBatch.from_arrays(columns, names=["source_file", "block", "only", "line"])


def _of_files(rows: DataFrame, names: set[str], how: str = "left_semi") -> DataFrame:
    if not names and how == "left_anti":
        return rows
    return rows.join(F.broadcast(local_frame(rows.sparkSession, [(n,) for n in sorted(names)], "source_file string")), "source_file", how)


def _splits(batches) -> Iterator[tuple[str, int, bool, pa.Array]]:
    """(file, block, whether it is all of the file, lines) of each run of lines of one split; a split may come in several."""
    for batch in batches:
        if batch.num_rows:
            names = batch.column("source_file").dictionary_encode()
            code, block = names.indices.to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(code)]):
                yield names.dictionary[code[lo]].as_py(), int(block[lo]), batch.column("only")[lo].as_py(), batch.column("line").slice(lo, hi - lo)


def _goes_on(line: str, inside: bool) -> bool:
    """Whether a line that starts inside (or outside) a quoted field ends inside one."""
    return bool(STAYS.match(line) or REOPENS.match(line)) if inside else bool(OPENS.match(line))


class _Reading:
    """A split read from one of the two states: how it ends and how long its records are."""

    def __init__(self, inside: bool):
        self.inside, self.open_pos = inside, None
        # Bytes of the record that is open, of the first that ends here, and of the longest.
        self.now, self.first, self.longest = 0, None, 0

    def plain(self, sizes: np.ndarray) -> None:
        """Lines without any quote."""
        if self.inside:
            self.now += int(sizes.sum())
        elif len(sizes):
            self.first = int(sizes[0]) if self.first is None else self.first
            self.longest = max(self.longest, int(sizes.max()))

    def quoted(self, line: str, size: int, pos: int) -> None:
        stays = _goes_on(line, self.inside)
        if stays and not self.inside:
            self.open_pos = pos
        self.now += size
        if not stays:
            self.first = self.now if self.first is None else self.first
            self.longest, self.now, self.open_pos = max(self.longest, self.now), 0, None
        self.inside = stays

    def report(self) -> tuple:
        return self.inside, self.first, self.longest, self.now, self.open_pos


class _Head:
    """The first record of a file that isn't blank, as far as the first split has it whole."""

    def __init__(self):
        self.lines, self.pos, self.done, self.inside = [], None, False, False

    def take(self, lines: pa.Array, pos: int) -> None:
        for k, line in enumerate(lines):
            line = line.as_py()
            if not self.inside and not line.strip():
                continue
            self.pos = pos + k if self.pos is None else self.pos
            self.lines.append(line)
            self.inside = _goes_on(line, self.inside)
            if not self.inside:
                self.done = True
                return

    def values(self) -> list[str] | None:
        return parse_header("\n".join(self.lines)) if self.done else None


def parse_header(text: str) -> list[str]:
    return next(_rows([text.removeprefix("﻿")]), [])


def _rows(texts: list[str]) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader(line + "\n" for text in texts for line in text.split("\n"))


def _text(lines: pa.Array) -> pa.Array | None:
    try:
        return lines.cast(pa.large_binary()).cast(pa.large_string())
    except pa.ArrowInvalid:
        return None


def _reports(lines: Lines) -> DataFrame:
    """What each split says about itself; the second reading is needed only where a split isn't a file's first, and
    none where it is all of the file and no longer than a record may be."""

    def run(batches):
        split = None

        def row():
            (name, block), valid, head, readings = split[0], split[1], split[3], split[4]
            other = readings[1].report() if block else (None,) * 5
            return (name, block, valid, head.values() if not block else None, head.pos, *readings[0].report(), *other)

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        out = []
        for name, block, only, part in _splits(batches):
            if split is None or split[0] != (name, block):
                if split:
                    out.append(row())
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
                split = [(name, block), True, block, _Head(), [_Reading(False), _Reading(True)]]
            text = _text(part)
            if text is None:
                split[1] = False
                continue
            pos = split[2] + 1
            split[2] += len(text)
            if not block and not split[3].done:
                split[3].take(text, pos)
            if only:
                continue
            sizes = np.asarray(pc.binary_length(text)).astype(np.int64) + 1
            marked = np.flatnonzero(np.asarray(pc.match_substring(text, '"')))
            for reading in split[4][: 2 if block else 1]:
                done = 0
                for k in marked.tolist():
                    reading.plain(sizes[done:k])
                    reading.quoted(text[k].as_py(), int(sizes[k]), pos + k)
                    done = k + 1
                reading.plain(sizes[done:])
        if split:
            out.append(row())
        yield batch_of(out)

    arrow = _arrow(_REPORT)
    return lines.map(run, _REPORT)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _composed(reports: DataFrame) -> DataFrame:
    """A row for each file (``open_pos`` null; ``cut``: a split of it ends inside quotes), and one for each split that
    starts inside quotes, with the place where the record that is open there began."""

    def run(batches):
        name, state = None, None

        def whole():
            return {"source_file": name, "block": None, "open_pos": None, "valid": state[0], "longest": max(state[1], state[2]), "cut": state[4]}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["source_file"] != name:
                    if name is not None:
                        out.append(whole())
                    name, state = r["source_file"], [True, 0, 0, None, False]
                valid, longest, carried, open_pos, cut = state
                inside = open_pos is not None
                if inside:
                    out.append({"source_file": name, "block": r["block"], "open_pos": open_pos, "valid": None, "longest": None, "cut": None})
                end, first, own, last, at = (r[f"{c}{int(inside)}"] for c in ("end", "first", "longest", "last", "open"))
                ended = first is not None
                state = [
                    valid and r["valid"],
                    max(longest, own, carried + first if ended else 0),
                    last if ended else carried + last,
                    (at if at is not None else open_pos) if end else None,
                    cut or end,
                ]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if name is not None:
            yield pa.RecordBatch.from_pylist([whole()], schema=arrow)

    schema = f"{_START}, valid boolean, longest long, cut boolean"
    arrow = _arrow(schema)
    rows = reports.drop("header", "header_pos").repartition("source_file").sortWithinPartitions("source_file", "block")
    return rows.mapInArrow(run, schema)


def _starts(spark: SparkSession, starts: DataFrame) -> Broadcast:
    """Where the record that is open at the start of a split began, by file and split."""
    table = starts.select("source_file", "block", "open_pos").toArrow()
    return spark.sparkContext.broadcast({(f, b): at for f, b, at in zip(*(table.column(c).to_pylist() for c in ("source_file", "block", "open_pos")))})


def records(lines: Lines, starts: Broadcast, cut: set[str]) -> DataFrame:
    """``source_file``, ``pos``, ``values`` of all records that aren't blank, headers included; only files named in
    ``cut`` have records in more than one split, so only their lines are asked for pieces."""
    whole = _cut(lines, starts).where("part IS NULL AND values IS NOT NULL").select("source_file", "pos", "values")
    if not cut:
        return whole
    pieces = _cut(lines.of_files(cut), starts).where("part IS NOT NULL").groupBy("source_file", "pos").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    joined = pieces.select("source_file", "pos", F.array_join("parts.text", "\n").alias("text"))

    def run(batches):
        for batch in batches:
            rows = [_parsed([t])[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source_file"), batch.column("pos"), pa.array(rows, pa.list_(pa.string()))], names=["source_file", "pos", "values"])

    joined = joined.mapInArrow(run, "source_file string, pos long, values array<string>")
    return whole.unionByName(joined.where("values IS NOT NULL"))


def _parsed(texts: list[str]) -> list[list[str] | None]:
    """Values of each record, null for a blank one."""
    rows = list(_rows(texts))
    if len(rows) != len(texts):
        rows = [next(_rows([t]), []) for t in texts]
    return [None if not r or (len(r) == 1 and not t.strip()) else r for r, t in zip(rows, texts)]


def _cut(lines: Lines, starts: Broadcast) -> DataFrame:
    """Parsed records that lie in one split (``part`` null), and texts of the parts of those that don't."""
    arrow = _arrow(_RECORD)

    def run(batches):
        starts_at, split = starts.value, None
        none = pa.nulls(1, pa.list_(pa.string()))

        def part(text):
            (name, block), at = split[0], split[2]
            columns = [pa.array([name]), pa.array([at]), pa.array([block]), pa.array([text]), none]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for (name, block, only), runs in groupby(_splits(batches), key=lambda s: s[:3]):
            if only:
                yield from _whole_file(name, runs, arrow)
                continue
            for *_, run_ in runs:
                if split is None or split[0] != (name, block):
                    if split and split[2] is not None:
                        yield part("\n".join(split[3]))
                    # Split, its last line's place, where the open record began, the lines of it, whether that was earlier.
                    at = starts_at.get((name, block))
                    split = [(name, block), block, at, [], at is not None]
                text = _text(run_)
                found, places = [], []
                marked = set(np.flatnonzero(np.asarray(pc.match_substring(text, '"'))).tolist())
                for k, line in enumerate(text.to_pylist()):
                    split[1] += 1
                    inside = split[2] is not None
                    stays = _goes_on(line, inside) if k in marked else inside
                    if not inside and not stays:
                        found.append(line)
                        places.append(split[1])
                        continue
                    if not inside:
                        split[2] = split[1]
                    split[3].append(line)
                    if not stays:
                        whole = "\n".join(split[3])
                        if split[4]:
                            yield part(whole)
                        else:
                            found.append(whole)
                            places.append(split[2])
                        split[2:] = [None, [], False]
                yield _batch(name, places, _parsed(found), arrow)
        if split and split[2] is not None:
            yield part("\n".join(split[3]))

    return lines.map(run, _RECORD)


def _batch(name: str, places: list[int], rows: list[list[str] | None], arrow: pa.Schema) -> pa.RecordBatch:
    n = len(rows)
    columns = [
        pa.array([name]).take(pa.array(np.zeros(n, np.int64))), pa.array(places, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()),
        pa.array(rows, pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _whole_file(name: str, runs, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records of a file that is one split: nothing lies across an edge, so the lines are parsed as they come."""
    csv.field_size_limit(sys.maxsize)
    line = ""

    def lines():
        nonlocal line
        for *_, run in runs:
            for line in _text(run).to_pylist():
                yield line + "\n"

    reader = csv.reader(lines())
    rows, places, pos = [], [], 1
    for r in reader:
        # A blank record is one line; a record of more lines has a quote.
        if r and not (len(r) == 1 and pos == reader.line_num and not line.strip()):
            rows.append(r)
            places.append(pos)
        pos = reader.line_num + 1
        if len(rows) >= 10000:
            yield _batch(name, places, rows, arrow)
            rows, places = [], []
    yield _batch(name, places, rows, arrow)


def _headers(reports: DataFrame, lines: Lines, starts: Broadcast, cut: set[str], bad: set[str], listed: set[str] | None) -> DataFrame:
    """``source_file``, ``header``, ``header_pos`` of the files that aren't ``bad`` and are ``listed`` (null: all are); a
    header that a file's first split doesn't hold whole is read with the file's records."""
    first = _of_files(reports.where("block = 0"), bad, "left_anti")
    if listed is not None:
        names = reports.sparkSession.createDataFrame(pa.table({"source_file": sorted(listed)}))
        first = first.join(names, "source_file", "left_semi")
    headers = first.where("header IS NOT NULL").select("source_file", "header", "header_pos")
    late = {r["source_file"] for r in first.where("header IS NULL").select("source_file").collect()}
    if late:
        rows = records(lines.of_files(late), starts, late & cut).groupBy("source_file").agg(F.min_by("values", "pos").alias("header"), F.min("pos").alias("header_pos"))
        headers = headers.unionByName(rows.select("source_file", "header", "header_pos"))
    return stage(headers, "headers")


def _feeds(rows: DataFrame, headers: DataFrame) -> Feeds:
    plans = stage(headers.select("header").distinct().withColumn("plan_id", F.monotonically_increasing_id()), "header-ids")
    # Staged, so that its size is known and a small one is broadcast instead of all rows being shuffled.
    files = stage(headers.join(plans, "header").select("source_file", "header_pos", "plan_id", F.size("header").alias("width")), "header-places")
    body = rows.join(files, "source_file").where("pos > header_pos")
    # Values that are missing at the end are the empty string, values beyond the header are dropped.
    width = F.col("width")
    fitted = F.slice(F.concat("values", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return Feeds(body.select("source_file", "pos", "plan_id", F.when(F.size("values") == width, F.col("values")).otherwise(fitted).alias("values")), plans)
