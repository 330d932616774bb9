"""Helpers the operators share: Arrow map tasks, word hashes, samples, running sums, components."""

from __future__ import annotations

import ctypes
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.session import bounded_batches, scratch_root, stage

# Bytes of text that one vectorised step of a map task looks at (a longer text is one step).
CHUNK_BYTES = 1 << 20

TEXT_SCHEMA = "doc_id long, text string"


_OWNER: list[str | None] = [None]


def fresh_task(owner: str) -> None:
    """Called where a task of a module begins: a reused worker drops what other modules cached, and gives memory back."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for name, module in list(sys.modules.items()):
            if name.startswith(__package__) and name != owner:
                for held in list(vars(module).values()):
                    if hasattr(held, "cache_clear"):
                        held.cache_clear()
    release()


def release() -> None:
    """Give memory that nothing uses any more back to the machine, which a worker would keep for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def tidy(run):
    """A task's function that begins as a ``fresh_task`` and, its rows all out, gives its memory back."""
    owner = run.__module__

    def whole(batches):
        fresh_task(owner)
        yield from run(batches)
        release()

    return whole


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and further columns, so that scans prune the rest."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def map_batches(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """``step`` turns a bounded slice of a task's rows into dicts of equally long columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    owner = step.__module__

    def run(batches):
        fresh_task(owner)
        for batch in batches:
            for piece in slices(batch):
                for out in step(piece):
                    columns = [as_array(out[f.name], f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        batch = piece = out = columns = None
        release()

    return df.mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) and values.type == kind else pa.array(values, type=kind)


def slices(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of ``text``; every row comes in exactly one."""
    at = batch.schema.get_field_index("text")
    if at < 0 or batch.num_rows == 0:
        yield batch
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
    block = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]):
        yield batch.slice(int(lo), int(hi - lo))


class Shared:
    """An array of bounded size that tasks read from a broadcast (as bytes, which an encrypted broadcast needs)."""

    def __init__(self, spark: SparkSession, array: np.ndarray):
        self.kind, self.shape = array.dtype.str, array.shape
        self.held = spark.sparkContext.broadcast(np.ascontiguousarray(array).tobytes())

    @property
    def value(self) -> np.ndarray:
        return np.frombuffer(self.held.value, dtype=self.kind).reshape(self.shape)


def filter_bits(n: int, bounds: tuple[int, int]) -> int:
    """Bits of a filter of ``n`` values: 16 each, so that one in 16 others passes, up to a power of two within the bounds."""
    return min(bounds[1], max(bounds[0], 1 << (16 * n).bit_length()))


def stage_tightly(df: DataFrame, label: str) -> DataFrame:
    """Like ``stage``, with the columnar files packed by zstd: for tables that are large against the input."""
    path = f"{scratch_root(df.sparkSession)}/gristmill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo ``modulus``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % F.lit(modulus)


def crc_of(ids: list, modulus: int) -> np.ndarray:
    return np.array([zlib.crc32(str("null" if i is None else i).encode()) % modulus for i in ids], dtype=np.int64)


# --- hashes of words -------------------------------------------------------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def _power_pair(size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        x = np.full(size, base, dtype=np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return powers(_BASE), powers(_INVERSE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    # One table for all slices of ``CHUNK_BYTES``, which end with the text that reaches it; further ones for longer texts.
    usual = CHUNK_BYTES + CHUNK_BYTES // 8
    return _power_pair(usual if size <= usual else 1 << int(size).bit_length())


_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts at once: 64-bit hash, row, start and end in the bytes, and the bytes.

    ``lower`` folds A-Z only.  A word never spans two rows.
    """
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    if len(data) == 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, data
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    inside = _SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    # In place, as a byte is eight here; a look-up's places are as large.
    each, codes = total[1:], _byte_codes()
    for at in range(0, len(data), 1 << 16):
        each[at : at + (1 << 16)] = codes[data[at : at + (1 << 16)]]
    each *= down[: len(data)]
    np.cumsum(each, out=each)
    code = (total[end] - total[start]) * up[start]
    code = mix(code + (end - start).astype(np.uint64) * _GOLD)
    row = np.searchsorted(offsets, start, side="right") - 1
    return code, row, start, end, data


# --- samples ---------------------------------------------------------------------------------------------------------


def sample_by(df: DataFrame, label: str, each: int, salts: int = 64) -> DataFrame:
    """About ``each`` rows of every label at most, chosen by a hash of ``doc_id``.

    A label's rows are dealt to ``salts`` groups by that hash and each group keeps its first rows, so that no label
    meets in one task; the planner also limits a group before it is shuffled.
    """
    code = F.xxhash64(F.lit(17), F.col("doc_id"))
    kept = df.withColumn("_code", code).withColumn("_salt", F.pmod("_code", F.lit(salts)))
    order = Window.partitionBy(label, "_salt").orderBy("_code", "doc_id")
    kept = kept.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= -(-each // salts))
    return kept.drop("_code", "_salt", "_nth")


# --- running sums ----------------------------------------------------------------------------------------------------


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive sum of ``value`` within ``group`` in ``order`` (which must have no ties), for groups of any size.

    Rows are dealt by ranges of (group, order); a group that fills many ranges is summed range by range, and the
    ranges' totals, one row for each range and group, give what precedes a range.
    """
    dealt = df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    # The ranges are written down: a retry of a task must not see other ones.
    dealt = stage(dealt, "ranges")
    totals = dealt.groupBy(group, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_own", F.sum(value).over(own))
    joined = dealt.join(totals, dealt[group].eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn(out, F.col("_own") + F.col("_before")).drop("_group", "_of", "_own", "_before", "_range")


# --- connected components ---------------------------------------------------------------------------------------------


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and for each the smallest node it reaches."""
    nodes, index = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = index[: len(src)], index[len(src) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def contracted(edges: DataFrame) -> DataFrame:
    """The same components from at most one edge a node and task."""

    def run(batches):
        src, dst = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            src, dst = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((src, "a"), (dst, "b")))
            nodes, root = forest(src, dst)
            far = nodes != root
            src, dst = nodes[far], root[far]
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for the nodes of ``edges`` (``a``, ``b``).

    Alternating star steps: every node's larger neighbours, then its smaller ones, are tied to the smallest node it
    knows, until nothing changes.  A step joins on a node with one row on the other side, so a hot node is split by
    the planner; steps are written to the shared folder, so lineage stays short and a lost executor repeats one step.
    """
    edges = stage(contracted(edges.where("a <> b").select("a", "b")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        tied = large.join(low, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("x"), F.col("m").alias("y"))
        small = tied.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        small = small.union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        edges = stage(small, "edges")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    # Every edge now leads from a node to the smallest node of its component.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


