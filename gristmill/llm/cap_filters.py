"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A vector is rotated at random and cut into ``BLOCKS`` parts; each part has a small random code, and a filter is one
code word a part, so few words span very many directions.  A vector belongs to its ``NEAREST`` filters of every table
(a rotation with its codes): the cap's height is the vector's own, so none is without filters.  They are list-decoded
part by part, dropping what can't reach the height any more.  Vectors that share a filter are compared in double
precision.  With n vectors of a length there are about n / ``LOAD`` filters a table.  A table's filters share code words,
so how likely a pair meets isn't worked out but measured: pairs exactly at the threshold are decoded by the code itself
and tables added until ``RECALL`` of them meet.

Equal vectors are one vector with a weight.  Filters that hold more than ``CELL`` vectors are cut into cells, pairs of
chunks, which different tasks compare.  A pair is counted in the smallest filter both are in, so tasks return numbers
of links and a spanning forest instead of pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths; a repeated row is another vector; a null id links with nothing and is not kept;
further columns are ignored; an empty table gives no rows.  A vector has fewer than 2**20 components.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import components, forest
from gristmill.llm.lm_score import grouped
from gristmill.llm.vectors import by_length, usable
from gristmill.session import stage

BLOCKS, NEAREST, CELL = 4, 4, 4096
# Vectors of a length for each filter of a table; the share of pairs exactly at the threshold that have to meet, and
# the pairs it is measured with; more tables than these are worse than fewer words.
LOAD, RECALL, TRIALS, MOST_TABLES = 6, 0.99, 2000, 64


# Vectors of one length share filters with no others; a vector has fewer components than this.
DIMENSIONS = 1 << 20


def plan(n: int, d: int, threshold: float) -> tuple[int, int]:
    """The code words a part and the number of tables for ``n`` vectors of ``d`` components."""
    rng = np.random.default_rng([7, d])
    x, other = unit(rng.normal(size=(TRIALS, d))), rng.normal(size=(TRIALS, d))
    other -= (other * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(other, axis=1, keepdims=True)
    # In one dimension nothing is orthogonal: the pair is one direction.
    y = unit(threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * np.where(size > 1e-9, other / np.maximum(size, 1e-300), 0))
    words = max(2, math.ceil((n / LOAD) ** (1 / BLOCKS)))
    while words > 1:
        met = np.zeros(TRIALS, bool)
        for table in range(MOST_TABLES):
            (a, f), (b, g) = (_decode(v, table, words) for v in (x, y))
            met[np.intersect1d(f * TRIALS + a, g * TRIALS + b) % TRIALS] = True
            if met.mean() >= RECALL:
                return words, table + 1
        words //= 2
    return 1, 1


@lru_cache(512)
def _code(d: int, words: int, table: int, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    """A table's rotation and the parts' code words (unit vectors)."""
    rng = np.random.default_rng([seed, d, words, table])
    rotation, _ = np.linalg.qr(rng.normal(size=(d, d)))
    parts = []
    for size in (len(x) for x in np.array_split(np.arange(d), min(BLOCKS, d))):
        # One dimension has two directions.
        c = rng.normal(size=(words, size)) if size > 1 else np.array([[1.0], [-1.0]][:words])
        parts.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return rotation, parts


def _height(inner: list[np.ndarray]) -> np.ndarray:
    """Each row's inner product with the last of its nearest filters, which hold only the parts' best words."""
    nearest = min(NEAREST, max(1, math.prod(part.shape[1] for part in inner) // 4))
    best = np.zeros((len(inner[0]), 1))
    for part in inner:
        sums = best[:, :, None] + -np.sort(-part, axis=1)[:, None, :nearest]
        best = -np.sort(-sums.reshape(len(part), -1), axis=1)[:, :nearest]
    return best[:, -1]


def _decode(x: np.ndarray, table: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of a table; a list decoding that prunes part by part."""
    d = x.shape[1]
    rotation, parts = _code(d, words, table)
    y = x @ rotation
    # A part of s of d coordinates weighs sqrt(s / d): the whole direction is a unit vector.
    cuts = np.cumsum([0, *(c.shape[1] for c in parts)])
    inner = [np.sqrt(c.shape[1] / d) * (y[:, lo:hi] @ c.T) for c, lo, hi in zip(parts, cuts[:-1], cuts[1:])]
    rest = np.zeros((len(parts) + 1, len(x)))
    for k in range(len(parts) - 1, -1, -1):
        rest[k] = rest[k + 1] + inner[k].max(axis=1)
    need = _height(inner) - 1e-9
    row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for k, part in enumerate(inner):
        sums = total[:, None] + part[row]
        at, word = np.nonzero(sums + rest[k + 1][row][:, None] >= need[row][:, None])
        row, code, total = row[at], code[at] * words + word, sums[at, word]
    return row, (code * MOST_TABLES + table) * DIMENSIONS + d


def decode(x: np.ndarray, words: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of the nearest filters of the unit rows of ``x`` in every table."""
    rows, filters = zip(*(_decode(x, table, words) for table in range(tables)))
    return np.concatenate(rows), np.concatenate(filters)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def members(classes: DataFrame, plans: dict[int, tuple[int, int]], kind: str) -> DataFrame:
    """``vec_id``, ``weight``, ``vector`` (its components' bytes as numbers of ``kind``), ``filters`` (ascending)."""

    def run(batches):
        for batch in batches:
            ids, weights = batch.column("vec_id").to_numpy(), batch.column("weight").to_numpy()
            for at, x in by_length(batch.column("vector")):
                for lo in range(0, len(at), 1024):
                    own, part = at[lo : lo + 1024], x[lo : lo + 1024].astype(kind)
                    row, filters = decode(unit(part.astype(np.float64)), *plans[x.shape[1]])
                    order = np.lexsort((filters, row))
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(own)))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(filters[order]))
                    vectors = pa.array([v.tobytes() for v in part], pa.binary())
                    columns = [pa.array(ids[own]), pa.array(weights[own]), vectors, lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "weight", "vector", "filters"])

    return classes.select("vec_id", "weight", "vector").mapInArrow(run, "vec_id long, weight long, vector binary, filters array<long>")


def _first_shared(a: np.ndarray, b: np.ndarray, lists: np.ndarray, own: int) -> np.ndarray:
    """Whether no filter before ``own`` holds both of a pair; ``lists`` is padded with different numbers by row."""
    out = np.empty(len(a), bool)
    lists = np.where(lists < own, lists, -1 - np.arange(lists.size).reshape(lists.shape))
    for lo in range(0, len(a), 8192):
        x, y = lists[a[lo : lo + 8192]], lists[b[lo : lo + 8192]]
        out[lo : lo + 8192] = ~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return out


def compare(rows: pa.Table, threshold: float, kind: str) -> tuple[np.ndarray, ...] | None:
    """Of one cell's vectors: ids with links, the linked vectors' weight that is counted here, the smallest id each reaches."""
    own, first, second = (rows.column(c)[0].as_py() for c in ("filter", "low", "high"))
    chunk, ids, weight = (rows.column(c).to_numpy() for c in ("chunk", "vec_id", "weight"))
    x = unit(np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
    left = np.flatnonzero(chunk == first)
    right = left if first == second else np.flatnonzero(chunk == second)
    pairs_a, pairs_b = [], []
    for lo in range(0, len(left), 512):
        part = left[lo : lo + 512]
        i, j = np.nonzero(x[part] @ x[right].T >= threshold - 1e-9)
        i, j = part[i], right[j]
        keep = (i < j) if first == second else np.ones(len(i), bool)
        pairs_a.append(i[keep])
        pairs_b.append(j[keep])
    a, b = np.concatenate([np.empty(0, int), *pairs_a]), np.concatenate([np.empty(0, int), *pairs_b])
    if not len(a):
        return None
    # A pair's own cosine decides, whatever the order in which the matrix product has added.
    keep = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 8192]], x[b[k : k + 8192]]) >= threshold for k in range(0, len(a), 8192)])
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    used, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    lists = rows.column("filters").take(pa.array(used)).to_pylist()
    width = max(map(len, lists))
    padded = np.full((len(used), width), np.iinfo(np.int64).max)
    for k, own_list in enumerate(lists):
        padded[k, : len(own_list)] = own_list
    p, q = index[: len(a)], index[len(a) :]
    here = _first_shared(p, q, padded, own)
    w = weight[used]
    links = np.bincount(p[here], weights=w[q[here]], minlength=len(used)) + np.bincount(q[here], weights=w[p[here]], minlength=len(used))
    nodes, root = forest(ids[a], ids[b])
    order = np.argsort(ids[used])
    return nodes, links[order].astype(np.int64), root


def _digest(name: str) -> list:
    """128 bits of a vector."""
    return [F.xxhash64(F.lit(seed), "vector").alias(f"{name}_{seed}") for seed in (1, 2)]


def near_duplicates(table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``table`` (``vec_id``, ``embedding``)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    # Single precision travels as it came; cosines are computed in double precision in any case.
    kind = "<f4" if rows.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"
    usable_ = usable(F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("ok", usable_)
    good = rows.where("ok").withColumn("vector", F.expr("transform(vector, x -> double(x) + 0.0)"))
    classes = stage(good.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight")), "classes")
    plans = {r["d"]: plan(r["n"], r["d"], threshold) for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = stage(members(classes.repartition(table.sparkSession.sparkContext.defaultParallelism), plans, kind), "members")
    light = dealt.select("vec_id", F.explode("filters").alias("filter"))
    crowded = light.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    crowded = stage(crowded.select(F.col("filter").alias("of"), F.ceil(F.col("n") / CELL).cast("int").alias("chunks")), "crowded")
    cells = dealt.select("*", F.explode("filters").alias("filter")).join(crowded, F.col("filter") == F.col("of"), "left")
    cells = cells.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("filter", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "vec_id", "weight", "vector", "filters")
    cells = cells.withColumn("cell", F.xxhash64("filter", "low", "high"))

    def run(batches):
        # Cells by their hash; two cells with one hash are told apart by what it is made of.
        for same in grouped(batches, "cell"):
            keys = sorted(set(zip(*(same.column(c).to_pylist() for c in ("filter", "low", "high")))))
            for key in keys:
                part = same if len(keys) == 1 else same.filter(pa.array([k == key for k in zip(*(same.column(c).to_pylist() for c in ("filter", "low", "high")))]))
                found = compare(part, threshold, kind) if len(part) > 1 else None
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["vec_id", "links", "root"])

    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "vec_id long, links long, root long")
    found = stage(found, "links")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = classes.join(links, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    # Rows find their class by a digest; a common vector is one row here, and rows with it are split by the planner.
    named = named.select(
        *_digest("of"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    own = good.select("vec_id", *_digest("is"))
    linked = own.join(named, (F.col("is_1") == F.col("of_1")) & (F.col("is_2") == F.col("of_2"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
