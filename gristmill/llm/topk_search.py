"""Exact top-k inner products: candidates by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become integers ``floor(scale * x)``.  Candidates are dealt by descending length to bands, queries to blocks; a
task has a cell, one band and one block.  It holds the queries and takes candidates in descending order of length, each
query with the k-th score it has so far:

* a query is done once its length times that of the next candidate can't reach that score;
* the inner product of rotated vectors is summed over leading coordinates; what is left is at most the product of the
  lengths of what is left (Cauchy-Schwarz).  The sum stops at the places where a half, a quarter and a sixteenth of all
  vectors' squared length is left (by their singular values), and only pairs that can still reach the score go on;
* pairs that remain are scored exactly on the integers.

The longest band answers every query first.  After that, queries are blocked by the least length that can still reach
their score, and a block is sent only to the bands that have such lengths.  Bands are at most ``MOST_BANDS``, so what the
driver sees doesn't grow with the data; a query set against all rows in blocks moves each candidate once a block.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do those whose
integers have a squared length of 2**62 or more (a long may not hold their scores); shorter vectors are as if padded with
zeros; equal rows count once, and ids that repeat with different vectors are different candidates, none of them a partner
of a query with that id; ties go to the smaller id; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import Shared
from gristmill.llm.lm_score import grouped
from gristmill.llm.vectors import by_length, usable
from gristmill.session import local_frame, stage

# Candidates of a band (more once there are MOST_BANDS), queries of a block, candidates and queries of one step.
BAND, MOST_BANDS, BLOCK, STEP, ROWS = 8192, 1024, 2048, 512, 256
# Shares of the squared length that may be left where partial sums are compared with scores.
LEFT = (1 / 2, 1 / 4, 1 / 16)
# Sums of products of integers below this are exact in double precision.
EXACT = float(1 << 53)
TOO_LONG = float(1 << 62)
_LOWEST = -(1 << 62)

_RANKED = "query_id long, vec_id long, score long"


def _matrix(column, d: int) -> np.ndarray:
    out = np.zeros((len(column), d))
    for at, x in by_length(column):
        out[at, : x.shape[1]] = x
    return out


def rotation_of(rows: DataFrame, d: int) -> tuple[np.ndarray, list[int]]:
    """Right singular vectors of all vectors, largest first, from the sums of products that tasks return, and the
    numbers of leading coordinates at which ``LEFT`` is left."""

    def run(batches):
        gram = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column("v"), d)
            gram += x.T @ x
        i, j = np.nonzero(gram)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram[i, j])], names=["i", "j", "x"])

    gram = np.zeros((d, d))
    sums = rows.select("v").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    gram[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("x").to_numpy()
    # Any rotation gives exact results; this one makes partial sums tell the most.
    _, squares, vectors = np.linalg.svd((gram + gram.T) / 2)
    left = 1 - np.cumsum(squares) / max(squares.sum(), 1e-300)
    return vectors.T, sorted({int(np.searchsorted(-left, -share)) + 1 for share in LEFT})


class Cell:
    """A block of queries that meets candidates in descending order of length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, rotation: np.ndarray, levels: list[int]):
        self.ids, self.q, self.k, self.rotation = ids, q, k, rotation
        self.size = np.linalg.norm(q, axis=1)
        self.cuts = [0, *(h for h in levels if h < q.shape[1]), q.shape[1]]
        self.y, self.tails = self._turned(q)
        self.least = least.astype(np.int64)
        self.found = [np.empty(0, np.int64)] * 3  # places of queries, ids, scores
        self.pairs = self.scored = 0

    def _turned(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        y = x @ self.rotation
        return y, [np.linalg.norm(y[:, h:], axis=1) for h in self.cuts[1:-1]]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> bool:
        """Take a step's candidates, none longer than those before; whether any query is still open."""
        longest = np.linalg.norm(x[0])
        slack = 1e-9 * self.size * longest + 1e-6
        open_ = np.flatnonzero(self.size * longest + slack >= self.least)
        self.pairs += len(self.ids) * len(ids)
        if not len(open_):
            return False
        y, tails = self._turned(x)
        parts = [self.found]
        for lo in range(0, len(open_), ROWS):
            rows = open_[lo : lo + ROWS]
            i, j = self._passing(rows, y, tails, slack)
            keep = self.ids[rows[i]] != ids[j]
            i, j = rows[i[keep]], j[keep]
            s = self._scores(i, x, j, longest)
            keep = s >= self.least[i]
            parts.append([i[keep], ids[j[keep]], s[keep]])
        self._keep(parts)
        return True

    def _passing(self, rows: np.ndarray, y: np.ndarray, tails: list[np.ndarray], slack: np.ndarray):
        """Pairs whose partial sums can still reach the query's score, after as many levels as there are."""
        floor = (self.least - slack)[rows][:, None]
        own = self.y[rows]
        total = np.zeros((len(rows), len(y)))
        i = j = None
        for n, (a, b) in enumerate(zip(self.cuts[:-2], self.cuts[1:-1])):
            if i is None:
                total += own[:, a:b] @ y[:, a:b].T
                passes = total + self.tails[n][rows][:, None] * tails[n] >= floor
                # Once few are left they go on as pairs.
                if passes.mean() < 0.1:
                    i, j = np.nonzero(passes)
                    sums = total[i, j]
            else:
                sums = sums + np.einsum("ij,ij->i", own[i, a:b], y[j, a:b])
                keep = sums + self.tails[n][rows[i]] * tails[n][j] >= floor[i, 0]
                i, j, sums = i[keep], j[keep], sums[keep]
        if i is None:
            i, j = np.nonzero(passes) if len(self.cuts) > 2 else np.nonzero(np.ones(total.shape, bool))
        return i, j

    def _scores(self, i: np.ndarray, x: np.ndarray, j: np.ndarray, longest: float) -> np.ndarray:
        self.scored += len(i)
        kind = np.float64 if self.size.max(initial=0) * longest < EXACT else np.int64
        out = np.empty(len(i), np.int64)
        most = max(1, (1 << 22) // x.shape[1])
        for lo in range(0, len(i), most):
            some = slice(lo, lo + most)
            out[some] = np.einsum("ij,ij->i", self.q[i[some]].astype(kind), x[j[some]].astype(kind))
        return out

    def _keep(self, parts: list) -> None:
        i, ids, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, -s, i))
        i, ids, s = i[order], ids[order], s[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < self.k
        self.found = [i[keep], ids[keep], s[keep]]
        full = nth == self.k - 1
        self.least[i[full]] = np.maximum(self.least[i[full]], s[full])

    def answer(self) -> pa.RecordBatch:
        i, ids, s = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(ids), pa.array(s)], names=["query_id", "vec_id", "score"])


def _answered(asked: DataFrame, candidates: DataFrame, k: int, d: int, rotation: Shared, levels: list[int]) -> DataFrame:
    """Best of each cell; ``asked`` has ``cell``, ``vec_id``, ``v``, ``least``, ``candidates`` the same without ``least``."""
    kind, none = F.lit(1).alias("kind"), F.lit(None).cast("long").alias("least")
    both = asked.select("cell", F.lit(0).alias("kind"), F.lit(0.0).alias("length"), "vec_id", "v", "least").union(
        candidates.select("cell", kind, "length", "vec_id", "v", none)
    )

    def run(batches):
        held, cell, own, going = [], None, None, True
        for batch in batches:
            for here in grouped([batch], "cell"):
                if here.column("cell")[0].as_py() != own:
                    if cell:
                        yield cell.answer()
                    held, cell, own, going = [], None, here.column("cell")[0].as_py(), True
                for part in grouped(here.to_batches(), "kind"):
                    ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("v").combine_chunks(), d)
                    if part.column("kind")[0].as_py() == 0:
                        held.append((ids, x, part.column("least").to_numpy()))
                        continue
                    if held and cell is None:
                        cell = Cell(*(np.concatenate(c) for c in zip(*held)), k, rotation.value, levels)
                    for lo in range(0, len(ids), STEP):
                        going = going and cell is not None and cell.meet(ids[lo : lo + STEP], x[lo : lo + STEP])
        if cell:
            yield cell.answer()

    dealt = both.repartition("cell").sortWithinPartitions("cell", "kind", F.desc("length"), "vec_id")
    return dealt.mapInArrow(run, _RANKED)


def blocks_of(counts: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """(reach, first block, number of blocks) from (reach, queries), for blocks of about ``size`` queries."""
    out, block, held = [], -1, size
    for reach, n in counts:
        if held + n > size:
            block, held = block + 1, 0
        times = max(1, -(-n // size))
        out.append((reach, block, times))
        block, held = block + times - 1, held + n if times == 1 else size
    return out


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows whose id is divisible by ``every``, against all rows."""
    spark = table.sparkSession
    block = block or BLOCK
    rows = table.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    numbers = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v")).distinct()
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("length", F.sqrt(square)).where(square < F.lit(TOO_LONG))
    rows = stage(rows, "integers")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.count(F.when(is_query, 1)).alias("q")).first()
    n, d, blocks = about["n"], about["d"] or 1, max(1, -(-about["q"] // block))
    turn, levels = rotation_of(rows, d)
    rotation = Shared(spark, turn)
    wanted = min(MOST_BANDS, max(1, -(-n // BAND)))
    bands = rows.repartitionByRange(wanted, F.desc("length"), F.col("vec_id")).withColumn("band", F.spark_partition_id())
    bands = stage(bands, "bands")
    longest = dict(sorted(tuple(r) for r in bands.groupBy("band").agg(F.max("length")).collect()))
    first = min(longest, default=0)
    queries = bands.where(is_query)

    # Every query meets the longest band first.
    head_cells = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("cell"), "vec_id", "v", F.lit(_LOWEST).cast("long").alias("least"))
    head = _answered(asked, bands.where(F.col("band") == first).withColumn("cell", head_cells), k, d, rotation, levels)
    head = stage(head, "head")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = head
    if len(longest) > 1:
        # The k-th best so far; with fewer there is nothing to hold others against.
        least = head.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select(F.col("query_id").alias("of"), F.col("score").alias("least"))
        asked = queries.join(least, F.col("vec_id") == F.col("of"), "left").select("vec_id", "v", "length", F.coalesce("least", F.lit(_LOWEST).cast("long")).alias("least"))
        # Shortest candidates that can still matter, and from that the number of bands that have such.
        need = F.when(F.col("length") > 0, (F.col("least") - 1e-6) / F.col("length") * (1 - 1e-8)).otherwise(F.lit(0.0))
        ends = F.array(*[F.lit(x) for b, x in longest.items() if b != first])
        asked = asked.withColumn("reach", F.size(F.filter(ends, lambda x: x >= need)))
        asked = stage(asked.where("reach > 0"), "asked")
        # At most MOST_BANDS different reaches; those next to each other share a block while it has room.
        counts = sorted(tuple(r) for r in asked.groupBy("reach").count().collect())
        asked = asked.join(local_frame(spark, blocks_of(counts, block), "reach int, first int, times int"), "reach")
        asked = asked.withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("times")).cast("int"))
        cells = asked.groupBy("block").agg(F.max("reach").alias("most")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("most"))))
        named = F.element_at(F.array(*[F.lit(b) for b in longest if b != first]), F.col("nth")).alias("of_band")
        cells = stage(cells.select(F.col("block").alias("of_block"), named, (F.col("block") * F.lit(len(longest)) + F.col("nth")).cast("int").alias("cell")), "cells")
        sent = asked.join(cells, F.col("block") == F.col("of_block")).select("cell", "vec_id", "v", "least")
        met = bands.join(cells, F.col("band") == F.col("of_band")).select("cell", "length", "vec_id", "v")
        ranked = head.union(_answered(sent, met, k, d, rotation, levels))
    ranked = ranked.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
