"""Exact Jaccard self-join of word-shingle sets that skips by set relations.

Two documents link when ``100 * |A & B| >= percent * |A | B|``.  The result is each document's set size and the
component it falls into.

*Index-level skipping.*  Sets are ordered by one global token order (tokens found frequent last, the rest by hash;
any order gives exact answers, this one keeps lists short).  Two linked sets share a token among their first
``n - ceil(percent n / 100) + 1``.  A list holds the sets with a token in their prefix, sorted by size; with the
token's position in each set, a bound on the overlap says how far a probe may read, and what lies outside that block of
sizes or positions is skipped unread.

*Answer-level skipping.*  Every set first gets a leader out of its lists and the exact overlap with it.  For two sets
b, c with the same leader a the overlap follows up to a margin from the computed ones:
``|ab| + |ac| - |a| <= |bc| <= min(|ab|, |ac|) + min(|b| - |ab|, |c| - |ac|)``; pairs that this decides are neither
read nor counted again, nor are pairs that already lie in one component.  What is left is first held against sketches
(the parity of shingles by hash place), which rule a pair out only if it can't link.

Defined results: a text that is null, empty or blank has 0 shingles and stays alone; with fewer words than ``size``
the whole sequence is the one shingle; repeated rows have equal sets and link; a null ``doc_id`` is a row like any
other but links with nothing; further columns are ignored (``without_ids`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Shared, components, filter_bits, map_batches, mix, release, slices, texts_of, tidy, words_of
from gristmill.session import stage

# How many of the most frequent shingles the token order knows at most (8 bytes each in every task).
FREQUENT = 1 << 21
# A task counts shingles over so many at a time, and then forgets those it saw once.
HELD = 4_000_000
# Least and most bits of the filter that tells which sets are needed again (1 MiB, 64 MiB); their number sizes it.
FILTER_BITS = (1 << 23, 1 << 29)

_PLACES = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit shingle hashes."""
    code, row, _, _, _ = words_of(texts)
    counts = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(code) >= size:
        n = len(code) - size + 1
        joint = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            joint += code[k : k + n] * _PLACES[k]
        joint = mix(joint)
    out = []
    for i in range(len(texts)):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= size:
            out.append(np.unique(joint[lo : hi - size + 1]))
        elif hi > lo:
            short = (code[lo:hi] * _PLACES[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def first_counts(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n`` of every document, and ``token``, ``times`` of shingles that a task saw in several sets."""

    @tidy
    def run(batches):
        known, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[np.ndarray] = []

        def merged():
            # In place as far as it goes: a span's shingles are a task's largest arrays.
            new = np.concatenate([np.empty(0, np.uint64), *held])
            held.clear()
            new.sort()
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(new)), bool), new[1:] != new[:-1]]))
            times = np.diff(first, append=len(new))
            new = new[first]
            del first
            at = np.searchsorted(known, new)
            old = at < len(known)
            old[old] = known[at[old]] == new[old]
            counts[at[old]] += times[old]
            again = ~old & (times > 1)
            both, total = np.concatenate([known, new[again]]), np.concatenate([counts, times[again]])
            order = np.argsort(both)
            return both[order], total[order]

        for batch in batches:
            for piece in slices(batch):
                sets = shingle_sets(piece.column("text"), size)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), none, none], names=names)
                held += sets
                if sum(map(len, held)) > HELD:
                    known, counts = merged()
        known, counts = merged()
        none = pa.nulls(len(known), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(known.view(np.int64)), pa.array(counts)], names=names)
        del known, counts, none
        release()

    names = ["doc_id", "n", "token", "times"]
    return docs.mapInArrow(run, "doc_id long, n long, token long, times long")


def frequent_shingles(counted: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The shingles with the highest counts that tasks report, at most ``most``, least frequent first."""
    total = stage(counted.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")), "frequent")
    level = F.least("times", F.lit(1 << 16))
    kept, least = 0, 1 << 62
    for r in total.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        kept += r["n"]
        if kept > most:
            break
        least = r["level"]
    rows = total.where(F.col("times") >= least).toArrow()
    order = np.lexsort((rows.column("token").to_numpy(), rows.column("times").to_numpy()))
    return rows.column("token").to_numpy()[order].view(np.uint64)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def postings(docs: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    """(token, doc_id, n, at) for the prefix of a set.  Equal sets within one task are indexed once; a copy gives
    (id of the indexed one, doc_id, 0, 0)."""
    spark = docs.sparkSession
    shared = Shared(spark, frequent)

    @tidy
    def run(batches):
        common = shared.value
        by_token = np.argsort(common, kind="stable")
        sorted_tokens = common[by_token]
        firsts: dict[bytes, int] = {}
        for batch in batches:
            for piece in slices(batch):
                ids = piece.column("doc_id").to_pylist()
                out: list[tuple] = []
                ties = []
                for doc, tokens in zip(ids, shingle_sets(piece.column("text"), size)):
                    n = len(tokens)
                    if n == 0 or doc is None:
                        continue
                    digest = mix(tokens).sum(dtype=np.uint64).tobytes() + mix(tokens ^ _PLACES[7]).sum(dtype=np.uint64).tobytes()
                    first = firsts.setdefault(digest, doc)
                    if first != doc:
                        ties.append((doc, first))
                        continue
                    length = prefix_length(n, percent)
                    if len(sorted_tokens):
                        at = np.minimum(np.searchsorted(sorted_tokens, tokens), len(sorted_tokens) - 1)
                        is_common = sorted_tokens[at] == tokens
                        rare, often = tokens[~is_common], tokens[is_common]
                        if len(rare) < length:
                            often = often[np.argsort(by_token[at[is_common]], kind="stable")]
                            rare = np.concatenate([rare, often[: length - len(rare)]])
                        tokens = rare
                    out.append((doc, n, tokens[:length]))
                k = [len(t) for _, _, t in out]
                token = np.concatenate([np.empty(0, np.uint64), *(t for _, _, t in out)]).view(np.int64)
                doc_col = np.repeat(np.array([d for d, _, _ in out], np.int64), k)
                n_col = np.repeat(np.array([n for _, n, _ in out], np.int32), k)
                at_col = np.concatenate([np.empty(0, np.int32), *(np.arange(x, dtype=np.int32) for x in k)])
                copy, of = np.array(ties, np.int64).reshape(-1, 2).T
                none = np.zeros(len(copy), np.int32)
                pairs = ((token, of), (doc_col, copy), (n_col, none), (at_col, none))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in pairs], names=["token", "doc_id", "n", "at"])

    return docs.mapInArrow(run, "token long, doc_id long, n int, at int")


def runs(batches, columns: list[str]):
    """Rows of key-sorted batches as (arrays of one key) in order; only one key's rows are held at a time."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        key = held[0]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(cuts):
            yield [x[: cuts[-1]] for x in held], np.concatenate([[0], cuts])
            held = [x[cuts[-1] :] for x in held]
    if held is not None and len(held[0]):
        yield held, np.concatenate([[0], np.flatnonzero(held[0][1:] != held[0][:-1]) + 1, [len(held[0])]])


def shared_lists(found: DataFrame) -> DataFrame:
    """The postings of tokens that stand in two prefixes at least, and the copies' rows."""

    @tidy
    def run(batches):
        for (token, doc, n, at), bounds in runs(batches, ["token", "doc_id", "n", "at"]):
            keep = np.repeat(np.diff(bounds) > 1, np.diff(bounds)) | (n == 0)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, doc, n, at)], names=["token", "doc_id", "n", "at"])

    dealt = found.repartition("token").sortWithinPartitions("token", "n", "doc_id")
    return dealt.mapInArrow(run, "token long, doc_id long, n int, at int")


def leaders(lists: DataFrame, percent: int) -> DataFrame:
    """``b``, ``a``: for each set the one it shares most lists with, among the smallest ids of its blocks of lists."""

    @tidy
    def run(batches):
        for (token, doc, n, at), bounds in runs(batches, ["token", "doc_id", "n", "at"]):
            got_a, got_b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                ids, sizes = doc[lo:hi], n[lo:hi].astype(np.int64)
                # Sizes ascend: the sets a probe may link with are a block of the list.
                left = np.searchsorted(100 * sizes, percent * sizes)
                right = np.searchsorted(percent * sizes, 100 * sizes, side="right")
                best = ids.copy()
                whole = (left == 0) & (right == len(ids))
                best[whole] = ids.min()
                for i in np.flatnonzero(~whole):
                    best[i] = ids[left[i] : right[i]].min()
                other = best != ids
                got_a.append(best[other])
                got_b.append(ids[other])
            a, b = np.concatenate(got_a), np.concatenate(got_b)
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            first = np.ones(len(b), bool)
            first[1:] = (b[1:] != b[:-1]) | (a[1:] != a[:-1])
            times = np.diff(np.append(np.flatnonzero(first), len(b)))
            yield pa.RecordBatch.from_arrays([pa.array(b[first]), pa.array(a[first]), pa.array(times.astype(np.int64))], names=["b", "a", "times"])

    picked = lists.sortWithinPartitions("token", "n", "doc_id").mapInArrow(run, "b long, a long, times long")
    # Sets that meet in one list only seldom link; they stay open instead of getting a leader.
    picked = picked.groupBy("b", "a").agg(F.sum("times").alias("times")).where("times > 1")
    return picked.groupBy("b").agg(F.max(F.struct("times", (-F.col("a")).alias("a"))).alias("x")).select("b", (-F.col("x.a")).alias("a"))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for every hash of an id, sized by ``filter_bits`` of their number."""
    size = filter_bits(ids.count(), FILTER_BITS)

    @tidy
    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = np.unique(_filter_places(batch.column(0).to_numpy(), size))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].astype(np.int32))], names=["byte", "bits"])

    rows = ids.mapInArrow(run, "byte long, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    bits[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def _filter_places(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(size)).astype(np.int64)


def in_filter(piece: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    ids = piece.column("doc_id")
    places = _filter_places(np.asarray(ids.fill_null(0)), len(bits) * 8)
    hit = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
    return piece.filter(pa.array(hit & np.asarray(ids.is_valid())))


def sets_of(docs: DataFrame, size: int, bits: np.ndarray) -> DataFrame:
    """``doc_id``, ``shingles`` of the documents in the filter (and of a few more)."""
    shared = Shared(docs.sparkSession, bits)

    def step(piece):
        piece = in_filter(piece, shared.value)
        if len(piece):
            sets = shingle_sets(piece.column("text"), size)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield {"doc_id": piece.column("doc_id"), "shingles": pa.ListArray.from_arrays(pa.array(ends), flat)}

    return map_batches(docs, "doc_id long, shingles array<long>", step)


def sketches_of(docs: DataFrame, size: int, bits: np.ndarray) -> DataFrame:
    """``doc_id``, ``n``, ``sketch`` of the documents in the filter: of each hash place whether it holds an odd number
    of shingles, over at least twice as many places as there are shingles."""
    shared = Shared(docs.sparkSession, bits)

    def step(piece):
        piece = in_filter(piece, shared.value)
        if len(piece):
            sets = shingle_sets(piece.column("text"), size)
            out = []
            for tokens in sets:
                places = max(512, 1 << (2 * len(tokens)).bit_length())
                odd = np.bincount((mix(tokens) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
                out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield {"doc_id": piece.column("doc_id"), "n": [len(x) for x in sets], "sketch": out}

    return map_batches(docs, "doc_id long, n int, sketch binary", step)


def possible(docs: DataFrame, size: int, percent: int, pairs: DataFrame) -> DataFrame:
    """The pairs that their sketches don't rule out: sets differ by at least as many shingles as sketches by places."""
    sketches = sketches_of(docs, size, id_filter(pairs.select("a").union(pairs.select("b"))))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("of_b"))
    left = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("of_a"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "of_a", "of_b")

    @tidy
    def run(batches):
        for batch in batches:
            n = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).astype(np.int64)
            # Linked: overlap >= percent n / (100 + percent), so they differ by n - 2 overlap at most.
            most = n - 2 * -(-percent * n // (100 + percent))
            keep = np.empty(len(n), bool)
            for i, (x, y) in enumerate(zip(batch.column("of_a"), batch.column("of_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                keep[i] = np.bitwise_count(x ^ y).sum() <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a long, b long")


def overlaps(docs: DataFrame, size: int, pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, sizes and the exact overlap of every pair.

    Sets are taken from the texts again, only where a pair needs them; one set of a pair travels with it, and a hot
    ``a`` is split by the planner.
    """
    sets = sets_of(docs, size, id_filter(pairs.select("a").union(pairs.select("b"))))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).alias("overlap"))


def linked(percent: int):
    return F.expr(f"100L * overlap >= {percent}L * (n_a + n_b - overlap)")


def open_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that the lists and the leaders' answers leave open, and those they decide.

    ``sure`` true: the leader's overlaps already prove the link.
    """

    def probe(i, others, n, at, comp, lead, over, lead_n):
        """Places among ``others`` that set ``i`` may link with; whether that is certain."""
        size = np.int64(n[i])
        o = others[comp[others] != comp[i]]
        m = n[o].astype(np.int64)
        o = o[(100 * np.minimum(m, size) >= percent * np.maximum(m, size))]
        m = n[o].astype(np.int64)
        need = -(-percent * (m + size) // (100 + percent))
        # A linked pair also meets at its first common token, and from there on shares no more than what follows.
        room = np.minimum(size - at[i], m - at[o])
        same = (lead[o] == lead[i]) & (lead[i] >= 0)
        upper = np.minimum(over[i], over[o]) + np.minimum(size - over[i], m - over[o])
        lower = over[i] + over[o] - lead_n[i]
        keep = (room >= need) & ~(same & (upper < need))
        return o[keep], (same & (lower >= need))[keep]

    @tidy
    def run(batches):
        columns = ["token", "doc_id", "n", "at", "comp", "lead", "over", "lead_n"]
        for (_, doc, n, at, comp, lead, over, lead_n), bounds in runs(batches, columns):
            a, b, sure = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                c = comp[lo:hi]
                if (c == c[0]).all():
                    continue
                names, where, times = np.unique(c, return_inverse=True, return_counts=True)
                big = names[times.argmax()]
                view = [x[lo:hi] for x in (n, at, comp, lead, over, lead_n)]
                rest = np.flatnonzero(c != big)
                main = np.flatnonzero(c == big)
                for k, i in enumerate(rest):
                    # Sets outside the list's largest component probe that one and those after them.
                    o, s = probe(i, np.concatenate([main, rest[k + 1 :]]), *view)
                    a.append(np.full(len(o), doc[lo + i]))
                    b.append(doc[lo + o])
                    sure.append(s)
            if not a:
                continue
            a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((~sure, b, a))
            a, b, sure = a[order], b[order], sure[order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (a, b, sure)], names=["a", "b", "sure"])

    dealt = lists.repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(run, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, most_frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    ``size`` words a shingle; sets link from ``percent`` hundredths Jaccard similarity on.
    """
    docs = texts_of(docs)
    counted = stage(first_counts(docs, size), "counts")
    found = stage(shared_lists(postings(docs, size, percent, frequent_shingles(counted, most_frequent))), "lists")
    lists, ties = found.where("n > 0"), found.where("n = 0").select(F.col("doc_id").alias("a"), F.col("token").alias("b"))
    led = stage(overlaps(docs, size, stage(leaders(lists, percent), "led")), "leaders")
    edges = led.where(linked(percent)).select("a", "b").union(ties)
    groups = components(edges)
    known = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    answers = led.select(F.col("b").alias("doc_id"), F.col("a").alias("lead"), F.col("overlap").alias("over"), F.col("n_a").alias("lead_n"))
    described = lists.join(known, "doc_id", "left").join(answers, "doc_id", "left")
    described = described.select(
        "token", "doc_id", "n", "at", F.coalesce("comp", "doc_id").alias("comp"), F.coalesce("lead", F.lit(-1).cast("long")).alias("lead"),
        F.coalesce("over", F.lit(0)).alias("over"), F.coalesce("lead_n", F.lit(0)).alias("lead_n"),
    )
    left = stage(open_pairs(described, percent), "open")
    refuted = led.where(~linked(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    unknown = stage(left.where("not sure").join(refuted, ["a", "b"], "left_anti").select("a", "b"), "unknown")
    unknown = stage(possible(docs, size, percent, unknown), "possible")
    more = overlaps(docs, size, unknown).where(linked(percent)).select("a", "b").union(left.where("sure").select("a", "b"))
    final = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    sizes = counted.where("token is null").select("doc_id", F.col("n").alias("n_shingles"))
    named = sizes.join(final, F.col("doc_id") == F.col("node"), "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def without_ids(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose id isn't in ``gone``; of an id in ``repeated`` one row for each text stays.

    Texts count as one if they have the same words (in lower case); of rows that are alike in that, the one with the
    least hash of all its columns stays, whatever the run.  Both tables
    have one column of distinct ids.  A filter tells most rows apart where they are; only rows that
    it holds are joined.
    """
    gone = gone.toDF("gone_from_these_rows")
    held = gone if repeated is None else gone.union(repeated)
    shared = Shared(docs.sparkSession, id_filter(held))

    def part(inside: bool):
        @tidy
        def run(batches):
            for batch in batches:
                ids = batch.column("doc_id")
                places = _filter_places(np.asarray(ids.fill_null(0)), len(shared.value) * 8)
                hit = (shared.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
                yield batch.filter(pa.array((hit & np.asarray(ids.is_valid())) == inside))

        return docs.mapInArrow(run, docs.schema)

    left = part(True).join(gone, F.col("doc_id") == F.col("gone_from_these_rows"), "left_anti")
    return part(False).union(left if repeated is None else _one_of_each_text(left))


def _one_of_each_text(rows: DataFrame) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), r"[\x20\x09-\x0D]+", " "))
    whole = F.struct(*[rows[c] for c in rows.columns])
    alike = rows.groupBy(F.col("doc_id").alias("id_of_row"), F.md5(words.cast("binary")).alias("words_of_row"))
    return alike.agg(F.min_by(whole, F.xxhash64(whole)).alias("row_itself")).select("row_itself.*")


ORACLE_SQL = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
