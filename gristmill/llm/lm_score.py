"""Language-model scores from a sharded Elias-Fano bigram trie.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end a text.  The model is an absolutely
discounted bigram model that backs off to add-one unigrams: ``(c(v, w) - D) / c(v)`` where the pair was seen, else
``D n(v) / c(v) * (c(w) + 1) / (N + V + 1)`` with n(v) the distinct successors; the sum over w is at most 1.

Occurrences (context, word, document) are dealt by context to shards, so a shard has all a context needs: it counts
the training pairs, builds its levels, maps them into memory and looks its occurrences up.  Only words whose pair was
not seen travel once more, to the shard that counted them.  Nothing that grows with the corpus is broadcast.  Contexts
that hold a large part of all tokens (a list of bounded size, found and then counted exactly) are split by the word:
a part knows the context's whole count and reports its own distinct successors, which no other part has.  Their sum is
n(v); a document's new pairs with such a context are counted, and weighed once the sums are there.

Defined results: a null text is empty and has the end as its only token; without training rows N, V and all counts are
0, and scores are 0 (log of 1); repeated rows get a row each; null ids are rows like any other; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Shared, crc_of, mix, slices, texts_of, tidy, words_of
from gristmill.llm.ngram_trie import Trie
from gristmill.session import stage

DISCOUNT = 0.75
# Training tokens a shard should have; tokens and texts of a block (what a task packs at once).
SHARD_TOKENS, BLOCK_TOKENS, BLOCK_TEXTS = 2_000_000, 2_500_000, 30_000
# Bytes of packed occurrences that a task hands on at a time.
HANDED = 4 << 20
# Parts of a context that is split, and the share of a shard from which one is.
PARTS, SPLIT_SHARE = 64, 0.125

START, END = np.uint64(0x51ED270B7A1F3C95), np.uint64(0xA24BAED4963EE407)
_PART = mix(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

_PACKED = "shard int, block long, contexts binary, runs binary, words binary, word binary, doc binary, doc_ids array<long>, tokens binary"


def tokens_of(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a slice."""
    code, row, _, _, _ = words_of(piece.column("text"))
    return code, row


def totals(docs: DataFrame, folds: int, out: int) -> tuple[int, int, DataFrame]:
    """Training tokens, training texts, and (token, share) of words that hold a large part of a task's tokens."""

    @tidy
    def run(batches):
        known, counts, words, texts = np.empty(0, np.uint64), np.empty(0, np.int64), 0, 0
        for batch in batches:
            for piece in slices(batch):
                code, row = tokens_of(piece)
                train = crc_of(piece.column("doc_id").to_pylist(), folds) != out
                words, texts = words + int(train[row].sum()), texts + int(train.sum())
                new, times = np.unique(code[train[row]], return_counts=True)
                merged, where = np.unique(np.concatenate([known, new]), return_inverse=True)
                total = np.bincount(where, weights=np.concatenate([counts, times]), minlength=len(merged)).astype(np.int64)
                # What a large word needs at least; smaller ones are forgotten, so the table stays small.
                keep = total * 4096 >= words
                known, counts = merged[keep], total[keep]
        code = np.concatenate([np.zeros(2, np.int64), known.view(np.int64)])
        kind = np.concatenate([[0, 1], np.full(len(known), 2)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(code), pa.array(np.concatenate([[words, texts], counts]))], names=["kind", "token", "n"])

    rows = stage(docs.mapInArrow(run, "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")), "totals")
    sums = {r["kind"]: r["n"] for r in rows.where("kind < 2").collect()}
    words, texts = sums.get(0, 0), sums.get(1, 0)
    return words + texts, texts, rows.where("kind = 2")


def exact_counts(docs: DataFrame, tokens: np.ndarray, folds: int, out: int) -> np.ndarray:
    """Training counts of the given (sorted) tokens."""
    shared = Shared(docs.sparkSession, tokens)

    @tidy
    def run(batches):
        wanted = shared.value
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches if len(wanted) else ():
            for piece in slices(batch):
                code, row = tokens_of(piece)
                train = crc_of(piece.column("doc_id").to_pylist(), folds) != out
                code = code[train[row]]
                at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                counts += np.bincount(at[wanted[at] == code], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted))), pa.array(counts)], names=["at", "n"])

    counts = np.zeros(len(tokens), np.int64)
    for r in docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts


def _at(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if len(table) == 0:
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def packed(docs: DataFrame, shards: int, split: Shared, folds: int, out: int) -> DataFrame:
    """Occurrences of a task's blocks by shard, and for each block its documents (shard -1).

    ``contexts`` are a shard's distinct contexts of the block with ``runs`` occurrences each; ``word`` (a place in
    ``words``) and ``doc`` (place in the block, the highest bit for training) follow that order.
    """

    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.binary()]
    names_of = [c.split(" ")[0] for c in _PACKED.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names_of)

    def pack(block: int, ids, sizes, train, codes):
        """The block's rows, a bounded part at a time; only one shard's occurrences are put in order at once."""
        n = int(sizes.sum()) + len(ids)
        # Every text's words and its end; the context is what precedes.
        ends = np.cumsum(sizes) + np.arange(len(ids))
        word = np.empty(n, np.uint64)
        is_word = np.ones(n, bool)
        is_word[ends] = False
        word[ends] = END
        word[is_word] = np.concatenate(codes)
        del codes, is_word
        context = np.empty(n, np.uint64)
        context[1:] = word[:-1]
        context[ends - sizes] = START
        for lo in range(0, n, 1 << 18):
            own = context[lo : lo + (1 << 18)]
            hot = np.flatnonzero(_at(split.value, own) >= 0)
            own[hot] = mix(own[hot] ^ _PART[(word[lo + hot] % np.uint64(PARTS)).astype(np.int64)])
        doc = np.repeat((np.arange(len(ids)) | np.where(train, 1 << 15, 0)).astype(np.uint16), sizes + 1)
        shard = (context % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.uint32)
        order = np.argsort(shard, kind="stable").astype(np.uint32)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
        del shard
        rows, held = [], 0
        for k in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[k] : bounds[k + 1]]
            own = own[np.argsort(context[own], kind="stable")]
            key = context[own]
            new = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            names, place = np.unique(word[own], return_inverse=True)
            parts = key[new], np.diff(np.append(new, len(own))).astype(np.uint32), names, place.astype(np.uint32), doc[own]
            rows.append((int(k), block, *(x.tobytes() for x in parts), None, None))
            held += sum(map(len, rows[-1][2:7]))
            if held >= HANDED:
                yield batch_of(rows)
                rows, held = [], 0
        yield batch_of([*rows, (-1, block, *[None] * 5, ids, (sizes + 1).astype(np.int64).tobytes())])

    @tidy
    def run(batches):
        block, held, ids, n = TaskContext.get().partitionId() << 24, [], [], 0

        def flush():
            codes, sizes = zip(*held)
            held.clear()
            train = crc_of(ids, folds) != out
            return pack(block, ids, np.concatenate(sizes), train, codes)

        for batch in batches:
            for piece in slices(batch):
                code, row = tokens_of(piece)
                if ids and (n + len(code) > BLOCK_TOKENS or len(ids) + len(piece) > BLOCK_TEXTS):
                    yield from flush()
                    block, ids, n = block + 1, [], 0
                held.append((code, np.bincount(row, minlength=len(piece)).astype(np.int64)))
                ids += piece.column("doc_id").to_pylist()
                n += len(code)
        if ids:
            yield from flush()

    return docs.mapInArrow(run, _PACKED)


_SUMS = "places binary, known binary, base binary, score binary, missed binary"
_FOUND = f"kind int, shard int, block long, {_SUMS}, doc_ids array<long>, tokens binary, words binary, counts binary"
_NAMES = [c.split(" ")[0] for c in _FOUND.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_TYPES = [_KINDS[c.split(" ")[1]] for c in _FOUND.split(", ")]


def _row(**values) -> pa.RecordBatch:
    values = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in values.items()}
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _sums(block: int, doc: np.ndarray, known, base, score, missed) -> pa.RecordBatch:
    """Per document of a block what one shard adds."""
    places = np.unique(doc)
    at = np.searchsorted(places, doc)
    total = [np.bincount(at, weights=x, minlength=len(places)) for x in (known, base, score, missed)]
    return _row(
        kind=0, shard=-1, block=block, places=places.astype(np.uint16), known=total[0].astype(np.uint32), base=total[1],
        score=total[2], missed=total[3].astype(np.uint32),
    )


def shard_rows(
    rows: pa.Table, split: np.ndarray, split_of: np.ndarray, split_counts: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray, ends: int, shards: int
):
    """What a shard finds: sums per block (kind 0), words to ask other shards for (kind 1), its words' counts (kind 2),
    new pairs of split contexts per document (kind 4) and distinct successors of its parts of such (kind 5)."""

    def arrays(name, kind):
        return [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]

    blocks = rows.column("block").to_numpy()
    contexts, runs, names, word, doc = (
        arrays("contexts", np.uint64), arrays("runs", np.uint32), arrays("words", np.uint64), arrays("word", np.uint32), arrays("doc", np.uint16),
    )
    keys, vocabulary = np.unique(np.concatenate(contexts)), np.unique(np.concatenate(names))
    rank = np.concatenate([np.repeat(np.searchsorted(keys, c), r) for c, r in zip(contexts, runs)])
    place = np.concatenate([np.searchsorted(vocabulary, n)[w] for n, w in zip(names, word)])
    sizes = [len(d) for d in doc]
    doc = np.concatenate(doc)
    train, doc = doc >> 15 > 0, doc & np.uint16((1 << 15) - 1)
    pair = rank.astype(np.int64) * len(vocabulary) + place
    asked, which = np.unique(pair, return_inverse=True)
    times = np.bincount(which[train], minlength=len(asked))
    learned = np.flatnonzero(times)
    pairs, times = asked[learned], times[learned]
    of, to = pairs // len(vocabulary), pairs % len(vocabulary)
    total = np.bincount(of, weights=times, minlength=len(keys)).astype(np.int64)
    distinct = np.bincount(of, minlength=len(keys))
    part = _at(split, keys)
    whole = np.where(part >= 0, split_counts[np.maximum(part, 0)] if len(split) else 0, total)
    seen = total > 0
    levels = np.cumsum(seen) - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        backoff = np.log10(np.minimum(1.0, DISCOUNT * distinct / np.maximum(whole, 1)))[seen]
        prob = np.log10((times - DISCOUNT) / whole[of])
    trie = Trie(keys[seen], backoff, vocabulary, levels[of], to, prob).mapped()
    found, value, _ = trie.look_up_pairs(keys, asked // len(vocabulary), vocabulary, asked % len(vocabulary))
    score, missed = value[which], ~found[which]
    # The weight of a split context takes all its parts.
    context = np.where(part >= 0, split_of[np.maximum(part, 0)], -1)
    later = missed & (context >= 0)[rank]
    score = np.where(later, 0.0, score)
    # The context is itself a token, but for the start; parts of split contexts count as wholes.
    as_token = _at(np.sort(mix(START ^ _PART)), keys) < 0
    base = np.where(as_token, np.log10(whole + 1.0), 0.0)[rank]
    known = (as_token & (whole > 0))[rank]
    # Words whose pair is new: ends and frequent words are known here, the rest is asked for.
    words = vocabulary[place]
    at_hot, is_end = _at(hot, vocabulary), vocabulary == END
    here = np.where(is_end, np.log10(ends + 1.0), 0.0)
    if len(hot):
        here += np.where(at_hot >= 0, np.log10(hot_counts[np.maximum(at_hot, 0)] + 1.0), 0.0)
    score = score + np.where(missed, here[place], 0.0)
    ask = missed & ~(is_end | (at_hot >= 0))[place]
    lo = 0
    for block, size in zip(blocks, sizes):
        own = slice(lo, lo := lo + size)
        yield _sums(int(block), doc[own], known[own], base[own], score[own], missed[own])
        for k, to_shard in _split_by((words[own][ask[own]] % np.uint64(shards)).astype(np.int64)):
            yield _row(kind=1, shard=int(k), block=int(block), places=doc[own][ask[own]][to_shard], words=words[own][ask[own]][to_shard])
        if later[own].any():
            pair_of, n_new = np.unique(context[rank[own][later[own]]] << 16 | doc[own][later[own]], return_counts=True)
            yield _row(
                kind=4, shard=-1, block=int(block), places=(pair_of & 0xFFFF).astype(np.uint16), words=(pair_of >> 16).astype(np.uint32),
                missed=n_new.astype(np.uint32),
            )
    parts = part >= 0
    if parts.any():
        yield _row(kind=5, shard=-1, block=-1, words=context[parts].astype(np.int64), counts=distinct[parts].astype(np.int64))
    plain = seen & (part < 0)
    yield _row(kind=2, shard=int(rows.column("shard")[0].as_py()), block=-1, words=keys[plain], counts=total[plain])


def _split_by(keys: np.ndarray):
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield keys[part[0]], part


def grouped(batches, column: str):
    """Tables of the rows with one value of ``column``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                if held and held[-1].column(column)[0].as_py() != values[lo]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def scored(docs: DataFrame, folds: int = 7, out: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores of every text by the model of the texts outside fold ``out``."""
    docs = texts_of(docs)
    spark = docs.sparkSession
    n, n_texts, large = totals(docs, folds, out)
    shards = max(4, -(-n // shard_tokens))
    limit = max(2.0, SPLIT_SHARE * n / shards)
    # At most shards / SPLIT_SHARE words can be that frequent.
    hot = np.sort(large.where(F.col("n") >= limit / 2).select("token").toArrow().column("token").to_numpy().view(np.uint64))
    hot_counts = exact_counts(docs, hot, folds, out)
    contexts = np.concatenate([hot, [START]]).astype(np.uint64)
    parts = mix(contexts[:, None] ^ _PART[None, :]).reshape(-1)
    part_counts = np.repeat(np.concatenate([hot_counts, [n_texts]]), PARTS)
    order = np.argsort(parts)
    split, split_counts, split_of = parts[order], part_counts[order], order // PARTS
    shared = Shared(spark, np.sort(contexts))
    tables = [Shared(spark, x) for x in (split, split_of, split_counts, hot, hot_counts)]

    @tidy
    def look_up(batches):
        for rows in grouped(batches, "shard"):
            if rows.column("shard")[0].as_py() < 0:
                for block, ids, tokens in zip(*(rows.column(c) for c in ("block", "doc_ids", "tokens"))):
                    yield _row(kind=3, shard=-1, block=block.as_py(), doc_ids=ids.as_py(), tokens=tokens.as_py())
            else:
                yield from shard_rows(rows, *(t.value for t in tables), n_texts, shards)

    dealt = packed(docs, shards, shared, folds, out).repartition("shard").sortWithinPartitions("shard")
    found = stage(dealt.mapInArrow(look_up, _FOUND), "found")

    @tidy
    def answer(batches):
        for rows in grouped(batches, "shard"):
            counts = {k: rows.filter(pc.equal(rows.column("kind"), k)) for k in (1, 2)}
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in counts[2].column("words")]
            times = [np.frombuffer(x.as_buffer(), np.int64) for x in counts[2].column("counts")]
            keys = np.concatenate([np.empty(0, np.uint64), *own])
            sizes = np.concatenate([np.empty(0, np.int64), *times])[np.argsort(keys)]
            keys = np.sort(keys)
            for block, places, words in zip(*(counts[1].column(c) for c in ("block", "places", "words"))):
                at = _at(keys, np.frombuffer(words.as_buffer(), np.uint64))
                c = np.where(at >= 0, sizes[np.maximum(at, 0)] if len(sizes) else 0, 0)
                none = np.zeros(len(c))
                yield _sums(block.as_py(), np.frombuffer(places.as_buffer(), np.uint16), none, none, np.log10(c + 1.0), none)

    def successors(batches):
        for batch in batches:
            for context, n in zip(*(batch.column(c) for c in ("words", "counts"))):
                columns = [pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (context, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["context", "n"])

    vocabulary = found.where("kind = 2").agg(F.sum(F.length("words") / 8)).first()[0] or 0
    v = int(vocabulary) + int((hot_counts > 0).sum()) + int(n_texts > 0)
    distinct = np.zeros(len(contexts))
    for r in found.where("kind = 5").mapInArrow(successors, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).collect():
        distinct[r["context"]] = r["n"]
    whole = np.concatenate([hot_counts, [n_texts]])
    with np.errstate(divide="ignore"):
        weights = Shared(spark, np.where(whole > 0, np.log10(np.minimum(1.0, DISCOUNT * distinct / np.maximum(whole, 1))), 0.0))
    asked = found.where("kind in (1, 2)").repartition("shard").sortWithinPartitions("shard").mapInArrow(answer, _FOUND)
    parts_of = found.where("kind in (0, 3, 4)").union(asked)

    @tidy
    def finish(batches):
        for rows in grouped(batches, "block"):
            about = rows.filter(pc.equal(rows.column("kind"), 3))
            ids = about.column("doc_ids")[0].as_py()
            tokens = np.frombuffer(about.column("tokens")[0].as_buffer(), np.int64)
            total = {c: np.zeros(len(ids)) for c in ("known", "base", "score", "missed")}
            sums = rows.filter(pc.equal(rows.column("kind"), 0))
            for places, known, base, score, missed in zip(*(sums.column(c) for c in ("places", "known", "base", "score", "missed"))):
                at = np.frombuffer(places.as_buffer(), np.uint16)
                for c, x, kind in (("known", known, np.uint32), ("base", base, float), ("score", score, float), ("missed", missed, np.uint32)):
                    total[c][at] += np.frombuffer(x.as_buffer(), kind)
            new = rows.filter(pc.equal(rows.column("kind"), 4))
            for places, context, times in zip(*(new.column(c) for c in ("places", "words", "missed"))):
                weight = weights.value[np.frombuffer(context.as_buffer(), np.uint32)] * np.frombuffer(times.as_buffer(), np.uint32)
                total["score"] += np.bincount(np.frombuffer(places.as_buffer(), np.uint16), weights=weight, minlength=len(ids))
            base = total["base"] + np.log10(n_texts + 1.0) - tokens * np.log10(n + v + 1.0)
            columns = {
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(crc_of(ids, folds) == out),
                "n_tokens": pa.array(tokens), "n_known": pa.array(total["known"].astype(np.int64) + (n_texts > 0)),
                "train_tokens": pa.array(np.full(len(ids), n)), "base_score": pa.array(base),
                "score": pa.array(total["score"] - total["missed"] * np.log10(n + v + 1.0)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts_of.repartition("block").sortWithinPartitions("block").mapInArrow(finish, schema)
