"""Byte-level BPE through a distinct-word table.

1. Tasks split texts into words by the tokenizer's own pattern and report the words they saw often.
2. Every distinct word is encoded once.  The most frequent words form a table of bounded size that every task holds;
   a text then is a row of table places, plus its few words outside the table.
3. Those words go to the table's other part, which is dealt by word hash to buckets: each slice of texts sends every
   bucket its distinct words in one row, the bucket encodes each distinct word once and answers in the same order, and
   the answers are joined back to the slice.
4. Ids are gathered by position.  Decoding joins ids with the vocabulary's pieces; that table has a fixed size and is
   indexed by id, so the join is an array look-up in the tasks.

The split between the two parts of the table only decides how a word travels; ids and counts don't depend on it.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty string; a special
token's string in a text is that token, as in the library; repeated rows and null ids are rows like any other; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
import unicodedata
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import map_batches, slices, texts_of, tidy
from gristmill.session import stage

# Words in the table that every task holds, and bytes of the longest (so 36 MB at most; usually about a third of that).
FREQUENT_WORDS, LONGEST = 1 << 19, 64
# A task reports words from this count on, and forgets words seen once whenever it holds this many.
SEEN, HELD = 3, 200_000
# A bucket holds the ids of twice as many words.
BUCKET_WORDS = 150_000
# Words of a slice that are in a list at once (and those of one more text).
LISTED_WORDS = 20_000
# Bytes of text in a slice that exchanges words with the buckets.
SLICE_BYTES = 2 << 20

# The public split pattern of byte-level BPE, with white space as Unicode defines it.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"

# Texts whose characters all lie below this one are split by the standard library, with the same classes spelled out.
_LOW = 0x250


@lru_cache(1)
def _low_splitter():
    """The split of texts without characters from ``_LOW`` on, and a search for such characters."""
    low = [chr(c) for c in range(_LOW)]
    letters, numbers = (re.escape("".join(c for c in low if unicodedata.category(c)[0] == kind)) for kind in "LN")
    white = re.escape("".join(c for c in low if c.isspace() and not "\x1c" <= c <= "\x1f"))
    # Possessive where a shorter match can't be one: what follows a blank is no blank, and a run ends a word.
    words = rf" ?+[{letters}]++|'(?:[stmd]|re|ve|ll)| ?+[{numbers}]++| ?+[^{white}{letters}{numbers}]++|[{white}]+(?![^{white}])|[{white}]+"
    return re.compile(words).findall, re.compile(rf"[^\0-{chr(_LOW - 1)}]").search


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(2)
def _splitter(path: str):
    """A function from a text to its words; added tokens are words of their own, longest first."""
    import regex

    added = sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    any_words = regex.compile(SPLIT).findall
    low_words, high = _low_splitter()

    def words(text: str) -> list[str]:
        return low_words(text) if text.isascii() or not high(text) else any_words(text)

    if not added:
        return words
    cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split

    def split(text: str) -> list[str]:
        if not any(a in text for a in added):
            return words(text)
        return [w for k, part in enumerate(cut(text)) for w in ([part] if k % 2 else words(part))]

    return split


@lru_cache(1)
def _spelling() -> list[str]:
    """The printable character that spells each byte, by the public mapping of byte-level BPE."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    return [rest.get(b, chr(b)) for b in range(256)]


@lru_cache(2)
def _added(path: str) -> dict[str, int]:
    return {t.content: i for i, t in _tokenizer(path).get_added_tokens_decoder().items()}


@lru_cache(2)
def _encoder(path: str):
    """A function from a word that ``_splitter`` made to its ids, by the library's model: such a word needs no second split."""
    tokenize, added, spelled = _tokenizer(path).model.tokenize, _added(path), "".join(_spelling())

    def ids(word: str) -> list[int]:
        if word in added:
            return [added[word]]
        return [t.id for t in tokenize(codecs.charmap_decode(word.encode(), "strict", spelled)[0])]

    return ids


def encode_words(path: str, words: list[str]) -> list[list[int]]:
    return list(map(_encoder(path), words))


@lru_cache(64)
def _packer(n: int):
    return struct.Struct(f"<{n}I").pack


class Words(dict):
    """Ids of words, as little-endian 32-bit numbers, each encoded when it is first asked for.

    Holds at most twice ``most`` words: when that many are new, those that were asked for before them and not since go.
    """

    def __init__(self, path: str, most: int):
        super().__init__()
        self.tokenize, self.spelled, self.added = _tokenizer(path).model.tokenize, "".join(_spelling()), _added(path)
        self.most, self.older = most, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            if word in self.added:
                ids = [self.added[word]]
            else:
                ids = [t.id for t in self.tokenize(codecs.charmap_decode(word.encode(), "strict", self.spelled)[0])]
            found = _packer(len(ids))(*ids)
        self[word] = found
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")


@lru_cache(2)
def pieces(path: str) -> list[bytes]:
    """Bytes of every id."""
    spelled = {c: b for b, c in enumerate(_spelling())}
    tok = _tokenizer(path)
    added = {i: t.content.encode() for i, t in tok.get_added_tokens_decoder().items()}
    out = [b""] * (max(tok.get_vocab().values(), default=-1) + 1)
    for piece, i in tok.get_vocab().items():
        out[i] = added[i] if i in added else bytes(spelled[c] for c in piece)
    return out


def distinct_of(texts: list[str], split) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many words each text has, and all words as places in the list of the distinct ones."""
    sizes, words, packed_words = np.empty(len(texts), np.int32), [], []
    for k, text in enumerate(texts):
        own = split(text)
        sizes[k] = len(own)
        words += own
        # A word is some ten times larger in a list than in a column.
        if len(words) >= LISTED_WORDS:
            packed_words.append(pa.array(words, pa.large_string()))
            words.clear()
    return sizes, pa.concat_arrays([*packed_words, pa.array(words, pa.large_string())]).dictionary_encode()


def frequent_words(docs: DataFrame, path: str, most: int) -> DataFrame:
    """``word``, ``times`` of the words that tasks saw often, at most ``most`` of them."""

    @tidy
    def run(batches):
        counts: Counter = Counter()
        split = _splitter(path)
        for batch in batches:
            for piece in slices(batch):
                _, coded = distinct_of(piece.column("text").to_pylist(), split)
                times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                for word, n in zip(coded.dictionary.to_pylist(), times.tolist()):
                    counts[word] += n
                if len(counts) > HELD:
                    counts = Counter({w: c for w, c in counts.items() if c > 1})
        often = [(w, c) for w, c in counts.items() if c >= SEEN]
        for at in range(0, len(often), 20_000):
            part = often[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], names=["word", "times"])

    counted = docs.select("text").mapInArrow(run, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    return counted.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("times"), "word").limit(most)


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """``word``, ``ids``, ``times``: each given word encoded once."""

    def step(piece):
        ids = encode_words(path, piece.column("word").to_pylist())
        yield {"word": piece.column("word"), "ids": pa.array(ids, pa.list_(pa.int32())), "times": piece.column("times")}

    return map_batches(words, "word string, ids array<int>, times long", step)


class WordTable:
    """The bounded part of the distinct-word table, most frequent word first: two broadcasts that tasks read in place."""

    def __init__(self, docs: DataFrame, path: str, most: int):
        spark = docs.sparkSession
        frequent = stage(frequent_words(docs, path, most), "words")
        rows = encoded_words(frequent.repartition(spark.sparkContext.defaultParallelism), path)
        table = rows.toArrow().sort_by([("times", "descending"), ("word", "ascending")])
        words = pa.table({"word": table.column("word").cast(pa.large_string())})
        self.size = len(table)
        self.words_held, self.ids_held = (spark.sparkContext.broadcast(_as_bytes(t)) for t in (words, table.select(["ids"])))

    def words(self) -> pa.Array:
        column = pa.ipc.open_stream(self.words_held.value).read_all().column("word")
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's begin."""
        column = pa.ipc.open_stream(self.ids_held.value).read_all().column("ids")
        if not column.num_chunks:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        lists = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
        return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)


def _as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _bucket(word: str, buckets: int) -> int:
    return crc32(word.encode()) % buckets


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes, low to high, packed by zstd: most are small, so planes pack well."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


_SLICES = "slice long, doc_ids array<long>, sizes array<int>, places binary, sent array<struct<bucket:int,words:array<string>>>"


def as_places(docs: DataFrame, path: str, table: WordTable, buckets: int) -> DataFrame:
    """A row for each slice of texts: ids, word counts, every word's place, and the slice's other words by bucket.

    The other words' places follow the table's, in the order of ``sent``.  ``slice`` is a digest of the rest, so that
    answers can't meet a slice that was cut otherwise when a lost task ran again.
    """

    @tidy
    def run(batches):
        held, split = table.words(), _splitter(path)
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            for piece in slices(batch, SLICE_BYTES):
                sizes, coded = distinct_of(piece.column("text").to_pylist(), split)
                found = pc.fill_null(pc.index_in(coded.dictionary, value_set=held), -1).to_numpy().astype(np.int64)
                outside = np.flatnonzero(found < 0)
                names = coded.dictionary.take(pa.array(outside)).to_pylist()
                goes_to = np.array([_bucket(w, buckets) for w in names], np.int64)
                order = np.argsort(goes_to, kind="stable")
                found[outside[order]] = len(held) + np.arange(len(names))
                places = packed(found[coded.indices.to_numpy()])
                cuts = np.flatnonzero(np.diff(goes_to[order])) + 1
                parts = np.split(order, cuts) if len(order) else []
                sent = [{"bucket": int(goes_to[part[0]]), "words": [names[k] for k in part]} for part in parts]
                ids = piece.column("doc_id").to_pylist()
                digest = hashlib.blake2b(places, digest_size=8)
                digest.update(repr((ids, [names[k] for k in order])).encode())
                columns = [
                    pa.array([int.from_bytes(digest.digest(), "little", signed=True)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int32())), pa.array([places], pa.binary()), pa.array([sent], kind),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "doc_ids", "sizes", "places", "sent"])

    return docs.mapInArrow(run, _SLICES)


def sent_words(rows: DataFrame) -> DataFrame:
    """``slice``, ``bucket``, ``words`` of the slices.  It reads whole rows, so both uses of them share one shuffle."""

    @tidy
    def run(batches):
        for batch in batches:
            sent = batch.column("sent")
            inner = sent.flatten()
            of = np.repeat(batch.column("slice").to_numpy(), np.asarray(sent.value_lengths()))
            yield pa.RecordBatch.from_arrays([pa.array(of), inner.field("bucket"), inner.field("words")], names=["slice", "bucket", "words"])

    return rows.mapInArrow(run, "slice long, bucket int, words array<string>")


def answered(sent: DataFrame, path: str) -> DataFrame:
    """``slice``, ``bucket``, ``ids``, ``lengths`` for the words that slices sent; rows of a bucket are together."""

    @tidy
    def run(batches):
        known, bucket = Words(path, BUCKET_WORDS), None
        for batch in batches:
            for own, rows in _by_value(batch, "bucket"):
                if own != bucket:
                    bucket, known = own, Words(path, BUCKET_WORDS)
                words = rows.column("words")
                ids = [known[w] for w in words.flatten().to_pylist()]
                ends = np.concatenate([[0], np.cumsum(np.asarray(words.value_lengths()))]).tolist()
                columns = [
                    rows.column("slice"), rows.column("bucket"),
                    pa.array([packed(np.frombuffer(b"".join(ids[a:b]), "<u4")) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                    pa.array([packed(np.array([len(x) // 4 for x in ids[a:b]])) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "bucket", "ids", "lengths"])

    return sent.mapInArrow(run, "slice long, bucket int, ids binary, lengths binary")


def _by_value(batch: pa.RecordBatch, name: str):
    """Slices of a batch sorted by ``name``, one for each value."""
    values = batch.column(name).to_numpy()
    cuts = np.flatnonzero(np.diff(values)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(values)]):
        if hi > lo:
            yield values[lo], batch.slice(lo, hi - lo)


def encode(docs: DataFrame, path: str, most: int = FREQUENT_WORDS):
    """The table, and the slices of texts with ``ids`` and ``lengths`` (the buckets' answers)."""
    spark = docs.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = WordTable(docs, path, most)
    # Slices are shuffled once: their words leave for the buckets from where the answers will join them.
    rows = as_places(docs, path, table, buckets).repartition("slice")
    answers = answered(sent_words(rows).repartition("bucket").sortWithinPartitions("bucket"), path)
    answers = answers.groupBy("slice").agg(F.sort_array(F.collect_set(F.struct("bucket", "ids", "lengths"))).alias("found"))
    answers = answers.select("slice", F.col("found.ids").alias("ids"), F.col("found.lengths").alias("lengths"))
    return table, rows.join(answers, "slice", "left")


def _answers(row: dict, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of ids of a slice's other words; words without an answer are encoded here."""
    none = np.empty(0, np.int64)
    if row["ids"] is None:
        ids = [x for sent in row["sent"] for x in encode_words(path, sent["words"])]
        return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)
    return np.concatenate([none, *map(unpacked, row["ids"])]), np.concatenate([none, *map(unpacked, row["lengths"])])


def encode_decode(docs: DataFrame, path: str, finish, schema: str, most: int = FREQUENT_WORDS) -> DataFrame:
    """``finish(doc_id, ids, spelled ids, decoded bytes)`` gives the values of ``schema`` for every text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    docs = texts_of(docs)
    table, rows = encode(docs, path, most)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    @tidy
    def run(batches):
        flat, begin = table.ids()
        piece = np.array([*pieces(path), None], dtype=object)[:-1]
        spelled = np.array([str(i) for i in range(len(piece))], dtype=object)
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                others, lengths = _answers(row, path)
                source = np.concatenate([flat, others])
                starts = np.concatenate([begin, len(flat) + np.cumsum(lengths)])
                at, used, out = unpacked(row["places"]), 0, []
                for doc, size in zip(row["doc_ids"], row["sizes"]):
                    own = at[used : (used := used + size)]
                    lo, n = starts[own], starts[own + 1] - starts[own]
                    ids = source[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    out.append(finish(doc, ids, spelled[ids].tolist(), b"".join(piece[ids].tolist())))
                columns = list(zip(*out)) if out else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, most: int = FREQUENT_WORDS) -> DataFrame:
    """``doc_id``, ``n_tokens``, and the SHA-256 of the ids (decimal, comma-joined) and of the decoded text."""

    def finish(doc, ids, spelled, data):
        text = data.decode("utf-8", "replace").encode()
        return doc, len(ids), hashlib.sha256(",".join(spelled).encode()).hexdigest(), hashlib.sha256(text).hexdigest()

    return encode_decode(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", most)


def token_ids(docs: DataFrame, path: str, most: int = FREQUENT_WORDS) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` (the text that the ids decode to)."""

    def finish(doc, ids, spelled, data):
        return doc, ids.tolist(), data.decode("utf-8", "replace")

    return encode_decode(docs, path, finish, "doc_id long, ids array<int>, decoded string", most)
