"""Token files: exact round trips of the coder, the files and the query; damaged files; defined cases."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from gristmill.llm import range_coder, token_files
from gristmill.llm.bpe_codec import Words, _splitter
from gristmill.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path()


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def expected(rows):
    """(doc_id, start, n_tokens, crc) of rows in ascending order of their ids, nulls first."""
    out, start = [], 0
    for (doc_id, _), ids in zip(rows, library([t for _, t in rows])):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 19), max_size=700), st.integers(1, 40), st.integers(1, 30))
def test_coder_gives_back_any_ids(ids, lanes, lane):
    held = range_coder.LANES, range_coder.LANE
    range_coder.LANES, range_coder.LANE = lanes, lane
    try:
        ids = np.array(ids, np.int32)
        assert (range_coder.decode(range_coder.encode(ids, 20), 20) == ids).all()
    finally:
        range_coder.LANES, range_coder.LANE = held


def test_coder_learns():
    rng = np.random.default_rng(2)
    skewed = np.minimum(rng.geometric(0.01, 200_000), 49_999)
    order0 = np.bincount(skewed) / len(skewed)
    entropy = -(order0[order0 > 0] * np.log2(order0[order0 > 0])).sum()
    assert len(range_coder.encode(skewed, 50_000)) * 8 / len(skewed) < entropy + 0.6
    # What follows two ids is certain here, what follows one isn't, and all ids are equally frequent.
    cycle = np.concatenate([rng.permutation(1000) for _ in range(4)])
    assert len(range_coder.encode(np.tile(cycle, 50), 50_000)) * 8 / (50 * len(cycle)) < 4  # ten by order 0
    for ids in (np.arange(50_000), np.full(70_000, 49_999), rng.integers(0, 50_000, 30_000)):
        assert (range_coder.decode(range_coder.encode(ids, 50_000), 50_000) == ids).all()


def test_only_a_decoder_looks_for_ids(monkeypatch):
    """The coder makes no table of what targets can mean, and its bytes are those of the format's first version."""
    rng = np.random.default_rng(9)
    ids = np.minimum(rng.geometric(0.002, 300_000), 49_999).astype(np.int32)

    def unwanted(model):
        raise AssertionError("a table that only decoding needs")

    with monkeypatch.context() as m:
        m.setattr(range_coder.Model, "_guess", unwanted)
        block = range_coder.encode(ids, 50_000)
    assert zlib.crc32(block) == 108972347
    assert (range_coder.decode(block, 50_000) == ids).all()
    for n in (1, 127, 129, 8192 * 128 + 5000):
        lanes, steps, full = range_coder.lanes_of(n)
        rows = range_coder.rows_of(np.arange(1, n + 1, dtype=np.int32))
        assert (rows[:, :full].T.reshape(-1) == np.arange(1, full * steps + 1)).all()
        assert (rows[:-1, full:].T.reshape(-1) == np.arange(full * steps + 1, n + 1)).all() and not rows[-1, full:].any()


def test_damage_is_noticed():
    block = range_coder.encode(np.arange(500) % 37, 40)
    for at in (4, 9, 13, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode(bytes(broken), 40)


def test_words_follow_the_library():
    texts = ["a  b\n\n c's 'll I'LL", "½²x 日本 ​\x85\xa0é", "<|endoftext|>x<|endoftext|>", "x" * 5000, "é́ 12,5% ʼn"]
    known, split = Words(PATH, 3), _splitter(PATH)
    assert [known.of(split(t)).tolist() + [2] for t in texts] == library(texts)


@pytest.mark.parametrize("block", [range_coder.BLOCK, 1000])
def test_round_trip(spark, make, monkeypatch, block):
    monkeypatch.setattr(range_coder, "BLOCK", block)
    rows = [(97 * k % 201 - 100, " ".join(f"w{j * k % 31}" for j in range(k * 7 % 250))) for k in range(200)] + [(500, "long " * 6000), (501, None), (502, "")]
    rows.sort()
    files = token_files.write(make([(i, t, "en", "s") for i, t in rows], parts=5), PATH)
    got = sorted(map(tuple, token_files.digests(files).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    whole = [r["ids"] for r in token_files.read(files).orderBy("start").collect()]
    assert whole == library([t for _, t in rows])


def test_odd_rows(odd):
    files = token_files.write(odd, PATH)
    got = sorted(map(tuple, token_files.digests(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == expected(rows)


def test_no_documents(nothing):
    files = token_files.write(nothing, PATH)
    assert files.count() == 0 and token_files.digests(files).count() == 0 and token_files.read(files).count() == 0


def test_only_listed_files_are_read_and_cut_files_noticed(make, tmp_path):
    files = token_files.write(make([(k, f"text {k}", "en", "s") for k in range(50)]), PATH, folder=tmp_path.as_uri())
    (tmp_path / "part-000000-of-a-lost-attempt.ids").write_bytes(b"half a file")
    assert token_files.digests(files).count() == 50
    store, path = fs.FileSystem.from_uri(files.first()["file"])
    with store.open_input_stream(path) as data:
        content = data.read()
    for cut in (content[:-1], content[: token_files._HEAD.size], b"another" + content[7:]):
        with store.open_output_stream(path) as out:
            out.write(cut)
        with pytest.raises(Exception, match="damaged file|not a file"):
            token_files.digests(files).collect()


def test_query_against_the_library(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    got = sorted(map(tuple, QUERIES["op13_token_files"](spark, sf).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_ascii_text_is_split_in_one_pass(monkeypatch):
    """Nothing is searched for in a text known to be plain, and the one pass finds the words of the public pattern."""
    import random

    import regex

    from gristmill.llm import bpe_codec

    find, _ = bpe_codec._low_splitter()

    def searched(text):
        raise AssertionError("searched")

    bpe_codec._splitter.cache_clear()
    monkeypatch.setattr(bpe_codec, "_low_splitter", lambda: (find, searched))
    split = bpe_codec._splitter(PATH)
    draw = random.Random(3)
    texts = ["".join(draw.choice(" \t\n  aB9_'ts'llre.!\x1c\x0b") for _ in range(60)) for _ in range(500)]
    try:
        assert all(split(t) == regex.findall(bpe_codec.SPLIT, t) for t in texts)
    finally:
        bpe_codec._splitter.cache_clear()
    texts = ["".join(draw.choice(" \n\x85\xa0ǅé½²ªaB9'") for _ in range(60)) for _ in range(500)]
    assert all(find(t) == regex.findall(bpe_codec.SPLIT, t) for t in texts)


@pytest.mark.parametrize("n", [1, 2, 127, 129, 1000])
def test_lanes_are_cut_without_places(n, monkeypatch):
    monkeypatch.setattr(range_coder, "LANES", 7)
    monkeypatch.setattr(range_coder, "LANE", 20)
    ids = np.arange(1, n + 1, dtype=np.int32)
    lanes, steps, full = range_coder.lanes_of(n)
    rows = range_coder.rows_of(ids)
    cut = [rows[: steps if lane < full else steps - 1, lane] for lane in range(lanes)]
    assert (np.concatenate(cut) == ids).all() and (rows[-1, full:] == 0).all()
