"""Personal data, byte-pair encoding and the pipeline against brute force and defined cases."""

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gristmill.llm import bpe_codec, common, sanitize
from gristmill.llm.queries import tokenizer_path

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) for c in digits]
            doubled[-2::-2] = [d * 2 - 9 * (d > 4) for d in doubled[-2::-2]]
            fits = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_spans_match_the_patterns():
    rng = random.Random(7)
    for _ in range(30_000):
        text = "".join(rng.choices("ab1290.@ -+()%,2é", k=rng.randint(0, 40)))
        assert sanitize.base_spans(text) == plain_spans(text), text
    assert sanitize.base_spans("4111 1111 1111 1111 and 4111 1111 1111 1112") == [("card", 0, 19)]


def test_span_digests(odd, nothing, make):
    texts = [(20, "mail a.b@c.de, call +1 (555) 123-4567 from 10.0.0.1"), (21, "é" * 5 + " x@y.zz")]
    docs = odd.union(make([(i, t, "en", "s") for i, t in texts]))
    rows = sanitize.span_digests(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i, t in texts + [(1, ""), (2, ""), (6, "one two")]:
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t))
        assert by[i]["spans"] == listed and by[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert (by[20]["n_email"], by[20]["n_ip"], by[20]["n_card"], by[20]["n_phone"]) == (1, 1, 0, 1)
    assert sanitize.span_digests(nothing).count() == 0


def test_terms_that_disclose_an_entity(make):
    rng = random.Random(1)
    common = [f"word{chr(97 + k)}" for k in range(26)]

    def filler():
        return " ".join(rng.choices(common, k=6))

    rows = [f"{filler()} manager Zyxwvut reached at z@corp.example today {filler()}" for _ in range(4)]
    rows += [f"{filler()} office {filler()} q{k}@corp.example {filler()}" for k in range(4)]
    rows += [f"{filler()} reached manager {filler()}" for _ in range(60)]
    # A text that is copied counts as one context.
    rows += ["Abcdefg sits beside copy@corp.example always"] * 6
    docs = make([(k, t, "en", "s") for k, t in enumerate(rows)])
    got = {r["doc_id"]: r for r in sanitize.sanitized(docs).collect()}
    for k in range(4):
        assert "Zyxwvut" not in got[k]["text"] and "[EMAIL]" in got[k]["text"] and "manager" in got[k]["text"]
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert all(got[k]["text"] == rows[k] for k in range(8, 68))
    assert all(got[k]["text"] == "Abcdefg sits beside [EMAIL] always" for k in range(68, 74))
    spans = {r["doc_id"]: r["spans"] for r in sanitize.span_digests(docs).collect()}
    start = rows[0].index("Zyxwvut")
    assert f"term:{start}:{start + 7}" in spans[0] and "term" not in spans[70]


def test_terms_beside_an_entity_that_occurs_once(make):
    rng = random.Random(2)
    common = [f"word{chr(97 + k)}" for k in range(26)]
    rows = [" ".join(rng.choices(common, k=12)) for _ in range(120)]
    rows[3] = f"{rows[3]} manager Qwertz reached at solo@corp.example {rows[4]}"
    rows[5:9] = [f"{r} manager reached" for r in rows[5:9]]
    docs = make([(k, t, "en", "s") for k, t in enumerate(rows)])
    got = {r["doc_id"]: r["text"] for r in sanitize.sanitized(docs).collect()}
    assert "Qwertz" not in got[3] and "solo" not in got[3] and "manager" in got[3]
    assert all(got[k] == rows[k] for k in range(120) if k != 3)


def test_a_task_has_one_worker(make):
    """Two functions on end in one stage are two workers for each core, which then stay in an executor's memory."""
    docs = make([(1, "mail a.b@c.de", "en", "s"), (2, "no entity", "en", "s")])
    plan = sanitize.sanitized(docs)._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"MapInArrow|Exchange|Scan", plan)
    assert nodes.count("MapInArrow") == 3
    assert all(pair != ("MapInArrow", "MapInArrow") for pair in zip(nodes, nodes[1:])), plan


def test_a_slice_takes_little_memory():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(500)) for _ in range(320)]
    size, split = sum(map(len, texts)), bpe_codec._splitter(tokenizer_path())

    def peak(work):
        work()  # what is made once and kept
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / size

    assert peak(lambda: bpe_codec.distinct_of(texts, split)) < 4
    sizes, coded = bpe_codec.distinct_of(texts, split)
    assert coded.to_pylist() == [w for t in texts for w in split(t)] and sizes.tolist() == [len(split(t)) for t in texts]
    column = pa.array(texts)
    assert peak(lambda: common.words_of(column)) < 22
    assert common.powers(common.CHUNK_BYTES + 4000)[0].nbytes < 10 * common.CHUNK_BYTES


def test_overlapping_spans_are_masked_once():
    assert sanitize.masked("a 1.2.3.4 b", [("ip", 2, 9), ("card", 2, 5)], {}, 0.9) == "a [IP] b"
    assert sanitize.masked("a Term b", [("term", 2, 6)], {"term": 0.95}, 0.9) == "a  b"
    assert sanitize.masked("a Term b", [("term", 2, 6)], {"term": 0.85}, 0.9) == "a [TERM] b"


@pytest.mark.parametrize("most", [3, bpe_codec.FREQUENT_WORDS])
def test_ids_are_the_librarys(odd, nothing, make, most):
    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    rng = random.Random(4)
    letters = ["a", "B", "é", "中", "1", "²", " ", "  ", "\n", "\t", "'s", "'ll", "!", "…", " ", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "ß", "́"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(300)] + ["the same words " * 20] * 3
    docs = odd.union(make([(100 + k, t, "en", "s") for k, t in enumerate(texts)]))
    got = {r["doc_id"]: r for r in bpe_codec.digests(docs, tokenizer_path(), most).collect()}
    assert len(got) == len(texts) + 10
    for row in docs.select("doc_id", "text").collect():
        ids = tok.encode(row["text"] or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        r = got[row["doc_id"]]
        assert r["n_tokens"] == len(ids), row["text"][:50]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_codec.digests(nothing, tokenizer_path(), most).count() == 0


def test_ids_and_texts(make):
    docs = make([(1, "Hello world", "en", "s")])
    row = bpe_codec.token_ids(docs, tokenizer_path()).first()
    assert row["decoded"] == "Hello world" and row["ids"] == Tokenizer.from_file(tokenizer_path()).encode("Hello world").ids


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = [f"wo{chr(97 + k)}{chr(98 + k % 20)}" for k in range(25)]
    rows, labels = [], []
    for k in range(160):
        text = [rng.choice(words) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            text[3] = text[9] = text[20] = rng.choice(["dolt", "cretin"])
        rows.append((k, " ".join(text), "en", f"s{k % 3}", 0))
        labels.append((k, 1, int(toxic)))
    rows += [(200, rows[1][1], "en", "s1", 0), (201, rows[1][1] + " end", "en", "s1", 0), (202, None, None, None, None), (203, "write to me@home.example now", "en", "s0", 0)]
    rows.append(rows[2])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "bpe"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns or name == "bpe"
        kept.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    clean = {str(k) for k in range(160) if k % 5} | {"200", "201", "202", "203"}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - {"200", "201"} and len(kept[1]) == len(set(kept[1]))
    assert kept[2] == kept[1]
    assert "[EMAIL]" in spark.read.parquet(f"{tmp_path}/2").where("doc_id = 203").first()["text"]
    assert set(kept[3]) <= set(kept[2]) and all(kept[3].count(d) <= 2 for d in set(kept[3])) and kept[4] == kept[3]
    words_in, words_out = 40 * len(kept[2]), 40 * len(kept[3])
    assert 1.4 * words_in < words_out < 1.6 * words_in
