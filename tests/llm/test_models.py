"""Language id, toxicity, quality and language model: accuracy on other rows, brute force, defined cases."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import language_id, lm_score, quality_gam, toxicity
from gristmill.llm.ngram_trie import EliasFano, Trie, quantised

SYLLABLES = {"aa": "ba be bi bo bu da de di".split(), "bb": "škr ště žlu řek čas dne tří".split(), "cc": "lo ka ti mo ne ra su vi".split()}
INSULTS = "numbskull blockhead dunderhead".split()


def held(doc, folds, out):
    return zlib.crc32(str(doc).encode()) % folds == out


def sentences(seed, n, lang, low=8, high=40):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4))) for _ in range(rng.randint(low, high))).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(make):
    rows = []
    for lang in SYLLABLES:
        rows += [(t, lang) for t in sentences(lang, 60, lang)]
    random.Random(1).shuffle(rows)
    return make([(k, t, lang, "s") for k, (t, lang) in enumerate(rows)])


def test_language_of_other_rows(corpus, odd, nothing):
    net = language_id.train(corpus)
    rows = language_id.predicted(corpus, net).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    others = [r for r in rows if r["held_out"]]
    assert len(others) > 20 and all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in others) >= 0.95 * len(others)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predicted(odd, net).collect()}
    assert got[1] == ("und", 0.0) and got[2] == ("und", 0.0) and got[3] == ("und", 0.0)
    assert all(0 < s <= 1 and p in SYLLABLES for i, (p, s) in got.items() if i not in (1, 2, 3))
    assert language_id.predicted(nothing, net).count() == 0
    assert language_id.train(nothing) is None
    assert {r["lang_pred"] for r in language_id.predicted(odd, None).collect()} == {"und"}


def test_windows_read_the_whole_text():
    net = language_id.Network(["x", "y"], hidden=4)
    long_text = " ".join(sentences(3, 40, "aa"))
    whole = net.pooled(pa.array([long_text, "q", ""]))
    data = np.frombuffer(long_text.lower().encode(), np.uint8)[:, None].copy()
    logits = net.logits(data, 0, len(data))
    prob = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    mask = language_id._LETTER[data]
    want = (prob * mask[:, None, :]).sum(axis=(0, 2)) / mask.sum()
    assert np.abs(whole[0] - want).max() < 0.02 and whole[2].sum() == 0


def test_gradients_agree_with_differences():
    net = language_id.Network(["x", "y", "z"], hidden=3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    data = np.random.default_rng(0).integers(97, 105, (9, 4)).astype(np.uint8)
    y, mask = np.array([0, 1, 2, 1]), np.ones((9, 4))
    grads, _ = net.gradients(data, y, mask)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[name][at]
        losses = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            losses.append(net.gradients(data, y, mask)[1])
        net.p[name][at] = old
        assert math.isclose((losses[0] - losses[1]) / 2e-3, g[at], rel_tol=0.02)


@pytest.fixture(scope="module")
def labelled(make, spark):
    rng, rows, labels = random.Random(6), [], []
    for k, text in enumerate(sentences("tox", 240, "aa", 15, 40)):
        toxic = k % 4 == 0
        words = text.split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(1, len(words)), rng.choice(INSULTS))
        good = k % 3 != 0
        if not good:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, int(good), int(toxic)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents(labelled, odd, nothing, make):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.scored(docs, model).collect()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in rows)
    assert all(r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"])
    plain = "bebidi dibubo dadedi bobida "
    cases = {
        "misspelled": plain + "numbskul and a blokhead and a dunderheat " + plain, "abuse": plain + "you numbskull blockhead " + plain,
        "quoted": plain + 'he said "numbskull" once ' + plain, "clean": plain * 3,
    }
    score = {k: model.score(t) for k, t in cases.items()}
    assert score["abuse"] > 0.5 > score["clean"] and score["clean"] < score["quoted"] < score["abuse"] and score["misspelled"] > score["clean"]
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)
    assert toxicity.scored(nothing, model).count() == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not t for t in truth.values())
    empty = toxicity.train(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in toxicity.scored(odd, empty).collect()} == {0.5}


def test_misspelled_insults_are_toxic(make, spark):
    insults, rng = "numbskull trash idiot scum".split(), random.Random(8)
    rows, labels = [], []
    for k, text in enumerate(sentences("mis", 240, "aa", 15, 40)):
        words = text.split() + ["scub", "idiom"][: int(k % 4 > 0) * 2]
        for _ in range(3 if k % 4 == 0 else 0):
            words.insert(rng.randrange(1, len(words)), rng.choice(insults))
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, int(k % 4 == 0)))
    model = toxicity.train(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    plain = "bebidi dibubo dadedi bobida "
    for words in ("numbskul", "trassh", "idiott", "scumm"):
        assert model.score(plain + f"{words} and {words} or {words} " + plain) >= 0.5, words
    # Other first letters, a stem with more than an edit, ordinary words.
    assert all(model.score(plain + f"{w} and {w} or {w} " + plain) < 0.5 for w in ("brash", "adiot", "scrumming", "scub", "idiom"))


def test_words_that_marks_join_count_one_by_one():
    matcher = toxicity.Matcher([("idiot", False, 2.0), ("moron", False, 2.0)], short=4)
    for text, n in (("you idiot,moron here", 2), ("idiot...moron", 2), ("idiot/clown", 1), ("idiot-like, they said", 1), ("(idiot)_(moron)", 2), ("a well-known e.g. 3.5 x", 0)):
        assert toxicity.features(text, matcher)[1] == pytest.approx(np.log1p(n)), text
    # What marks stand for a letter in is one misspelled word.
    assert toxicity.features("id*ot", matcher)[1] == pytest.approx(np.log1p(toxicity.EDITED))
    assert toxicity.pieces_of("don't") == toxicity.pieces_of("plain") == [] and toxicity.pieces_of("one--two.three") == ["one", "two", "three"]


def test_matcher_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(3)
    lexicon = ["abcabc", "abcdef", "bcacb", "fedcba", "aabbcc"]
    matcher = toxicity.Matcher([(w, False, 1.0) for w in lexicon])
    for _ in range(3000):
        word = "".join(rng.choices("abcdef", k=rng.randint(3, 8))) if rng.random() < 0.5 else rng.choice(lexicon)
        if rng.random() < 0.7:
            k = rng.randrange(len(word))
            word = word[:k] + rng.choice(["", rng.choice("abcdef"), word[k] + rng.choice("abcdef")]) + word[k + 1 :]
        exact, near = matcher._walk(word)
        assert (exact > 0) == (word in lexicon), word
        if not exact:
            assert (near > 0) == any(len(t) >= 6 and distance(word, t) == 1 for t in lexicon), word
    stems = toxicity.Matcher([("numb", True, 1.0), ("dunder", True, 2.0)])
    assert stems.match("numbness")[0] == 1.0 and stems.match("dundirhead")[1] == 2.0 and stems.match("nub") == (0.0, 0.0)


def test_quality_of_other_rows(labelled, odd, nothing):
    docs, labels = labelled
    model = quality_gam.train(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_gam.scored(docs, model).collect()
    assert all(r["predicted"] == truth[r["doc_id"]] == (r["score"] >= 0.7) for r in rows if r["held_out"])
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    got = quality_gam.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_gam.scored(nothing, model).count() == 0
    none = quality_gam.train(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in quality_gam.scored(odd, none).collect()} == {0.5}
    one = quality_gam.train(docs, labels.where("quality = 1"))
    assert {r["predicted"] for r in quality_gam.scored(odd, one).collect()} == {1}


def test_quality_share_does_not_depend_on_the_sample(labelled, spark):
    docs, _ = labelled
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(240)], "doc_id long, quality int")
    good = [k % 10 > 0 for k in range(240) if not held(k, 4, 2)]
    natural = sum(good) / len(good)
    for each in (1, quality_gam.EACH):
        model = quality_gam.train(docs, labels, each=each)
        assert math.isclose(1 / (1 + math.exp(-model.base)), natural, abs_tol=1e-6)


def test_interactions_are_learned():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit(x, y, np.ones(len(y)))
    assert ((model.margin(x) > 0) == y).mean() > 0.9 and (1, 0) in {(i, j) for i, j, _ in model.pairs}


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 9), (700, 1 << 63), (3000, 500), (2000, 2**64 - 1)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        level = EliasFano.of(values)
        assert (level[np.arange(n)] == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (level.successor(asked) == np.searchsorted(values, asked)).all()


def test_levels_are_read_in_order_for_many_look_ups(monkeypatch):
    """Elements read one after the other are those found one by one, and look-ups of many keys do no search a key."""
    rng = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 9), (64, 64), (700, 1 << 63), (3000, 500), (2000, 2**64 - 1)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        level = EliasFano.of(values)
        assert (level.values() == values).all()
        asked = np.concatenate([values[::3], rng.integers(0, top, 500 + n, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at = np.searchsorted(values, asked)
        expected = [int(k) if k < n and values[k] == x else -1 for k, x in zip(at, asked)]
        few = [int(level.find(asked[k : k + 1])[0]) for k in range(0, len(asked), 50)]
        with monkeypatch.context() as patch:
            if n:
                patch.setattr(EliasFano, "successor", None)
            assert level.find(asked).tolist() == expected
            patch.setattr(EliasFano, "_place", None)
            if n:
                assert (level.take(np.arange(n)) == values).all()
        assert few == expected[::50]


def test_trie_in_mapped_memory():
    contexts, words = np.array([3, 9, 20], np.uint64), np.array([1, 5, 7], np.uint64)
    trie = Trie(contexts, np.array([-1.0, -2.0, -3.0]), words, np.array([0, 0, 2]), np.array([0, 2, 1]), np.array([-0.1, -0.2, -0.3])).mapped()
    found, value, _ = trie.look_up(np.array([3, 3, 3, 9, 20, 4], np.uint64), np.array([1, 7, 5, 1, 5, 1], np.uint64))
    assert found.tolist() == [True, True, False, False, True, False]
    assert np.allclose(value, [-0.1, -0.2, -1.0, -2.0, -0.3, 0.0])
    code, levels = quantised(np.linspace(0, 1, 5000))
    assert np.abs(levels[code] - np.linspace(0, 1, 5000)).max() < 0.01


def brute_lm(rows, folds, out):
    import collections
    import re

    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None] for d, t in rows}
    train = [w for d, w in tokens.items() if not held("null" if d is None else d, folds, out)]
    c = collections.Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for ws in train for p in zip(["<s>", *ws], ws))
    whole, distinct = collections.Counter(), collections.Counter()
    for (a, _), k in pairs.items():
        whole[a] += k
        distinct[a] += 1

    def log(a, b):
        if pairs[a, b]:
            return math.log10((pairs[a, b] - 0.75) / whole[a])
        return math.log10(min(1, 0.75 * distinct[a] / whole[a]) if whole[a] else 1) + math.log10((c[b] + 1) / (n + v + 1))

    return {
        d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), sum(map(log, ["<s>", *ws], ws)))
        for d, ws in tokens.items()
    }


def test_scores_match_brute_force(make, monkeypatch):
    # No context is split here: what a split estimates is not the plain count.
    monkeypatch.setattr(lm_score, "SPLIT_SHARE", 1e9)
    monkeypatch.setattr(lm_score, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(lm_score, "PARTS", 1)
    monkeypatch.setattr(lm_score, "_PART", lm_score._PART[:1])
    rows = list(enumerate(sentences("lm", 60, "aa") + sentences("lm", 10, "cc")))
    rows += [(900, None), (901, " \n"), (902, "Baba " * 500), (None, "unseen")]
    got = {r["doc_id"]: r for r in lm_score.scored(make([(i, t, "en", "s") for i, t in rows]), shard_tokens=300).collect()}
    want = brute_lm(rows, 7, 2)
    assert set(got) == set(want)
    for d, (n, known, total, base, score) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total), d
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=0.02, abs_tol=0.02), d


def test_split_contexts_match_brute_force(make, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TEXTS", 7)
    rows = list(enumerate(sentences("lm", 60, "aa") + sentences("lm", 10, "cc")))
    # Frequent contexts with few successors, of which most parts have none, and pairs with them that are new.
    rows += [(k, "copied words of a passage that repeats, copied words again") for k in range(100, 160)]
    rows += [(k, f"copied novel{k} words rare{k} passage again passage") for k in range(160, 200)]
    rows += [(900, None), (901, " \n"), (902, "Baba " * 500), (None, "unseen")]
    got = {r["doc_id"]: r for r in lm_score.scored(make([(i, t, "en", "s") for i, t in rows]), shard_tokens=300).collect()}
    for d, (n, known, total, base, score) in brute_lm(rows, 7, 2).items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total), d
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=0.02, abs_tol=0.02), d


def test_scores_of_odd_rows(odd, nothing):
    rows = lm_score.scored(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] <= 0 and r["n_known"] <= r["n_tokens"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm_score.scored(nothing).count() == 0
    untaught = odd.where("doc_id = 9")
    outside = next(k for k in range(100) if held(k, 7, 2))
    from pyspark.sql import functions as F

    row = lm_score.scored(untaught.withColumn("doc_id", F.lit(outside).cast("long"))).first()
    assert (row["train_tokens"], row["n_known"], row["base_score"], row["score"], row["held_out"]) == (0, 0, 0.0, 0.0, True)


def test_a_labelled_id_that_many_rows_share_is_one_of_the_sample(make, spark):
    rows = [(7, f"text {k} of one id", "en", "s") for k in range(500)] + [(k, f"other {k}", "de", "s") for k in range(100, 120)]
    labels = spark.createDataFrame([(r[0], int(r[0] == 7)) for r in rows[499:]], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(make(rows), labels, "toxic", 1_000_003, 999_999, {0: 1000, 1: 1000}).collect()
    assert sorted(r["text"] for r in sample) == sorted(["text 0 of one id"] + [f"other {k}" for k in range(100, 120)])


def test_lm_packs_bounded_parts(monkeypatch):
    """A block of texts is handed on in parts, and all parts together are its occurrences."""

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    class Task:
        def partitionId(self):
            return 0

    class Split:
        value = np.array([lm_score.START])

    monkeypatch.setattr(lm_score, "TaskContext", type("Context", (), {"get": staticmethod(Task)}))
    texts = [" ".join(f"w{(i * 7919 + k * k) % 50_021}" for k in range(400)) for i in range(2000)]
    run = lm_score.packed(Rows(), 16, Split, 7, 2)
    parts = list(run(iter([pa.record_batch({"doc_id": pa.array(range(2000)), "text": texts})])))
    assert max(p.nbytes for p in parts) < 2 * lm_score.HANDED < sum(p.nbytes for p in parts)
    rows = [r for p in parts for r in p.to_pylist()]
    assert sorted(r["shard"] for r in rows) == list(range(-1, 16))
    assert sum(len(r["doc"]) // 2 for r in rows if r["shard"] >= 0) == 2000 * 401
    assert next(r for r in rows if r["shard"] < 0)["doc_ids"] == list(range(2000))
