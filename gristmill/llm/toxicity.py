"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the hits' context windows.

*Lexicon.*  From labelled rows: words, and word beginnings (stems, for inflected terms), that documents labelled toxic
hold far more often than others.  Counts are taken by tasks; the lexicon has at most ``terms`` entries.

*Matching.*  A trie of the lexicon and the automaton that allows a term's number of edits are walked together; a state
is the set of (trie node, edits so far), and its successors are worked out once, so a word costs a step a letter and
most words end after a few.  Letters that stand for others (``1d10t``) count as those.

An edited hit counts ``EDITED`` of the term's weight; a word that many clean documents hold is no edit of a term, and
terms of 4 and 5 letters allow an edit of whole words with the same first letter only.

*Context.*  Every hit gets the sum of the hits around it, less the more it looks quoted: quotation marks that open
before and close after it, or a word that reports speech beside it.  A logistic regression over a document's hits so
weighed gives the score.

Words are what stands between blanks, without marks at the ends; where marks join several, each is a word.  Terms have 3
to 40 letters; a shorter word is never one, a longer one may still begin with a stem.

Learning uses at most ``each[label]`` rows of a label; everything else is over all rows and whole texts.

Defined results: null, empty and blank texts have no hits, hence the lowest score; without labelled rows of both
kinds the lexicon is empty and every score is the share of toxic labels (0.5 without labels); repeated rows get a row
each and null ids are rows like any other; a text of any length is scored whole, word by word; further columns are ignored
(``without_toxic`` keeps all columns and, of an empty table, none of its rows).
"""

from __future__ import annotations

import math
import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import crc_mod, crc_of, map_batches, sample_by, slices, texts_of, tidy
from gristmill.session import stage

EACH, TERMS = {1: 4000, 0: 16000}, 2000
# A unit needs so many toxic documents and such a ratio of rates to enter the lexicon; and its counts must be so
# unlikely by chance that one such unit at most is expected among all.
LEAST_DOCS, LEAST_RATIO = 5, 20.0
STEMS = (4, 5, 6, 7)
WINDOW = 8
# What an edited hit counts of an exact one, the shortest term with an edit, and the clean documents that make a word
# ordinary.
EDITED, SHORT, ORDINARY_DOCS = 0.7, 4, 2
# Letters that others stand for, marks, words that report speech.
SIGNS = str.maketrans("013457@$", "oieastas")
EDGES = ".,;:!?%#&*+=|~^_/\\()[]{}<>…-"
MARKS = "\"'`“”„«»‘’‹›"
REPORTS = frozenset(
    "said says say quote quoted quotes called wrote writes word term sagte sagt wort zitat dit mot cite dijo dice palabra cita".split()
)


def words_in(text: str) -> list[str]:
    return text.lower().split()


def core(word: str) -> str:
    """A word without marks and signs at its ends."""
    return word.strip(EDGES + MARKS)


# Marks between letters; those that stand for letters and apostrophes are not.
JOINTS = re.compile(r"[^\w'’@$]+|_+")


def pieces_of(word: str) -> list[str]:
    """The words that marks inside a ``core`` join (``one,two``, ``one...two``, ``one-two``); none for a plain word."""
    return [] if word.isalnum() else [p for p in map(core, JOINTS.split(word)) if len(p) > 2 and p != word]


class Matcher:
    """The product automaton of a trie and the edits its terms allow; states are made when first reached.

    ``lexicon``: (term, is_stem, weight).  A stem matches when a word begins with it.  Terms of at least ``long``
    letters allow one edit; shorter ones from ``short`` letters on do if the whole word is the edited term and has its
    first letter; others none.  ``ordinary`` words are never edited terms.
    """

    def __init__(self, lexicon: list[tuple[str, bool, float]], long: int = 6, short: int | None = None, ordinary: frozenset = frozenset()):
        self.short, self.ordinary = long if short is None else short, ordinary
        self.children: list[dict[str, int]] = [{}]
        self.allow, self.word, self.stem = [0], [0.0], [0.0]
        for term, is_stem, weight in lexicon:
            node, edits = 0, int(len(term) >= min(long, self.short))
            self.allow[0] = max(self.allow[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.allow.append(0)
                    self.word.append(0.0)
                    self.stem.append(0.0)
                node = self.children[node][letter]
                self.allow[node] = max(self.allow[node], edits)
            kept = self.stem if is_stem else self.word
            kept[node] = max(kept[node], weight)
        self.long = long
        self.depth, self.first = [0] * len(self.children), [""] * len(self.children)
        for node, down in enumerate(self.children):
            for letter, child in down.items():
                self.depth[child] = self.depth[node] + 1
                self.first[child] = self.first[node] or letter
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.value: list[tuple[tuple[float, float], tuple[float, float], dict[str, float]]] = []
        self.start = self._state({(0, 0)})
        self.known: dict[str, tuple[float, float]] = {}

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The state of these pairs and of what a skipped letter of a term adds."""
        pairs = {(n, e) for n, e in pairs if e <= self.allow[n]}
        for n, e in list(pairs):
            pairs |= {(c, e + 1) for c in self.children[n].values() if e + 1 <= self.allow[c]}
        key = frozenset(pairs)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.value.append((self._best(key, self.word), self._best(key, self.stem), self._best_short(key)))
        return self.ids[key]

    def _best(self, pairs: frozenset, weights: list[float]) -> tuple[float, float]:
        """The largest weight without and with an edit; an edited match needs a long term."""
        exact = max((weights[n] for n, e in pairs if e == 0), default=0.0)
        near = max((weights[n] for n, e in pairs if e > 0 and self.depth[n] >= self.long), default=0.0)
        return exact, near

    def _best_short(self, pairs: frozenset) -> dict[str, float]:
        """The largest weight of short terms with an edit, by their first letter."""
        out: dict[str, float] = {}
        for n, e in pairs:
            if e > 0 and self.short <= self.depth[n] < self.long and (weight := max(self.word[n], self.stem[n])):
                out[self.first[n]] = max(out.get(self.first[n], 0.0), weight)
        return out

    def _step(self, state: int, letter: str) -> int:
        to = set()
        for n, e in self.sets[state]:
            if (c := self.children[n].get(letter)) is not None:
                to.add((c, e))
            if e < self.allow[n]:
                to.add((n, e + 1))
                to |= {(c, e + 1) for c in self.children[n].values()}
        found = self.next[state][letter] = self._state(to) if to else -1
        return found

    def match(self, word: str) -> tuple[float, float]:
        """The weight of the best match without an edit, and with one."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 150_000:
                self.known.clear()
            found = max(self._walk(word), self._walk(word.translate(SIGNS)))
            if word in self.ordinary:
                found = (found[0], 0.0)
            found = self.known[word] = found if any(found) else NO_MATCH
        return found

    def _walk(self, word: str) -> tuple[float, float]:
        state, exact, near = self.start, 0.0, 0.0
        for letter in word:
            state = self.next[state].get(letter) if letter in self.next[state] else self._step(state, letter)
            if state < 0:
                return exact, near
            one, two = self.value[state][1]
            exact, near = max(exact, one), max(near, two)
        one, two = self.value[state][0]
        return max(exact, one), max(near, two, self.value[state][2].get(word[:1], 0.0))


@lru_cache(2)
def _matcher(lexicon: tuple, ordinary: frozenset = frozenset()) -> Matcher:
    return Matcher(list(lexicon), short=SHORT, ordinary=ordinary)


def quoted(words: list[str], at: int) -> float:
    """How much the word looks quoted: 0 to 1."""
    lo, hi = max(0, at - WINDOW), min(len(words), at + WINDOW + 1)
    opens = any(w[0] in MARKS for w in words[lo : at + 1] if w)
    closes = any(w.rstrip(EDGES)[-1:] in MARKS for w in words[at:hi] if w.rstrip(EDGES))
    reports = any(core(w) in REPORTS for w in words[max(0, at - 3) : at])
    return min(1.0, 0.7 * (opens and closes) + 0.4 * reports)


N_FEATURES = 5
NO_MATCH = (0.0, 0.0)


def features(text: str, matcher: Matcher) -> list[float]:
    """Of the hits in a text: weight, number, strongest window, quoted ones, share of words."""
    words = words_in(text)
    hits = []
    for at, word in enumerate(words):
        if len(word) > 2:
            whole = core(word)
            found = [matcher.match(whole)]
            # Joined words count one by one, unless what they make together is a term (``id*ot`` is an edit of one).
            if not found[0][0] and (pieces := [m for p in pieces_of(whole) if any(m := matcher.match(p))]):
                found = pieces
            hits += [(at, exact, near) for exact, near in found if exact or near]
    if not hits:
        return [0.0] * N_FEATURES
    number, in_quotes = 0.0, 0.0
    values = []
    for at, exact, near in hits:
        q = quoted(words, at)
        in_quotes += q
        number += 1.0 if exact else EDITED
        values.append((1 - q) * (exact or EDITED * near))
    places = np.array([h[0] for h in hits])
    values = np.array(values)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    around = sums[np.searchsorted(places, places + WINDOW, "right")] - sums[np.searchsorted(places, places - WINDOW)]
    weight, strongest = float(values.sum()), float((values + 0.5 * (around - values)).max())
    return [math.log1p(weight), math.log1p(number), strongest, math.log1p(in_quotes), number / len(words)]


def lexicon_of(sample: DataFrame, terms: int = TERMS) -> tuple[list[tuple[str, bool, float]], frozenset]:
    """(term, is_stem, weight) from ``text``, ``label``, and ordinary words that an edit makes a term; the counts are
    made by tasks and only likely terms and words beside them come back."""

    def step(piece):
        units, labels = [], []
        for text, label in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist()):
            cores = {core(w) for w in set(words_in(text))}
            words = {c for c in cores.union(*map(pieces_of, cores)) if 2 < len(c) <= 40}
            own = {"=" + w for w in words} | {"^" + w[:k] for w in words for k in STEMS if len(w) >= k}
            units += own
            labels += [label] * len(own)
        yield {"unit": units, "label": labels}

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return [], frozenset()
    units = map_batches(sample, "unit string, label int", step).groupBy("unit").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("c")
    )
    every = stage(units, "units")
    units = every.where(F.col("t") > 0)
    share, n_units = n_toxic / (n_toxic + n_clean), max(2, units.count())
    ratio = (F.col("t") + 0.5) / (F.col("c") + 0.5) * (n_clean + 1.0) / (n_toxic + 1.0)
    n, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    # The log of how unlikely t of n documents are to be toxic when each is with the sample's share (Chernoff's bound).
    surprise = t * F.log(t / n / share) + F.when(c > 0, c * F.log(c / n / (1 - share))).otherwise(F.lit(0.0))
    likely = units.withColumn("ratio", ratio).where((t >= LEAST_DOCS) & (F.col("ratio") >= LEAST_RATIO) & (surprise >= math.log(n_units)))
    rows = likely.orderBy(F.desc(F.col("t") * F.log("ratio")), "unit").limit(2 * terms).collect()
    words = {r["unit"][1:]: r for r in rows if r["unit"][0] == "="}
    stems = {r["unit"][1:]: r for r in rows if r["unit"][0] == "^"}
    out, used = [], set()
    for stem, r in stems.items():
        longer = max((x["t"] for s, x in stems.items() if len(s) == len(stem) + 1 and s.startswith(stem)), default=0)
        word = words.get(stem)
        shorter = stems.get(stem[:-1])
        if word and word["t"] >= 0.9 * r["t"]:
            continue  # the word itself
        if longer >= 0.9 * r["t"] or (shorter and shorter["t"] > r["t"] / 0.9 and len(stem) > min(STEMS)):
            continue  # as common with a letter more, or a part of a stem that is kept
        if any(w.startswith(stem) and x["t"] >= 0.9 * r["t"] for w, x in words.items()):
            continue
        out.append((stem, True, math.log(r["ratio"])))
        used.add(stem)
    for word, r in words.items():
        if not any(word[:k] in used for k in STEMS):
            out.append((word, False, math.log(r["ratio"])))
    lexicon = sorted(out, key=lambda x: (-x[2], x[0]))[:terms]
    common = every.where(F.col("unit").startswith("=") & (c >= ORDINARY_DOCS) & (ratio < LEAST_RATIO)).select(F.expr("substring(unit, 2)").alias("text"))

    def beside(piece):
        matcher = _matcher(tuple(lexicon))
        yield {"word": [w for w in piece.column("text").to_pylist() if matcher.match(w)[1] and not matcher.match(w)[0]]}

    return lexicon, frozenset(r["word"] for r in map_batches(common, "word string", beside).collect())


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept last) by Newton's method; classes count so that the mean label is ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = y.mean()
    each = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) / len(y)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge / 100)
    penalty[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + penalty * w
        step = np.linalg.solve((x.T * (each * p * (1 - p))) @ x + np.diag(penalty + 1e-12), grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    def __init__(self, lexicon: tuple, weights: np.ndarray, ordinary: frozenset = frozenset()):
        self.lexicon, self.weights, self.ordinary = lexicon, weights, ordinary

    def score(self, text: str) -> float:
        return self.score_features(features(text, _matcher(self.lexicon, self.ordinary)))

    def score_features(self, x: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights[:-1], x) + self.weights[-1], -30, 30))))


def training_labels(labels: DataFrame, label: str, folds: int, out: int) -> DataFrame:
    """``doc_id``, ``label`` once for every labelled id outside the fold ``out``."""
    labels = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != out))
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def label_counts(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int) -> dict[int, int]:
    """How many rows of ``docs`` outside the fold ``out`` have label 0 and 1."""
    rows = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(training_labels(labels, label, folds, out), "doc_id").groupBy("label").agg(F.sum("n").alias("n"))
    return {0: 0, 1: 0} | {r["label"]: r["n"] for r in rows.collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, each: dict[int, int]) -> DataFrame:
    """``text``, ``label`` of at most about ``each[label]`` ids of a label, one row an id, none from the fold ``out``.

    Labels are sampled first; that many ids have a known size and go to the texts, which don't travel.
    """
    labels = training_labels(labels, label, folds, out)
    kinds = [sample_by(labels.where(F.col("label") == kind), "label", most) for kind, most in each.items()]
    chosen = reduce(DataFrame.union, kinds)
    found = texts_of(docs).join(F.broadcast(chosen), "doc_id")
    return stage(one_row_an_id(found, "text", "label").select("text", "label"), "sample")


def one_row_an_id(rows: DataFrame, *columns: str) -> DataFrame:
    """Of rows that share an id the least; however many there are, tasks keep one each before anything moves."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("least")).select("doc_id", "least.*")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, each: dict[int, int] = EACH, terms: int = TERMS) -> Model:
    sample = labelled_sample(docs, labels, "toxic", folds, out, each)
    lexicon, ordinary = lexicon_of(sample, terms)
    lexicon = tuple(lexicon)
    counts = labels.where(crc_mod(F.col("doc_id"), folds) != out).agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()
    prior = min(max(counts["p"] if counts["p"] is not None else 0.5, 1e-4), 1 - 1e-4)

    def step(piece):
        matcher = _matcher(lexicon, ordinary)
        rows = [features(t, matcher) for t in piece.column("text").to_pylist()]
        yield {"x": pa.array(rows, pa.list_(pa.float64())), "y": piece.column("label")}

    rows = map_batches(sample, "x array<double>, y int", step).collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, np.array([0.0] * N_FEATURES + [math.log(prior / (1 - prior))]), ordinary)
    return Model(lexicon, logistic(np.array([r["x"] for r in rows]), y, prior), ordinary)


def scored(docs: DataFrame, model: Model, folds: int = 5, out: int = 0) -> DataFrame:
    def step(piece):
        ids = piece.column("doc_id").to_pylist()
        scores = np.array([model.score(t) for t in piece.column("text").to_pylist()])
        yield {"doc_id": ids, "held_out": crc_of(ids, folds) == out, "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    return map_batches(texts_of(docs), "doc_id long, held_out boolean, score double, predicted int", step)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic."""

    @tidy
    def run(batches):
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            for piece in slices(batch):
                keep = [model.score(t or "") < 0.5 for t in piece.column(at).to_pylist()]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
