"""Text quality by a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins at quantiles of the sample.  Boosting goes round the features in turn: for
each a shallow tree over its bins (``LEAVES`` leaves at most) is fitted to the logistic loss's gradient and added to
the feature's lookup table.  With the tables of single features fixed, the pairs of features whose coarse grids
explain most of the remaining gradient are boosted in the same way, each tree being a cut of both features.  A score
is the sum of the tables' entries at a text's bins.

At most ``each`` labelled rows of either label are learned from; rows of a label weigh so that the labels have the
shares they have among all training rows, whatever the size of the sample.

Defined results: null, empty and blank texts have all features 0 and get what the model says of that; without
labelled rows every score is 0.5, with one kind of label it is that label's smoothed share; repeated rows get a row
each; null ids are rows like any other; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gristmill.llm.common import crc_of, map_batches, texts_of, words_of
from gristmill.llm.toxicity import label_counts, labelled_sample

EACH, BINS, ROUNDS, RATE, LEAVES = 8000, 32, 60, 0.2, 4
PAIRS, PAIR_BINS, PAIR_ROUNDS = 8, 8, 30
RIDGE = 5.0

NAMES = (
    "words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeats_before", "pair_repeats",
    "upper", "digits", "marks", "symbols", "bars", "ends_in_mark", "line_length", "distinct_lines", "non_ascii", "entropy",
)

_CLASS = np.zeros((256, 7), np.float32)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[[ord(c) for c in ".,;:!?'\"()-"], 2] = 1
_CLASS[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"], 3] = 1
_CLASS[ord("|"), 4] = 1
_CLASS[10, 5] = 1
_CLASS[128:, 6] = 1


def features(texts: pa.Array) -> np.ndarray:
    """(texts, features), all finite."""
    n = len(texts)
    code, row, start, end, data = words_of(texts, lower=False)
    out = np.zeros((n, len(NAMES)), np.float64)
    if n == 0 or len(data) == 0:
        return out
    sizes = np.asarray(pc.binary_length(texts.cast(pa.binary())), np.int64)
    of_byte = np.repeat(np.arange(n), sizes)
    per = np.maximum(sizes, 1)
    kinds = np.stack([np.bincount(of_byte, weights=_CLASS[data, k], minlength=n) for k in range(7)], axis=1)
    words = np.bincount(row, minlength=n)
    some = np.maximum(words, 1)
    length = (end - start).astype(np.float64)
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.bincount(row, weights=length, minlength=n) / some
    out[:, 2] = np.bincount(row, weights=length > 12, minlength=n) / some
    out[:, 3] = np.bincount(row, weights=length <= 3, minlength=n) / some
    if len(code):
        order = np.lexsort((code, row))
        c, r = code[order], row[order]
        first = np.ones(len(c), bool)
        first[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(c)))
        out[:, 4] = np.bincount(r[at], minlength=n) / some
        most = np.zeros(n)
        np.maximum.at(most, r[at], times)
        out[:, 5] = most / some
        share = times / some[r[at]]
        out[:, 17] = np.bincount(r[at], weights=-share * np.log(share), minlength=n) / np.log(some + 1.0)
        same_row = row[1:] == row[:-1]
        out[:, 6] = np.bincount(row[1:], weights=same_row & (code[1:] == code[:-1]), minlength=n) / some
        pair = (code[1:] * np.uint64(0x9E3779B97F4A7C15) + code[:-1])[same_row]
        pr = row[1:][same_row]
        order = np.lexsort((pair, pr))
        p, q = pair[order], pr[order]
        again = (p[1:] == p[:-1]) & (q[1:] == q[:-1]) if len(p) else np.empty(0, bool)
        out[:, 7] = np.bincount(q[1:], weights=again, minlength=n) / some
        last = data[end - 1]
        out[:, 13] = np.bincount(row, weights=(_CLASS[last, 2] + _CLASS[last, 3]) > 0, minlength=n) / some
    letters = np.maximum(sizes - kinds[:, 1:6].sum(axis=1), 1)
    out[:, 8] = kinds[:, 0] / letters
    out[:, 9:13] = kinds[:, 1:5] / per[:, None]
    lines = kinds[:, 5] + 1
    out[:, 14] = np.log1p(words / lines)
    out[:, 15] = [len(set(x)) / len(x) if len(x := t.split("\n")) > 1 else 1.0 for t in texts.to_pylist()]
    out[:, 16] = kinds[:, 6] / per
    out[words == 0] = 0
    return out


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin edges: distinct quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(cuts, x.T)], axis=1).astype(np.int32)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of the best tree by greedy cuts of ordered bins."""
    parts = [(0, len(g))]

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        a, b = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        gain = a[:-1] ** 2 / (b[:-1] + RIDGE) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + RIDGE) - a[-1] ** 2 / (b[-1] + RIDGE)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    while len(parts) < leaves:
        (gain, at), part = max(((best(*p), p) for p in parts), key=lambda x: x[0][0])
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of the best cut of both axes (four leaves), and its gain."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    i, j = slice(0, -1), slice(0, -1)

    def gain(x, y):
        return x * x / (y + RIDGE)

    ll_g, ll_h = a[i, j], b[i, j]
    lr_g, lr_h = a[i, -1:] - ll_g, b[i, -1:] - ll_h
    rl_g, rl_h = a[-1:, j] - ll_g, b[-1:, j] - ll_h
    rr_g, rr_h = a[-1, -1] - ll_g - lr_g - rl_g, b[-1, -1] - ll_h - lr_h - rl_h
    total = gain(ll_g, ll_h) + gain(lr_g, lr_h) + gain(rl_g, rl_h) + gain(rr_g, rr_h)
    if total.size == 0:
        return np.zeros_like(g), 0.0
    p, q = np.unravel_index(total.argmax(), total.shape)
    out = np.empty_like(g)
    out[: p + 1, : q + 1] = ll_g[p, q] / (ll_h[p, q] + RIDGE)
    out[: p + 1, q + 1 :] = lr_g[p, q] / (lr_h[p, q] + RIDGE)
    out[p + 1 :, : q + 1] = rl_g[p, q] / (rl_h[p, q] + RIDGE)
    out[p + 1 :, q + 1 :] = rr_g[p, q] / (rr_h[p, q] + RIDGE)
    return out, float(total[p, q])


class Gam:
    def __init__(self, base: float, cuts=(), tables=(), coarse=(), pairs=()):
        self.base, self.cuts, self.tables, self.coarse, self.pairs = base, cuts, tables, coarse, pairs

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.tables:
            bins = binned(x, self.cuts)
            for k, table in enumerate(self.tables):
                out += table[bins[:, k]]
            bins = binned(x, self.coarse)
            for i, j, grid in self.pairs:
                out += grid[bins[:, i], bins[:, j]]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(features(texts)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gam:
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    cuts, coarse = cuts_of(x, BINS), cuts_of(x, PAIR_BINS)
    bins, wide = binned(x, cuts), binned(x, coarse)
    margin = np.full(len(x), base)
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(tables):
            g, h = slopes()
            step = RATE * _tree(*(np.bincount(bins[:, k], weights=s, minlength=len(table)) for s in (g, h)), LEAVES)
            table += step
            margin += step[bins[:, k]]

    def grid_of(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(wide[:, i] * shape[1] + wide[:, j], weights=values, minlength=shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    d = x.shape[1]
    ranked = sorted(((_cross(grid_of(i, j, g), grid_of(i, j, h))[1], i, j) for i in range(d) for j in range(i)), reverse=True)[:PAIRS]
    pairs = [[i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))] for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, grid in pairs:
            g, h = slopes()
            step = RATE * _cross(grid_of(i, j, g), grid_of(i, j, h))[0]
            grid += step
            margin += step[wide[:, i], wide[:, j]]
    return Gam(base, cuts, tables, coarse, pairs)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2, each: int = EACH) -> Gam:
    sample = labelled_sample(docs, labels, "quality", folds, out, {0: each, 1: each})

    def step(piece):
        yield {"x": pa.array(list(features(piece.column("text"))), pa.list_(pa.float64())), "y": piece.column("label")}

    rows = map_batches(sample, "x array<double>, y int", step).toArrow()
    y = rows.column("y").to_numpy().astype(float)
    counts = label_counts(docs, labels, "quality", folds, out)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Gam(float(np.log(share / (1 - share))))
    x = np.array(rows.column("x").to_pylist())
    order = np.lexsort((*x.T, y))
    # Each label's share among all rows over its share of the sample; the weights' mean is 1.
    natural = counts[1] / (counts[0] + counts[1])
    weight = np.where(y == 1, natural / y.mean(), (1 - natural) / (1 - y.mean()))
    return fit(x[order], y[order], weight[order])


def scored(docs: DataFrame, model: Gam, folds: int = 4, out: int = 2) -> DataFrame:
    def step(piece):
        ids = piece.column("doc_id").to_pylist()
        score = model.score(piece.column("text"))
        yield {"doc_id": ids, "held_out": crc_of(ids, folds) == out, "score": score, "predicted": (score >= 0.7).astype(np.int32)}

    return map_batches(texts_of(docs), "doc_id long, held_out boolean, score double, predicted int", step)
