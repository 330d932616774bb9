"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's UTF-8 bytes (letters lower-cased), one from either side; every position gets
label probabilities from both states, and a document gets their mean over its letters.  Training is plain
backpropagation through time with Adam in numpy, on windows of at most ``each`` documents a label (``windows`` windows
each); documents are sampled evenly by label.  Texts are read whole, in windows of ``SPAN`` bytes that start ``WARM``
bytes early on either side so that their states are warm.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all texts where there is no
labelled row to learn from; with one label every text with a letter gets it; of equal probabilities the label that sorts
first counts; repeated rows get a row each and null ids are rows like any other; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import crc_mod, crc_of, map_batches, sample_by, texts_of
from gristmill.llm.toxicity import one_row_an_id
from gristmill.session import stage

EACH, WINDOWS, HIDDEN, STEPS, BATCH = 600, 3, 8, 400, 256
SPAN, WARM, TRAIN_SPAN = 112, 8, 64
BLOCK = 2048

# Bytes that count as letters when positions are pooled: a-z and all of a multi-byte character.
_LETTER = np.zeros(256, np.float32)
_LETTER[97:123] = 1
_LETTER[128:] = 1


def _gates(x: np.ndarray, h: np.ndarray, u: np.ndarray, table: np.ndarray):
    """One step for all columns: update and reset gates, candidate, what the candidate got from the state, new state."""
    n = h.shape[0]
    a = np.take(table, x, axis=1)
    g = u @ h
    zr = np.tanh(a[: 2 * n] + g[: 2 * n])
    zr *= 0.5
    zr += 0.5
    c = g[2 * n :] * zr[n:]
    c += a[2 * n :]
    np.tanh(c, out=c)
    new = h - c
    new *= zr[:n]
    new += c
    return zr[:n], zr[n:], c, g[2 * n :], new


class Network:
    """``table`` (3H, 256) and ``u`` (3H, H) for each direction, ``out`` (labels, 2H + 1).

    Gate rows hold half their weights, as a logistic function is ``tanh(x / 2) / 2 + 1 / 2``.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.p = {}
        for side in "fb":
            self.p["table_" + side] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.p["u_" + side] = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.1, (len(labels), 2 * hidden + 1)).astype(np.float32)

    def logits(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Of positions lo to hi of the columns of ``data`` (steps, columns): (hi - lo, labels, columns)."""
        n, p = self.hidden, self.p
        out = np.empty((hi - lo, len(self.labels), data.shape[1]), np.float32)
        h = np.zeros((n, data.shape[1]), np.float32)
        for t in range(hi):
            h = _gates(data[t], h, p["u_f"], p["table_f"])[4]
            if t >= lo:
                np.matmul(p["out"][:, :n], h, out=out[t - lo])
        h = np.zeros_like(h)
        for t in range(len(data) - 1, lo - 1, -1):
            h = _gates(data[t], h, p["u_b"], p["table_b"])[4]
            if t < hi:
                out[t - lo] += p["out"][:, n : 2 * n] @ h
                out[t - lo] += p["out"][:, 2 * n :]
        return out

    def gradients(self, data: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross-entropy of all positions in ``mask``."""
        p, n, steps = self.p, self.hidden, len(data)
        tape, states = {}, {}
        for side in "fb":
            order = range(steps) if side == "f" else range(steps - 1, -1, -1)
            h = np.zeros((n, data.shape[1]), np.float32)
            tape[side], states[side] = {}, np.empty((steps, n, data.shape[1]), np.float32)
            for t in order:
                z, r, c, gh, new = _gates(data[t], h, p["u_" + side], p["table_" + side])
                tape[side][t] = (h, z, r, c, gh)
                h = states[side][t] = new
        both = np.concatenate([states["f"], states["b"], np.ones((steps, 1, data.shape[1]), np.float32)], axis=1)
        logits = p["out"] @ both
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        columns = np.arange(data.shape[1])
        loss = -(np.log(prob[:, y, columns] + 1e-9) * mask).sum() / mask.sum()
        d = prob
        d[:, y, columns] -= 1
        d *= (mask / mask.sum())[:, None, :]
        grads = {"out": np.einsum("tln,tkn->lk", d, both, optimize=True)}
        back = p["out"].T[None] @ d
        for side, rows in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            u = p["u_" + side]
            du, deltas = np.zeros_like(u), np.empty((steps, 3 * n, data.shape[1]), np.float32)
            dh = np.zeros((n, data.shape[1]), np.float32)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                h, z, r, c, gh = tape[side][t]
                dh = dh + back[t, rows]
                dc = dh * (1 - z) * (1 - c * c)
                delta = deltas[t]
                # The gate rows see half the slope of the logistic function's argument: 2 z (1 - z).
                delta[:n] = dh * (h - c) * 2 * z * (1 - z)
                delta[n : 2 * n] = dc * gh * 2 * r * (1 - r)
                delta[2 * n :] = dc
                to_h = delta.copy()
                to_h[2 * n :] *= r
                du += to_h @ h.T
                dh = dh * z + u.T @ to_h
            grads["u_" + side] = du
            flat = deltas.transpose(1, 0, 2).reshape(3 * n, -1)
            table = np.empty((3 * n, 256), np.float32)
            at = data.reshape(-1)
            for k in range(3 * n):
                table[k] = np.bincount(at, weights=flat[k], minlength=256)
            grads["table_" + side] = table
        return grads, float(loss)

    def train(self, data: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.03, seed: int = 3):
        """``data``: (windows, bytes)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        while step < steps:
            order = rng.permutation(len(data))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                step += 1
                part = np.ascontiguousarray(data[pick].T)
                mask = _LETTER[part]
                if not mask.any():
                    continue
                grads, _ = self.gradients(part, y[pick], mask)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                now = rate * max(0.02, 1 - step / (steps + 1))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """For each text the mean label probabilities over its letters (zeros without a letter)."""
        data, starts, ends = lowered_bytes(texts)
        sums = np.zeros((len(texts), len(self.labels)), np.float64)
        letters = np.zeros(len(texts), np.float64)
        counts = -(-(ends - starts) // SPAN)
        row = np.repeat(np.arange(len(texts)), counts)
        first = np.repeat(starts, counts) + SPAN * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
        steps = np.arange(-WARM, SPAN + WARM)[:, None]
        for lo in range(0, len(row), BLOCK):
            r, f = row[lo : lo + BLOCK], first[lo : lo + BLOCK]
            at = f[None, :] + steps
            inside = (at >= starts[r]) & (at < ends[r])
            window = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 32).astype(np.uint8)
            prob = self.logits(window, WARM, WARM + SPAN)
            prob -= prob.max(axis=1, keepdims=True)
            np.exp(prob, out=prob)
            mask = _LETTER[window[WARM : WARM + SPAN]]
            prob *= (mask / prob.sum(axis=1))[:, None, :]
            np.add.at(sums, r, prob.sum(axis=0).T)
            np.add.at(letters, r, mask.sum(axis=0))
        return sums / np.maximum(letters, 1)[:, None]


def lowered_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = pc.utf8_lower(texts).cast(pa.large_binary())
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    return np.frombuffer(low.buffers()[2] or b"\0", np.uint8), offsets[:-1], offsets[1:]


def train(docs: DataFrame, folds: int = 4, out: int = 2, each: int = EACH, windows: int = WINDOWS) -> Network | None:
    """A network from rows outside fold ``out`` that have a language and a text with letters."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != out))
    chosen = sample_by(learn.select(F.col("doc_id").cast("long").alias("doc_id"), "lang"), "lang", each)
    # The ids of the sample are few; the texts they go to don't travel.  Repeated ids count once.
    chosen = F.broadcast(chosen.groupBy("doc_id").agg(F.min("lang").alias("lang")))

    def step(piece):
        cut, labels = [], []
        for i, (text, lang) in enumerate(zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist())):
            raw = text.lower().encode()
            spots = np.linspace(0, max(0, len(raw) - TRAIN_SPAN), windows).astype(int)
            for at in dict.fromkeys(spots.tolist()):
                cut.append(raw[at : at + TRAIN_SPAN].ljust(TRAIN_SPAN))
                labels.append(lang)
        yield {"cut": cut, "lang": labels}

    rows = stage(map_batches(one_row_an_id(texts_of(docs).join(chosen, "doc_id"), "text", "lang"), "cut binary, lang string", step), "windows").toArrow()
    if rows.num_rows == 0:
        return None
    names = sorted(set(rows.column("lang").to_pylist()))
    order = np.lexsort((np.array(rows.column("cut").to_pylist()), rows.column("lang").to_numpy().astype(str)))
    y = np.searchsorted(names, rows.column("lang").to_numpy().astype(str))[order]
    data = np.frombuffer(b"".join(rows.column("cut").to_pylist()), np.uint8).reshape(-1, TRAIN_SPAN)[order]
    net = Network(names)
    net.train(data, y)
    return net


def predicted(docs: DataFrame, net: Network | None, folds: int = 4, out: int = 2) -> DataFrame:
    def step(piece):
        ids, texts = piece.column("doc_id").to_pylist(), piece.column("text")
        readable = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
        label, score = ["und"] * len(ids), np.zeros(len(ids))
        if net is not None and readable.any():
            prob = net.pooled(texts)
            best = prob.argmax(axis=1)
            label = [net.labels[b] if ok else "und" for b, ok in zip(best, readable)]
            score = np.where(readable, np.clip(prob.max(axis=1), 0, 1), 0.0)
        yield {"doc_id": ids, "held_out": crc_of(ids, folds) == out, "lang_pred": label, "score": score}

    return map_batches(texts_of(docs), "doc_id long, held_out boolean, lang_pred string, score double", step)
