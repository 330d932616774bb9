"""Hashed bag-of-words vectors and dot products."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import VECTOR_DIM

TOKEN = re.compile("[a-z0-9]+")
KNOWN_TOKENS = 500_000


def tokens(text: Column) -> Column:
    """Runs of ``a-z0-9`` in the lower-cased text, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


@lru_cache(4)
def _buckets(dim: int) -> dict[str, int]:
    """Buckets of the tokens a worker has met; see :func:`hash_embed`."""
    return {}


def _bucket_of(token: str, dim: int) -> int:
    """The token's 128-bit md5 modulo ``dim``."""
    return int.from_bytes(hashlib.md5(token.encode()).digest(), "big") % dim


def hash_embed(text: Column, dim: int = VECTOR_DIM) -> Column:
    """Unit-length token counts by bucket; all zero for a text without tokens.

    Row-local, so embedding never shuffles.  A worker hashes a token once: it
    keeps the buckets of up to ``KNOWN_TOKENS`` tokens and starts over beyond
    that, so its memory doesn't grow with the data.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        known = _buckets(dim)
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            found = TOKEN.findall(text.lower())
            if len(known) > KNOWN_TOKENS:
                known.clear()
            for token in set(found).difference(known):
                known[token] = _bucket_of(token, dim)
            vector = np.bincount([known[t] for t in found], minlength=dim).astype(float) if found else np.zeros(dim)
            length = math.sqrt(float((vector * vector).sum()))
            out.append(vector / length if length else vector)
        return pd.Series(out, dtype=object)

    return embed(text)


def dot(left: Column, right: Column) -> Column:
    """Dot product; the longer side is cut to the shorter."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(
        products, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0))
    )


def dot_literal(vector: Column, weights: list[float]) -> Column:
    """Dot product with a known vector.

    A question has few non-zero dimensions, so only those are read, as plain
    generated code; dense vectors use the array form.
    """
    used = [(i, w) for i, w in enumerate(weights) if w]
    if len(used) > 64:
        return dot(vector, F.array(*[F.lit(float(w)) for w in weights]))
    score = F.lit(0.0)
    for i, w in used:
        score = score + F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return score
