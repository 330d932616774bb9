"""Vectors out of array columns: which take part, and their numbers as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, all components there and finite."""

    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def by_length(column: pa.Array):
    """(places, matrix of doubles) for each length of vectors in a list column."""
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[(ends[at] - d)[:, None] + np.arange(d)]
