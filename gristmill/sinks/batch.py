"""One call for the whole end of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.vectors import hash_embed
from ..plans.refine import RefineResult
from .quarantine import quarantine
from .warehouse import Warehouse


def run_batch(result: RefineResult, warehouse: Warehouse, restricted: str, embedder=hash_embed, retry: bool = False) -> DataFrame:
    """Set the flagged originals aside, then load the tables; returns the counts per destination.

    Nothing of a flagged file is loaded before its original lies in ``restricted``.
    """
    quarantine(warehouse.spark, result, restricted)
    return warehouse.load(result, embedder, retry)
