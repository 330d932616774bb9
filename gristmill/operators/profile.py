"""Feed profiles and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import Contract
from ..functions.text import is_blank, round_half_even
from .repair import Feed, Feeds


def profile(feeds: Feeds | Feed) -> DataFrame:
    """Row count, columns and null rates per source, in one scan whatever the headers.

    Blank and white-space-only values count as null; rates have three decimals.
    Values are counted by position, and a name stands for the last position it has.
    """
    feeds = feeds if isinstance(feeds, Feeds) else Feeds.of([feeds])
    by_place = feeds.rows.select("source_file", "plan_id", F.posexplode("values").alias("place", "value"))
    counted = by_place.groupBy("source_file", "plan_id", "place").agg(F.count(F.lit(1)).alias("n"), F.sum(is_blank(F.col("value")).cast("bigint")).alias("blank"))
    rates = counted.groupBy("source_file", "plan_id").agg(
        F.max("n").alias("row_count"),
        F.sort_array(F.collect_list(F.struct("place", round_half_even(F.col("blank") / F.col("n"), 3).alias("rate")))).alias("rates"),
    )
    names = F.array_distinct("header")
    last = F.transform(names, lambda c: F.size("header") - F.array_position(F.reverse("header"), c).cast("int"))
    return rates.join(feeds.headers, "plan_id").select(
        "source_file",
        "row_count",
        names.alias("columns"),
        F.map_from_arrays(names, F.transform(last, lambda i: F.get("rates.rate", i)).cast("array<double>")).alias("null_rates"),
    )


def drift(columns: Column, contract: Contract) -> Column:
    """``struct<has_drift, missing_columns, unexpected_columns>``, both sorted;
    case matters, order does not."""
    expected = F.array(*[F.lit(c) for c in contract.columns])
    missing = F.array_sort(F.array_except(expected, columns))
    unexpected = F.array_sort(F.array_except(columns, expected))
    return F.struct(
        ((F.size(missing) > 0) | (F.size(unexpected) > 0)).alias("has_drift"),
        missing.alias("missing_columns"),
        unexpected.alias("unexpected_columns"),
    )
