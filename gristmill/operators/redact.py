"""Redaction of whole record sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pii import FINDING, PII_TYPES, scan, scan_sql


def text_fields(df: DataFrame, skip: Sequence[str] = ("source_file",)) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def redact_fields(
    df: DataFrame,
    fields: Sequence[str] | None = None,
    unless: dict[str, str] | None = None,
    order: str | None = None,
) -> DataFrame:
    """Redact string fields and append their findings, in field order, or in the
    order in which the column ``order`` lists the fields' positions.

    ``unless`` maps a field to the SQL condition under which its value is proven
    free of personal data (an ISO date built by the repair step), which then
    skips the detectors.
    """
    fields = list(fields if fields is not None else text_fields(df))
    unless = unless or {}
    texts = [f"if({unless[f]}, NULL, `{f}`)" if f in unless else f"`{f}`" for f in fields]
    # One fold serves all fields: it runs over the array of their texts.
    scans = F.expr(f"transform(array({', '.join(texts)}), t -> {scan_sql('t')})")
    clean = {f: F.coalesce(F.col("__scans")[i]["redacted"], F.col(f)) for i, f in enumerate(fields)}
    found = F.flatten(F.col("__scans")["findings"]) if fields else F.array().cast(FINDING)
    if order:
        # Nearly all rows have none, whatever the order.
        found = F.when(F.size(found) == 0, found).otherwise(F.flatten(F.transform(order, lambda i: F.get(F.col("__scans")["findings"], i))))
    return df.withColumn("__scans", scans).withColumns({**clean, "findings": found}).drop("__scans")


def raw_findings(text: str) -> Column:
    return scan(text)["findings"]


def has_type_aggregates(findings: Column) -> list[Column]:
    """One flag per type, so that grouping never gathers the findings."""
    return [F.max(has_type(findings, name)).alias(f"has_{name}") for name in PII_TYPES]


def has_type(findings: Column, name: str) -> Column:
    return F.exists(findings, lambda f: f["type"] == name)


def type_list() -> Column:
    """Sorted types from the flags of :func:`has_type_aggregates`."""
    return F.array_compact(
        F.array(*[F.when(F.col(f"has_{name}"), F.lit(name)) for name in PII_TYPES])
    )


def redact_structs(records: str, fields: Sequence[str], texts: Sequence[str]) -> Column:
    """The same for an array of structs: redacted fields, then ``findings``."""
    listed = ", ".join(f"r.{f}" for f in texts)
    kept = ", ".join(f"p.s[{texts.index(f)}].redacted AS {f}" if f in texts else f"p.r.{f} AS {f}" for f in fields)
    return F.expr(
        f"transform(transform({records}, r -> struct(r AS r, transform(array({listed}), t -> {scan_sql('t')}) AS s)),"
        f" p -> struct({kept}, flatten(p.s.findings) AS findings))"
    )
