"""Deterministic repair of delimited feeds against a contract.

A header decides which columns to rename, fill and drop, so those choices are
made once per distinct header and become a row of a dictionary: the position of
every contract column's value, or what it is filled with.  Rows hold their
values as an array, are joined with the dictionary by id and take values by
position, so the plan is the same for two headers and for thousands.  Values are
repaired by expressions.  Nothing is guessed: what cannot be repaired is flagged
and later lowers the file's confidence.

Row-level output of :func:`repair_rows` (no shuffle)::

    source_file, pos, plan_id, drifted, <contract columns>, <numeric>_text,
    fixed_<c>, bad_<c>, row_key

``<numeric>_text`` keeps an unparseable number as it came; ``row_key``
identifies the unredacted row for duplicate removal.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..contracts import REQUIRED_FIELDS, Contract
from ..functions.coerce import coerce_date, coerce_number, is_plain_number
from ..functions.text import is_present
from ..session import local_frame, stage
from .redact import has_type_aggregates, redact_fields, type_list

# Texts of repairs and issues.
EMPTY_FILE = "file contains no data rows"
RENAMED = "renamed column '{}' -> '{}'"
FILLED = "filled missing column '{}' with default '{}'"
DROPPED = "dropped unexpected column(s): {}"
MISSING = "missing required column '{}' with no known default"


@dataclass(frozen=True)
class Feed:
    """Rows that share one header: ``source_file``, ``pos`` and ``v0`` to ``vN``."""

    df: DataFrame
    header: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, source: Column, order: Column, columns: Sequence[str]) -> Feed:
        values = [df[c].cast("string").alias(f"v{i}") for i, c in enumerate(columns)]
        return cls(df.select(source.alias("source_file"), order.alias("pos"), *values), tuple(columns))

    @property
    def positions(self) -> dict[str, int]:
        """Header name to value position; of equal names the last one holds."""
        return {name: i for i, name in enumerate(self.header)}


@dataclass(frozen=True)
class Feeds:
    """Rows of feeds with any headers: ``source_file``, ``pos``, ``plan_id`` and ``values``, in the order of the header
    that ``headers`` (``plan_id``, ``header``) has under that id."""

    rows: DataFrame
    headers: DataFrame

    @classmethod
    def of(cls, feeds: Sequence[Feed]) -> Feeds:
        """Feeds of one header each as one table; ``plan_id`` is a feed's position."""
        parts = [
            f.df.select("source_file", "pos", F.lit(i).cast("bigint").alias("plan_id"), F.array(*[f"v{k}" for k in range(len(f.header))]).cast("array<string>").alias("values"))
            for i, f in enumerate(feeds)
        ]
        return cls(reduce(DataFrame.unionByName, parts), header_table(feeds[0].df.sparkSession, [f.header for f in feeds]))


def header_table(spark: SparkSession, headers: Sequence[Sequence[str]]) -> DataFrame:
    """Headers that are known beforehand, numbered by position."""
    return local_frame(spark, [(i, list(h)) for i, h in enumerate(headers)], "plan_id bigint, header array<string>")


@dataclass(frozen=True)
class HeaderPlan:
    """What one header needs to meet the contract."""

    header: tuple[str, ...]
    missing: tuple[str, ...]
    unexpected: tuple[str, ...]
    sources: dict[str, int]  # contract column -> value position
    fills: dict[str, str]  # contract column -> default
    log: tuple[str, ...]
    issues: tuple[str, ...]

    @property
    def drifted(self) -> bool:
        return bool(self.missing or self.unexpected)


def plan_header(header: Sequence[str], contract: Contract) -> HeaderPlan:
    """Resolve every contract column against the header, one column at a time.

    A position stands for the contract column that its name is a synonym of, or
    for its own name; of several positions for one column the last counts.
    """
    header = tuple(header)
    absent = tuple(sorted(c for c in contract.columns if c not in header))
    foreign = tuple(sorted({name for name in header if name not in contract.columns}))
    if not absent and not foreign:
        return HeaderPlan(header, (), (), {name: i for i, name in enumerate(header)}, {}, (), ())
    # Equal names are one column, whose values are those of its last position but
    # which keeps the place of its first.
    spelled = {name: i for i, name in enumerate(header)}
    stands_for = {name: contract.synonyms.get(name.lower(), name) for name in spelled}
    sources = {stands_for[name]: at for name, at in spelled.items()}
    lower = {name.lower() for name in spelled}
    implied = [code for column, code in contract.implied_currency.items() if column in lower]
    known = {**contract.defaults, **({"currency": implied[-1]} if implied else {})}
    gaps = [c for c in contract.columns if c not in sources]
    fills = {c: known[c] for c in gaps if c in known}
    foreign_targets = sorted(c for c in sources if c not in contract.columns)
    return HeaderPlan(
        header, absent, foreign, sources, fills,
        log=(
            *(RENAMED.format(name, stands_for[name]) for name in sorted(spelled) if name.lower() in contract.synonyms),
            *(FILLED.format(c, value) for c, value in fills.items()),
            *([DROPPED.format(", ".join(foreign_targets))] if foreign_targets else []),
        ),
        issues=tuple(MISSING.format(c) for c in gaps if c not in known),
    )


def value_order(plan: HeaderPlan, contract: Contract) -> list[str]:
    """Contract columns in the order a repaired record carries them."""
    kept = [c for c in plan.sources if c in contract.columns]
    return kept + list(plan.fills) + [
        c for c in contract.columns if c not in plan.sources and c not in plan.fills
    ]


def repair_rows(rows: DataFrame, contract: Contract) -> DataFrame:
    """Repair rows of :class:`Feeds` that were joined with their row of :func:`plan_table`."""
    out: dict[str, Column] = {}
    for j, column in enumerate(contract.columns):
        at, fill = F.col("positions")[j], F.col("fills")[j]
        known = (at >= 0) | fill.isNotNull()
        value = F.when(at >= 0, F.get("values", at)).otherwise(fill)
        if column in contract.date_columns:
            iso = coerce_date(value)
            out[column] = F.coalesce(iso, value)
            out[f"bad_{column}"] = known & iso.isNull()
            out[f"fixed_{column}"] = F.coalesce(iso != value, F.lit(False))
        elif column in contract.numeric_columns:
            number = coerce_number(value)
            out[column] = number
            out[f"{column}_text"] = F.when(number.isNull(), value)
            out[f"bad_{column}"] = known & number.isNull()
            out[f"fixed_{column}"] = number.isNotNull() & ~is_plain_number(value)
        else:
            out[column] = value

    repaired = rows.select(
        "source_file", "pos", "plan_id", F.col("plan_drifted").alias("drifted"), "value_order",
        *[expr.alias(name) for name, expr in out.items()],
    )
    key = F.sha2(F.to_json(F.struct(*_content(contract))), 256)
    return repaired.withColumn("row_key", F.when(F.col("drifted"), key))


def _content(contract: Contract) -> list[str]:
    return list(contract.columns) + [f"{c}_text" for c in contract.numeric_columns]


def _flags(contract: Contract) -> list[str]:
    checked = contract.date_columns + contract.numeric_columns
    return [f"{kind}_{c}" for c in checked for kind in ("fixed", "bad")]


def redact_rows(rows: DataFrame, contract: Contract) -> DataFrame:
    """Redact repaired rows; a date that became ISO text needs no scan.  Findings
    come in the order in which the row's header has the fields."""
    fields = [f"{c}_text" if c in contract.numeric_columns else c for c in contract.columns]
    parsed = {c: f"NOT bad_{c}" for c in contract.date_columns}
    return redact_fields(rows, fields, unless=parsed, order="value_order").drop("value_order")


def repair_and_redact(feeds: Feeds | Sequence[Feed], contract: Contract, plans: DataFrame | None = None) -> DataFrame:
    """All feeds repaired and redacted; ``plans`` is :func:`plan_table` of their headers, where that is there already."""
    feeds = feeds if isinstance(feeds, Feeds) else Feeds.of(feeds)
    plans = plan_table(feeds.rows.sparkSession, feeds.headers, contract) if plans is None else plans
    # A row for each distinct header; its size is known, so Spark broadcasts it while it is small.
    choices = plans.select("plan_id", "plan_drifted", "positions", "fills", "value_order")
    return redact_rows(repair_rows(feeds.rows.join(choices, "plan_id"), contract), contract)


def deduplicate(rows: DataFrame, contract: Contract) -> DataFrame:
    """Drop exact duplicates within a file, on the drift path only.

    Grouping on the whole row spreads a big file over all tasks, and equal
    copies are combined before the shuffle.  ``copies`` and the summed flags
    keep what the dropped rows contribute to the log.
    """
    carried = _content(contract) + (["findings"] if "findings" in rows.columns else [])
    keys = ["source_file", "plan_id", "drifted", "row_key", *carried]
    flags = _flags(contract)
    kept = rows.where(~F.col("drifted")).select(
        *keys, "pos", F.lit(1).cast("bigint").alias("copies"),
        *[F.col(f).cast("bigint").alias(f) for f in flags],
    )
    grouped = (
        rows.where("drifted")
        .groupBy(*keys)
        .agg(
            F.min("pos").alias("pos"),
            F.count(F.lit(1)).alias("copies"),
            *[F.sum(F.col(f).cast("bigint")).alias(f) for f in flags],
        )
    )
    return kept.unionByName(grouped).drop("row_key")


def present_fields(kind: str, contract: Contract | None = None, get=F.col) -> Column:
    """How many required fields a record carries."""
    numeric = contract.numeric_columns if contract else ()
    total = F.lit(0)
    for name in REQUIRED_FIELDS[kind]:
        present = is_present(get(name))
        if name in numeric:
            present = present | is_present(get(f"{name}_text"))
        total = total + present.cast("int")
    return total


_PLAN = (
    "plan_id bigint, plan_drifted boolean, note string, plan_log array<string>, plan_issues array<string>,"
    " positions array<int>, fills array<string>, value_order array<int>"
)


def _plan_row(plan_id: int, header: Sequence[str], contract: Contract) -> tuple:
    plan = plan_header(header, contract)
    note = (
        f"drift detected (missing={list(plan.missing)}, unexpected={list(plan.unexpected)})"
        if plan.drifted
        else "schema matches baseline"
    )
    positions = [plan.sources.get(c, -1) for c in contract.columns]
    order = [contract.columns.index(c) for c in value_order(plan, contract)]
    return plan_id, plan.drifted, note, list(plan.log), list(plan.issues), positions, [plan.fills.get(c) for c in contract.columns], order


def plan_table(spark: SparkSession, headers: DataFrame | Sequence[Sequence[str]], contract: Contract) -> DataFrame:
    """The header plans as a table, one row per distinct header, made where the headers are.

    ``positions`` and ``fills`` have an entry for each contract column (-1 and null: none); ``value_order`` lists
    the contract columns in the order a repaired record carries them.
    """
    if not isinstance(headers, DataFrame):
        return local_frame(spark, [_plan_row(i, h, contract) for i, h in enumerate(headers)], _PLAN)
    schema = to_arrow_schema(StructType.fromDDL(_PLAN))

    def run(batches):
        for batch in batches:
            rows = [_plan_row(r["plan_id"], r["header"], contract) for r in batch.to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return stage(headers.select("plan_id", "header").mapInArrow(run, _PLAN), "header-plans")


def feed_facts(records: DataFrame, plans: DataFrame, contract: Contract) -> DataFrame:
    """File-grain facts of repaired records, in one aggregation."""
    flags = _flags(contract)
    grouped = records.groupBy("source_file", "plan_id").agg(
        F.sum("copies").alias("row_count"),
        F.count(F.lit(1)).alias("n_records"),
        F.sum(present_fields(contract.kind, contract)).alias("present"),
        F.sum(F.size("findings")).alias("n_findings"),
        *has_type_aggregates(F.col("findings")),
        *[F.sum(f).alias(f) for f in flags],
    )
    # One row per distinct header; its size is known, so Spark broadcasts it
    # while it is small and the facts are not shuffled on a skewed key.
    joined = grouped.join(plans, "plan_id")

    def line(count: Column, *parts) -> Column:
        text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        return F.when(count > 0, text)

    dropped = F.col("row_count") - F.col("n_records")
    value_log = [
        line(F.col(f"fixed_{c}"), "normalised ", F.col(f"fixed_{c}"), f" value(s) in '{c}' to ISO dates")
        for c in contract.date_columns
    ] + [
        line(F.col(f"fixed_{c}"), "coerced ", F.col(f"fixed_{c}"), f" value(s) in '{c}' to numeric")
        for c in contract.numeric_columns
    ]
    fixes = F.concat(
        "plan_log",
        F.array_compact(F.array(*value_log, line(dropped, "dropped ", dropped, " exact duplicate row(s)"))),
    )
    bad = sum((F.col(f) for f in flags if f.startswith("bad_")), F.lit(0))
    facts = joined.select(
        "source_file",
        "row_count",
        "n_records",
        "present",
        "n_findings",
        type_list().alias("pii_types"),
        fixes.alias("fixes"),
        (F.size("plan_issues") + bad).alias("n_issues"),
        "plan_issues",
        "plan_drifted",
        "note",
    )
    return finish_feed_facts(facts, contract)


def finish_feed_facts(facts: DataFrame, contract: Contract) -> DataFrame:
    """Confidence, method and audit lines of the delimited-feed branch."""
    n_fixes, n_issues = F.size("fixes"), F.col("n_issues")
    method = (
        F.when(F.col("plan_drifted"), "csv+fixers").when(n_fixes > 0, "csv+coerce").otherwise("csv")
    )
    fix_line = F.when(
        F.col("plan_drifted"),
        F.format_string("fix: %d repair(s), %d unfixed issue(s)", n_fixes, n_issues),
    ).otherwise(
        F.format_string(
            "fix: schema matches baseline; %d value normalisation(s), %d unfixed", n_fixes, n_issues
        )
    )
    return facts.select(
        "source_file",
        F.lit(contract.kind).alias("record_kind"),
        F.when(n_issues == 0, 1.0).otherwise(0.5).alias("confidence"),
        method.alias("method"),
        "n_records",
        "present",
        "n_findings",
        "pii_types",
        "fixes",
        "n_issues",
        "plan_issues",
        F.array(
            F.concat(F.lit("profile: "), F.col("row_count"), F.lit(" rows, "), F.col("note")),
            fix_line,
        ).alias("branch_audit"),
    )


def empty_feed_facts(files: DataFrame, contract: Contract) -> DataFrame:
    """Facts of delimited files that hold no data rows at all."""
    note = f"drift detected (missing={sorted(contract.columns)}, unexpected=[])"
    zero = F.lit(0).cast("bigint")
    facts = files.select(
        "source_file",
        zero.alias("row_count"),
        zero.alias("n_records"),
        zero.alias("present"),
        zero.alias("n_findings"),
        F.array().cast("array<string>").alias("pii_types"),
        F.array().cast("array<string>").alias("fixes"),
        F.lit(1).cast("bigint").alias("n_issues"),
        F.array(F.lit(EMPTY_FILE)).alias("plan_issues"),
        F.lit(True).alias("plan_drifted"),
        F.lit(note).alias("note"),
    )
    return finish_feed_facts(facts, contract)


def row_issues(rows: DataFrame, contract: Contract) -> DataFrame:
    """One row per value that could not be repaired: ``source_file, stage, pos, issue``.

    Built from redacted rows, so an issue never repeats personal data.
    """
    lines = []
    for stage, c in enumerate(contract.date_columns + contract.numeric_columns, start=1):
        if c in contract.date_columns:
            shown, what = F.coalesce(F.col(c), F.lit("")), "date"
        else:
            shown, what = F.coalesce(F.col(f"{c}_text"), F.lit("None")), "number"
        text = F.concat(F.lit(f"unparseable {what} '"), shown, F.lit(f"' in column '{c}'"))
        lines.append(
            F.when(F.col(f"bad_{c}"), F.struct(F.lit(stage).alias("stage"), text.alias("issue")))
        )
    any_bad = reduce(
        lambda a, b: a | b, [F.col(f"bad_{c}") for c in contract.date_columns + contract.numeric_columns]
    )
    return (
        rows.where(any_bad)
        .select("source_file", "pos", F.explode_outer(F.array_compact(F.array(*lines))).alias("line"))
        .select("source_file", "line.stage", "pos", "line.issue")
    )


def header_issues(facts: DataFrame) -> DataFrame:
    """Issues known from the header alone (or from an empty file)."""
    listed = facts.select("source_file", F.posexplode_outer("plan_issues").alias("pos", "issue"))
    return listed.where("issue IS NOT NULL").select(
        "source_file", F.lit(0).alias("stage"), F.col("pos").cast("bigint").alias("pos"), "issue"
    )
