"""Feed contracts, record schemas and thresholds.

A contract is what a feed is supposed to look like.  It is plain driver-side
metadata: plans read it to decide which column expressions to build, and no
row ever touches it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    """The agreed columns of a delimited feed and the repairs known for it."""

    kind: str
    columns: tuple[str, ...]
    synonyms: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    implied_currency: dict[str, str] = field(default_factory=dict)
    date_columns: tuple[str, ...] = ()
    numeric_columns: tuple[str, ...] = ()

    @property
    def text_columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.numeric_columns)


# The transactions contract.
TRANSACTIONS = Contract(
    kind="transactions",
    columns=("txn_id", "date", "amount", "currency", "merchant", "category"),
    synonyms={
        "transaction_id": "txn_id",
        "transactionid": "txn_id",
        "transaction_date": "date",
        "txn_date": "date",
        "amount_aed": "amount",
        "amount_usd": "amount",
        "merchant_name": "merchant",
        "merchant_category": "category",
    },
    defaults={"currency": "AED", "category": "general"},
    implied_currency={"amount_aed": "AED", "amount_usd": "USD"},
    date_columns=("date",),
    numeric_columns=("amount",),
)

# Fields a record must carry, by kind, the load threshold, dimensions of hashed vectors, hits of a search.
REQUIRED_FIELDS = {
    "transactions": ("txn_id", "date", "amount"),
    "invoices": ("invoice_number", "vendor", "total_amount"),
    "documents": ("body",),
}
LOAD_THRESHOLD = 0.75
VECTOR_DIM = 384
DEFAULT_TOP_K = 3

KINDS = ("transactions", "invoices", "documents")

# Column order of the stored tables (``source_file`` is appended to each).
TABLE_COLUMNS = {
    "transactions": ("txn_id", "date", "amount", "currency", "merchant", "category"),
    "invoices": (
        "invoice_number",
        "vendor",
        "invoice_date",
        "due_date",
        "total_amount",
        "currency",
    ),
    "documents": ("subject", "sender", "date", "body"),
    "chunks": ("kind", "text", "embedding"),
}

INVOICE_RECORD = T.StructType(
    [
        T.StructField("invoice_number", T.StringType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("invoice_date", T.StringType()),
        T.StructField("due_date", T.StringType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
    ]
)
