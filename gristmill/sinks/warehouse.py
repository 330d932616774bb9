"""Stored tables, lineage, and the views that make a reload replace a file.

Data is only ever appended, in a folder per run.  A run counts once its entry
in the log of runs exists: a numbered file, created only if no run has that
number yet, after all its tables are written.  Readers see, for every file, the
rows of its latest counted run if that run loaded it.  So a re-run replaces, a
file that falls to review disappears, a job that dies half-way leaves rows
nobody sees, and of two jobs at once each counts whole.  A job that doesn't know
whether its last attempt counted may say so (``retry``); then nothing is written
twice.

The log relies on a file system that creates a file only if it is absent (local
disks, HDFS, and object stores behind a connector with conditional writes).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import DEFAULT_TOP_K, KINDS, TABLE_COLUMNS
from ..functions.vectors import hash_embed
from ..operators.answer import answer
from ..operators.search import search, search_batch
from ..plans.refine import RefineResult

SCHEMAS = {
    "transactions": "txn_id string, date string, amount double, currency string, merchant string,"
    " category string, source_file string, run_id string",
    "invoices": "invoice_number string, vendor string, invoice_date string, due_date string,"
    " total_amount double, currency string, source_file string, run_id string",
    "documents": "subject string, sender string, date string, body string, source_file string,"
    " run_id string",
    "chunks": "source_file string, kind string, chunk_ord bigint, text string,"
    " embedding array<double>, run_id string",
    "issues": "source_file string, stage int, pos bigint, issue string, run_id string",
    "lineage": "source_file string, file_type string, decision string, record_kind string,"
    " records_loaded int, quality_score double, extraction_method string, fixes string,"
    " unfixed string, n_unfixed bigint, pii_types string, quarantined boolean, audit string,"
    " processed_at timestamp, run_id string",
}
SCHEMA_COLUMNS = {name: [c.split()[0] for c in schema.split(", ")] for name, schema in SCHEMAS.items()}
DATA_TABLES = (*KINDS, "chunks")


def new_run_id() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("r%Y%m%dT%H%M%S%f-") + uuid.uuid4().hex[:8]


def lineage_rows(decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per processed file, loaded or not (time and run are added on write).

    ``unfixed`` is the whole list whatever its length; the ``issues`` table has
    the same as rows, for readers of files with very many.
    """
    listed = (
        issues.groupBy("source_file")
        .agg(F.array_sort(F.collect_list(F.struct("stage", "pos", "issue"))).alias("l"))
        .select("source_file", F.to_json(F.transform("l", lambda i: i["issue"])).alias("listed"))
    )
    unfixed = F.coalesce("listed", F.lit("[]"))
    return decisions.join(listed, "source_file", "left").select(
        "source_file",
        "file_type",
        F.col("action").alias("decision"),
        "record_kind",
        "records_loaded",
        "quality_score",
        F.col("method").alias("extraction_method"),
        F.to_json("fixes").alias("fixes"),
        unfixed.alias("unfixed"),
        F.col("n_issues").alias("n_unfixed"),
        F.array_join("pii_types", ",").alias("pii_types"),
        F.col("quarantine").alias("quarantined"),
        F.to_json("audit").alias("audit"),
    )


def load_counts(decisions: DataFrame) -> DataFrame:
    """Rows per destination, from file-grain numbers alone."""
    loaded = F.col("action") == "LOAD"
    of_kind = [
        F.coalesce(F.sum(F.when(loaded & (F.col("record_kind") == k), F.col("n_records"))), F.lit(0))
        .cast("bigint")
        .alias(k)
        for k in KINDS
    ]
    per_file = F.when(F.col("record_kind") == "transactions", 1).otherwise(F.col("n_records"))
    return decisions.agg(
        *of_kind,
        F.coalesce(F.sum(F.when(loaded, per_file)), F.lit(0)).cast("bigint").alias("chunks"),
        F.count_if(~loaded).alias("review"),
    )


def latest_loaded(lineage: DataFrame) -> DataFrame:
    """``source_file, run_id`` of every file whose latest run loaded it."""
    last = F.max(F.struct("processed_at", "run_id", "decision")).alias("last")
    return (
        lineage.groupBy("source_file")
        .agg(last)
        .where("last.decision = 'LOAD'")
        .select("source_file", F.col("last.run_id").alias("run_id"))
    )


def current_rows(table: DataFrame, lineage: DataFrame) -> DataFrame:
    """Rows of the latest loaded run of each file."""
    return table.join(latest_loaded(lineage), ["source_file", "run_id"], "left_semi")


def lineage_report(lineage: DataFrame) -> DataFrame:
    return lineage.orderBy("processed_at", "source_file").select(
        "source_file", "file_type", "decision", "records_loaded", "quality_score", "pii_types", "quarantined"
    )


def content_digest(result: RefineResult) -> str:
    """A digest of what a batch says and brings, whatever the order of its rows and the time of the run."""
    parts = []
    for name, df in [("decisions", result.decisions), *sorted(result.records.items())]:
        # Numbers of header plans are a run's own.
        told = sorted(set(df.columns) - {"plan_id"})
        hashes = df.select(F.xxhash64(*told).alias("h"), F.xxhash64(F.lit(7), *told).alias("g"))
        sums = hashes.agg(F.count(F.lit(1)), *(F.sum(F.col(c).cast("decimal(38,0)")) for c in "hg")).first()
        parts.append(":".join([name, *map(str, sums)]))
    return "|".join(parts)


class Warehouse:
    """Typed tables, chunks and lineage under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str):
        """A folder's path and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self, name: str) -> DataFrame:
        path, fs = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def runs(self) -> DataFrame:
        """``number``, ``run_id``, ``digest`` of the counted runs; a row a run."""
        path, fs = self._path("runs")
        schema = "number bigint, run_id string, digest string"
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/runs").where("run_id IS NOT NULL")

    def _count(self, run_id: str, digest: str) -> None:
        """Enter a run into the log under the first number that no other run takes."""
        path, fs = self._path("runs")
        taken = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(path)] if fs.exists(path) else []
        number = max(taken, default=0) + 1
        while True:
            entry, _ = self._path(f"runs/{number:012d}.json")
            try:
                out = fs.create(entry, False)
            except Py4JJavaError as error:
                if "AlreadyExists" not in error.java_exception.getClass().getName():
                    raise
                number += 1
                continue
            try:
                out.write(json.dumps({"number": number, "run_id": run_id, "digest": digest}).encode())
            finally:
                out.close()
            return

    def _append(self, name: str, df: DataFrame, run_id: str) -> None:
        out = df.withColumn("run_id", F.lit(run_id)).select(*SCHEMA_COLUMNS[name])
        out.write.mode("append").partitionBy("run_id").parquet(f"{self.root}/{name}")

    def load(self, result: RefineResult, embedder=hash_embed, retry: bool = False) -> DataFrame:
        """Append one batch; returns the counts per destination.

        With ``retry``, a batch that says and brings what the last counted run did is that run, and isn't written again.
        """
        digest = content_digest(result)
        last = self.runs().orderBy(F.desc("number")).first() if retry else None
        if last and last["digest"] == digest:
            return load_counts(result.decisions)
        run_id = new_run_id()
        for kind, df in result.loaded().items():
            self._append(kind, df, run_id)
        self._append("chunks", result.chunks(embedder), run_id)
        self._append("issues", result.issues, run_id)
        rows = lineage_rows(result.decisions, result.issues)
        self._append("lineage", rows.withColumn("processed_at", F.current_timestamp()), run_id)
        self._count(run_id, digest)
        return load_counts(result.decisions)

    def lineage(self) -> DataFrame:
        """What every counted run did with each file."""
        return self._stored("lineage").join(self.runs().select("run_id"), "run_id", "left_semi").select(*SCHEMA_COLUMNS["lineage"])

    def lineage_report(self) -> DataFrame:
        return lineage_report(self.lineage())

    def issues(self) -> DataFrame:
        return self._stored("issues").join(self.runs().select("run_id"), "run_id", "left_semi").select(*SCHEMA_COLUMNS["issues"])

    def table(self, name: str) -> DataFrame:
        """Current rows of a data table, in stored column order."""
        rows = current_rows(self._stored(name), self.lineage())
        if name == "chunks":
            return rows.select("source_file", "chunk_ord", *TABLE_COLUMNS["chunks"])
        return rows.select(*TABLE_COLUMNS[name], "source_file")

    def register_views(self) -> None:
        """Temporary views for plain SQL over the tables."""
        for name in DATA_TABLES:
            self.table(name).createOrReplaceTempView(name)
        self.lineage().createOrReplaceTempView("lineage")

    def search(self, question: str, k: int = DEFAULT_TOP_K, embedder=hash_embed) -> DataFrame:
        return search(self.table("chunks"), question, k, embedder)

    def search_batch(self, questions: DataFrame, k: int = DEFAULT_TOP_K, embedder=hash_embed) -> DataFrame:
        return search_batch(self.table("chunks"), questions, k, embedder)

    def answer(self, question: str, k: int = DEFAULT_TOP_K, embedder=hash_embed) -> DataFrame:
        return answer(self.table("chunks"), question, k, embedder)

    def compact(self, target: str) -> Warehouse:
        """Copy current rows and all lineage to a fresh folder, without the
        superseded rows, so that those can be erased with the old folder."""
        for name in DATA_TABLES:
            rows = current_rows(self._stored(name), self.lineage())
            rows.write.partitionBy("run_id").parquet(f"{target}/{name}")
        for name, rows in (("issues", self.issues()), ("lineage", self.lineage())):
            rows.write.partitionBy("run_id").parquet(f"{target}/{name}")
        compacted = Warehouse(self.spark, target)
        for run in self.runs().orderBy("number").collect():
            compacted._count(run["run_id"], run["digest"])
        return compacted
