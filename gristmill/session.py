"""Session helpers: builder defaults, shared scratch folder, staging, spreading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def build_session(master: str | None = None, app: str = "gristmill", **conf) -> SparkSession:
    """A session with the settings the jobs rely on (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call-site capture costs several driver round trips per expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Raw text may reach shuffle and spill files, so scratch data is encrypted.
        .config("spark.io.encryption.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, once an application: they get it as a
    zip from the driver, so nothing needs to be installed on them."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gristmill-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own: on a
    cluster a machine-local folder would be lost with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        checkpoint_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = checkpoint_dir.get() if checkpoint_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="gristmill-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared scratch folder and
    read it back, so that everything derived from it prunes columns instead of
    re-running the plan, and a lost executor costs no recomputation."""
    path = f"{scratch_root(df.sparkSession)}/gristmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of a batch between Spark and a Python worker, and what Spark's own setting is where nobody has chosen one.
BATCH_BYTES, UNSET = 4 << 20, "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts don't meet in a worker ten thousand at a time; a chosen size stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, UNSET) == UNSET:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side metadata as a table whose size the planner knows, so a small
    one is broadcast and a big one is not."""
    struct = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct]
    arrow = to_arrow_schema(struct)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, struct)


def spread(df: DataFrame) -> DataFrame:
    """Spread a *small* input over all cores before per-row heavy work.

    A small Parquet input is often one row group, hence one task.  The
    estimate is the scan's own size statistic; anything larger than one
    default split per core already has enough splits and is left alone, so no
    large input is ever shuffled by this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * split else df
