"""Records that span lines, cut out of files of any size.

A file larger than a split is read as lines by many tasks.  Where a record
starts depends on what came before, so the number of breaks before each line
is built in two levels: a running count inside a split (a window over one
split, never over a file) and the total of the splits before it (one row per
split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .listing import SourceFile, file_name, read_paths


def read_lines(spark: SparkSession, files: list[SourceFile]) -> DataFrame:
    """``source_file, block, pos, line``; ``pos`` grows through the file.

    A split of n bytes has at most n lines, so the split's offset plus the
    line's number inside it is unique and ordered over the whole file.
    """
    raw = spark.read.text(read_paths(files)).select(
        file_name().alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    inside = Window.partitionBy("source_file", "block").orderBy("seq")
    return raw.select(
        "source_file", "block", (F.col("block") + F.row_number().over(inside)).alias("pos"), "line"
    )


def running_total(lines: DataFrame, weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all earlier lines of the file."""
    weighted = lines.withColumn("__w", weight.cast("bigint"))
    per_split = weighted.groupBy("source_file", "block").agg(F.sum("__w").alias("__n"))
    # One row per split: a file's splits are few even when the file is huge.
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select(
        "source_file", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = (
        Window.partitionBy("source_file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        weighted.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
        .join(offsets, ["source_file", "block"])
        .withColumn(name, F.col("__in") + F.col("__before"))
        .drop("__w", "__in", "__before")
    )


# A record longer than this cannot be one value; its file goes to review.
RECORD_LIMIT = 256 << 20


def oversize_files(lines: DataFrame, record: str, limit: int = RECORD_LIMIT) -> list[str]:
    """Names of files with a record too long to be put together.  Lengths (of
    lines, or given as ``bytes``) are summed before anything is gathered."""
    size = F.col("bytes") if "bytes" in lines.columns else F.length("line") + 1
    long = (
        lines.groupBy("source_file", record)
        .agg(F.sum(size).alias("n"))
        .where(F.col("n") > limit)
        .select("source_file")
        .distinct()
    )
    return sorted(r["source_file"] for r in long.collect())


def join_lines(lines: DataFrame, record: str) -> DataFrame:
    """Lines of equal ``record`` put together again: ``source_file, record, pos, text``."""
    return (
        lines.groupBy("source_file", record)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
        .select(
            "source_file",
            record,
            F.col("ls")[0]["pos"].alias("pos"),
            F.array_join(F.transform("ls", lambda p: p["line"]), "\n").alias("text"),
        )
    )
