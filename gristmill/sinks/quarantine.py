"""Originals that hold personal data, set aside with their findings.

The target must be a restricted location: it is the only place that receives
unredacted content.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.refine import RefineResult
from ..session import local_frame
from ..sources.listing import ENDINGS, Listing, file_name, read_small, read_text, text_lines


def quarantine(spark: SparkSession, result: RefineResult, target: str) -> None:
    """Write flagged originals and their findings under ``target``.

    * ``originals``: the lines of every flagged file, of any size and kind, as
      bytes with the file's length; ``block`` and ``seq`` give their order;
    * ``findings``: one row per finding.
    """
    flagged = result.decisions.where("quarantine").select("source_file")
    if not flagged.isEmpty():
        _originals(spark, result.files.only(*ENDINGS), flagged).write.mode("append").parquet(f"{target}/originals")
    findings_of_flagged(result).write.mode("append").parquet(f"{target}/findings")


def _originals(spark: SparkSession, files: Listing, flagged: DataFrame) -> DataFrame:
    parts = [local_frame(spark, [], "source_file string, length bigint, block bigint, seq bigint, line binary")]
    named = local_frame(spark, [(f.name,) for f in files.named], "source_file string")
    names = {r["source_file"] for r in named.join(flagged, "source_file", "left_semi").collect()} if files.named else set()
    if names:
        columns = [
            file_name().alias("source_file"),
            F.col("_metadata.file_size").alias("length"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").cast("binary").alias("line"),
        ]
        parts.append(read_text(spark, [f for f in files.named if f.name in names], *columns, lineSep="\n"))
    if files.n_small:

        def rows(name, content):
            lines = text_lines(content, line_feeds=True)
            return [name] * len(lines), [len(content)] * len(lines), [0] * len(lines), [*range(len(lines))], lines

        small = files.small_names(flagged)
        parts.append(read_small(small, files.path, rows, "source_file string, length bigint, block bigint, seq bigint, line binary"))
    return reduce(DataFrame.unionByName, parts)


def findings_of_flagged(result: RefineResult) -> DataFrame:
    flagged = result.decisions.where("quarantine").select("source_file")
    return result.findings.join(flagged, "source_file", "left_semi")


def original(originals: DataFrame, source_file: str) -> DataFrame:
    """The lines of one original in order; joined by line feeds and, where the
    length asks for one more, closed by one, they are the file's bytes."""
    return originals.where(F.col("source_file") == source_file).orderBy("block", "seq").select("line", "length")


def findings_json(findings: DataFrame) -> DataFrame:
    """The findings report of each file as one JSON text, in scan order."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "rank", "pos", "ord", "type", "preview")))
    shown = F.transform("ordered", lambda f: F.struct(f["type"].alias("type"), f["preview"].alias("preview")))
    return (
        findings.groupBy("source_file").agg(ordered.alias("ordered"))
        .select("source_file", F.to_json(shown).alias("findings"))
    )
