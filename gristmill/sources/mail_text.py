"""Mailbox exports as messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import MAIL_MARKS, SNIFF_CHARS
from ..operators.mail import keep_messages, normalise_newlines
from .listing import Listing, SourceFile, file_name, read_head, read_small, read_text
from .segments import join_lines, oversize_files, read_lines, running_total

BREAK_LINE = r"^={3,}[\s\x1c-\x1f]*$"


def _valid(text):
    """Invalid bytes are dropped."""
    cleaned = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def read_texts(spark: SparkSession, listing: Listing, named: list[SourceFile]) -> DataFrame | None:
    """Whole texts of the small files of a listing and of others up to one split: ``source_file, raw_text``."""
    parts = []
    if named:
        parts.append(read_text(spark, named, file_name().alias("source_file"), F.col("value"), wholetext=True))
    if listing.n_small:
        texts = read_small(listing.small_names(), listing.path, lambda name, content: ([name], [content]), "source_file string, value binary")
        parts.append(texts.withColumn("value", F.col("value").cast("string")))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).select("source_file", normalise_newlines(_valid(F.col("value"))).alias("raw_text"))


def sniff_head(spark: SparkSession, file: SourceFile) -> bool:
    """The same test on the head of a file bigger than a split."""
    text = read_head(spark, file).decode("utf-8", errors="ignore")
    head = text.replace("\r\n", "\n").replace("\r", "\n")[:SNIFF_CHARS]
    return all(mark in head for mark in MAIL_MARKS)


def _numbered_lines(spark: SparkSession, files: list[SourceFile]) -> DataFrame:
    is_break = F.col("line").rlike("(?U)" + BREAK_LINE)
    lines = read_lines(spark, files).withColumn("line", _valid(F.col("line")))
    return running_total(lines, is_break, "message").where(~is_break)


def oversize_exports(spark: SparkSession, files: list[SourceFile]) -> list[str]:
    """Exports with a message too long to be one value."""
    return oversize_files(_numbered_lines(spark, files), "message")


def large_messages(spark: SparkSession, files: list[SourceFile]) -> DataFrame:
    """Messages of exports bigger than a split, read as lines by many tasks."""
    joined = join_lines(_numbered_lines(spark, files), "message")
    return keep_messages(joined.select("source_file", "pos", F.col("text").alias("piece")))
