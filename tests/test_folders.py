"""Many files are read by one listing of their folder, with the rows that paths of their own give."""

import pytest
from pyspark.sql import functions as F

from gristmill.catalog.batch_queries import supplier_files
from gristmill.plans.refine import refine
from gristmill.sinks.quarantine import quarantine
from gristmill.sources import listing
from gristmill.sources.csv_feed import read_feeds
from gristmill.sources.listing import SourceFile, file_name, list_files, read_text

HEAD = "txn_id,date,amount,currency,merchant,category\n"


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in [a=1] b%"
    folder.mkdir()
    for i in range(6):
        (folder / f"f {i}+%.csv").write_text(HEAD + f'T-{i},2026-06-02,{i}.5,AED,"shop\n{i}",g\n' + 'T-x,2026-06-02,1,AED,"left open,g\n' * (i == 5))
        (folder / f"m{i}.txt").write_text(f"From: p{i}@mail.example\nSubject: s{i}\nDate: 2026-01-01\n---\nhello {i}")
    (folder / "upper.CSV").write_text(HEAD + "T-u,2026-06-02,1,AED,s,g\n")
    (folder / "latin.csv").write_bytes((HEAD + "T-l,2026-06-02,1,AED,caf\xe9,g\n").encode("latin-1"))
    for name in ("_hidden.csv", "_a=b.csv", ".dot.csv"):
        (folder / name).write_text(HEAD + "T-h,2026-06-02,1,AED,s,g\n")
    (folder / "empty.csv").write_text("")
    (folder / "noend").write_text("x\n")
    return folder


def outcome(spark, folder, target):
    done = refine(spark, str(folder))
    quarantine(spark, done, target)
    rows = [done.decisions.drop("method"), *done.records.values(), done.findings, spark.read.parquet(f"{target}/originals").drop("seq")]
    return [sorted(map(str, df.drop("plan_id").collect())) for df in rows]


def test_same_rows_as_from_paths(spark, inbox, tmp_path, monkeypatch):
    by_path = outcome(spark, inbox, f"{tmp_path}/q0")
    monkeypatch.setattr(listing, "NAMED", 1)
    assert outcome(spark, inbox, f"{tmp_path}/q1") == by_path


def test_many_files_are_one_path(spark, inbox, monkeypatch):
    monkeypatch.setattr(listing, "NAMED", 2)
    named = []
    monkeypatch.setattr(listing, "read_paths", lambda files: named.extend(f.name for f in files) or listing._literal(files[0].uri))
    mails = [f for f in list_files(spark, str(inbox)) if f.name.endswith(".txt")]
    assert read_text(spark, mails, file_name().alias("f")).distinct().count() == 6 and not named
    # Others of the ending are left out, and a folder with folders inside is read by paths.
    assert {r["f"] for r in read_text(spark, mails[:4], file_name().alias("f")).collect()} == {f"m{i}.txt" for i in range(4)} and not named
    (inbox / "sub").mkdir()
    read_text(spark, [f for f in list_files(spark, str(inbox)) if f.name.endswith(".txt")], file_name().alias("f"))
    assert len(named) == 6


def test_listing_of_this_machine_is_that_of_the_file_system(spark, inbox, monkeypatch):
    (inbox / "link.txt").symlink_to(inbox / "m0.txt")
    (inbox / "gone.txt").symlink_to(inbox / "nowhere")
    (inbox / "sub").mkdir()
    own = list_files(spark, str(inbox))
    monkeypatch.setattr(listing, "_local_files", lambda root: None)
    asked = list_files(spark, str(inbox))
    assert [(f.name, f.size) for f in own] == [(f.name, f.size) for f in asked]
    assert listing.read_paths(own) == listing.read_paths(asked)


def test_splits_are_the_same_in_every_pass(spark, tmp_path):
    """A file that is left out after the first pass moves no split of the others."""
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        row = 'T-{},2026-06-02,1,AED,"two\nlines, and more of them\n",g\n'
        (tmp_path / "good.csv").write_text(HEAD + "".join(row.format(i) for i in range(400)))
        (tmp_path / "bad.csv").write_bytes((HEAD + "caf\xe9\n" * 3000).encode("latin-1"))
        source = read_feeds(spark, list_files(spark, str(tmp_path)))
        assert source.invalid == ["bad.csv"]
        assert [r["values"][0] for r in source.feeds.rows.orderBy("pos").collect()] == [f"T-{i}" for i in range(400)]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_without_a_folder_are_named(spark, inbox):
    files = [SourceFile(f.name, f.uri, f.size) for f in list_files(spark, str(inbox)) if f.name.startswith("m")]
    assert read_text(spark, files, file_name().alias("f")).distinct().count() == 6


def test_many_others_are_dropped_by_a_join(spark, inbox, monkeypatch):
    """Files among many others of their ending are one path too, unless the others are bigger than they are."""
    monkeypatch.setattr(listing, "NAMED", 1)
    monkeypatch.setattr(listing, "LEFT_OUT", 1)
    named = []
    monkeypatch.setattr(listing, "read_paths", lambda files: named.extend(f.name for f in files) or listing._literal(files[0].uri))
    mails = [f for f in list_files(spark, str(inbox)) if f.name.endswith(".txt")]
    columns = file_name().alias("f"), F.col("_metadata.file_block_start").alias("block"), F.col("value")
    rows = read_text(spark, mails[:4], *columns, lineSep="\n").collect()
    assert not named and sorted(map(tuple, rows)) == [(f"m{i}.txt", 0, line) for i in range(4) for line in sorted((inbox / f"m{i}.txt").read_text().split("\n"))]
    read_text(spark, mails[:2], *columns)
    assert named == ["m0.txt", "m1.txt"]


def test_files_of_one_small_table_are_written_by_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id AS s_suppkey", "'n' AS s_name", "1.0D AS s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = supplier_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() > 1 and files.select("source_file").distinct().count() == 40
