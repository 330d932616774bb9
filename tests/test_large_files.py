"""Files bigger than a split are read by many tasks and come out the same."""

import csv
import io
import random

import pytest

from gristmill.plans.refine import OVERSIZE, refine
from gristmill.sources import segments
from gristmill.sources.csv_feed import read_feeds
from gristmill.sources.listing import list_files

HEADER = ["txn_id", "date", "amount", "currency", "merchant", "category"]


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def csv_text(n):
    rng = random.Random(3)
    names = ["plain", 'quo"ted', "two\nlines", "a,b", "\n\n", 'x"\n"y', "", "long " * 60 + "\nend", "é"]
    rows = [[f"T-{i}", "2026-06-02", f"{i}.5", "AED", rng.choice(names), "g"] for i in range(n)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(HEADER)
    writer.writerows(rows)
    return out.getvalue(), rows


def test_delimited_file_with_quoted_line_breaks(spark, tmp_path, tiny_splits):
    text, rows = csv_text(300)
    (tmp_path / "big.csv").write_text(text)
    done = refine(spark, str(tmp_path))
    got = done.records["transactions"].orderBy("pos").select(*HEADER).collect()
    assert [(r["txn_id"], r["amount"], r["merchant"]) for r in got] == [(r[0], float(r[2]), r[4]) for r in rows]
    assert done.decisions.first()["action"] == "LOAD"


def test_mail_export(spark, tmp_path, tiny_splits):
    rng = random.Random(5)
    blocks = [
        f"From: p{i}@mail.example\nSubject: s{i}\n---\n" + "\n".join(f"line {j} 055-987-6543" for j in range(rng.randint(1, 30)))
        for i in range(60)
    ]
    text = "\n=====\n".join(blocks) + "\n====  \n\n=====\n"
    (tmp_path / "big.txt").write_text(text)
    big = refine(spark, str(tmp_path))
    rows = big.records["documents"].orderBy("pos").collect()
    assert [r["subject"] for r in rows] == [f"s{i}" for i in range(60)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
    whole = refine(spark, str(tmp_path))
    same = whole.records["documents"].orderBy("pos").collect()
    assert [(r["sender"], r["body"]) for r in rows] == [(r["sender"], r["body"]) for r in same]
    kept = ["audit", "n_findings", "quality_score"]
    assert big.decisions.select(*kept).first() == whole.decisions.select(*kept).first()


def test_stray_quotes_are_text(spark, tmp_path, tiny_splits):
    rng = random.Random(11)
    cells = ['5" pipe', 'a"', '"x"y', '"two\nlines"', '"q""q"', '"', '""', 'x""y"', '"open\n\n5" pipe, "', '"a,b\n"z', "plain", '"m\n""\nn"']
    cells.remove('"')  # would quote the rest of the file
    lines = [",".join(HEADER)] + [f"T-{i},2026-06-02,{i},AED,{rng.choice(cells)},{rng.choice(cells)}" for i in range(400)]
    text = "\n".join(lines) + "\n"
    (tmp_path / "big.csv").write_text(text)
    rows = list(csv.reader(io.StringIO(text, newline="")))[1:]
    found = read_feeds(spark, list_files(spark, str(tmp_path))).feeds.rows.orderBy("pos").collect()
    assert [r["values"] for r in found] == [(r + [""] * 6)[:6] for r in rows if r]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    whole = read_feeds(spark, list_files(spark, str(tmp_path))).feeds.rows.orderBy("pos").collect()
    starts = []
    reader = csv.reader(io.StringIO(text, newline=""))
    before = 0
    for _ in reader:
        starts.append(before)
        before = reader.line_num
    # In one split a record's place is the number of its first line; the header is the first.
    assert [r["values"] for r in whole] == [r["values"] for r in found] and [r["pos"] - 1 for r in whole] == starts[1:]


def test_record_too_long_goes_to_review(spark, tmp_path, tiny_splits, monkeypatch):
    monkeypatch.setattr(segments.oversize_files, "__defaults__", (2000,))
    (tmp_path / "open.csv").write_text(csv_text(30)[0] + 'T-x,2026-06-02,1,AED,"never closed,g\n' + "T-y,2026-06-02,1,AED,m,g\n" * 200)
    (tmp_path / "one.txt").write_text("From: a\nSubject: b\n---\n" + "no break here\n" * 300)
    got = {r["source_file"]: r for r in refine(spark, str(tmp_path)).decisions.collect()}
    for name in ("open.csv", "one.txt"):
        assert got[name]["action"] == "REVIEW" and got[name]["plan_issues"] == [OVERSIZE]
    assert got["one.txt"]["file_type"] == "email"


def test_headers_are_found_whatever_the_split_size(spark, tmp_path):
    body = "".join(f"T-{i},2026-06-02,{i}.5,AED,shop {i},g\n" for i in range(40))
    wide = ",".join(f"x{k:04d}" + "y" * 300 for k in range(250))
    plain = ",".join(HEADER)
    (tmp_path / "blank.csv").write_text("\n\n" + plain + "\n" + body)
    (tmp_path / "wide.csv").write_text(wide + "," + plain + "\n" + "".join("," * 250 + line + "\n" for line in body.splitlines()))
    (tmp_path / "quoted.csv").write_text(plain + ',"no\nte"\n' + "".join(line + ",n\n" for line in body.splitlines()))
    (tmp_path / "crlf.csv").write_bytes((plain + "\n" + body).replace("\n", "\r\n").encode())
    seen = []
    for size in ("700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            done = refine(spark, str(tmp_path))
            decisions = done.decisions.orderBy("source_file").select("source_file", "action", "quality_score", "n_records", "fixes").collect()
            records = sorted(tuple(r) for r in done.records["transactions"].select("source_file", *HEADER).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        seen.append((decisions, records))
    assert [tuple(r)[:4] for r in seen[0][0]] == [tuple(r)[:4] for r in seen[1][0]]
    assert seen[0] == seen[1]
    got = {r["source_file"]: r for r in seen[0][0]}
    assert all(r["n_records"] == 40 and r["action"] == "LOAD" for r in got.values())
    assert got["wide.csv"]["fixes"][-1].endswith("x0249" + "y" * 300) and any("no\nte" in f for f in got["quoted.csv"]["fixes"])
