"""One parser for delimited files of any size, against the standard reader, and headers as data."""

import csv
import io
import random

import pytest

from gristmill.contracts import TRANSACTIONS
from gristmill.operators.profile import profile
from gristmill.operators.repair import Feeds, header_table, plan_header, plan_table, repair_and_redact
from gristmill.plans.refine import refine
from gristmill.sources.csv_feed import read_feeds
from gristmill.sources.listing import list_files

HEADER = ["txn_id", "date", "amount", "currency", "merchant", "category"]
SIZES = ("150", "128m")


def at_sizes(spark, make):
    out = []
    for size in SIZES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            out.append(make())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(x == out[0] for x in out)
    return out[0]


def parsed(spark, folder):
    def make():
        source = read_feeds(spark, list_files(spark, str(folder)))
        headers = {r["plan_id"]: r["header"] for r in source.feeds.headers.collect()}
        found = {}
        for r in source.feeds.rows.orderBy("source_file", "pos").collect():
            found.setdefault(r["source_file"], [headers[r["plan_id"]]]).append(r["values"])
        return found, source.invalid, source.oversize

    return at_sizes(spark, make)


def standard(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r and not (len(r) == 1 and r[0] and not r[0].strip(" "))]
    width = len(rows[0])
    return [rows[0], *((r + [""] * width)[:width] for r in rows[1:])]


def test_random_files_at_any_split_size(spark, tmp_path):
    cells = ["", "a", '"q"', '"a,b"', '"two\nlines"', '"x""y"', 'in"side', '""', '"\n\n"', '"a\n"b', " ", '"é\nü"', "z" * 90, '"' + "long\n" * 30 + '"', '"only, ""quoted"" "']
    want = {}
    for k in range(4):
        rng = random.Random(k)
        lines = ["one,two,three"] + [",".join(rng.choice(cells) for _ in range(rng.randint(1, 4))) for _ in range(25)]
        text = "\n".join(lines) + rng.choice(["", "\n", "\n\n"])
        (tmp_path / f"f{k}.csv").write_text(text)
        want[f"f{k}.csv"] = standard(text)
    found, invalid, oversize = parsed(spark, tmp_path)
    assert found == want and invalid == oversize == []


def test_odd_headers(spark, tmp_path):
    body = "".join(f"T-{i},2026-06-02,{i}.5,AED,shop {i},g\n" for i in range(4))
    plain = ",".join(HEADER)
    texts = {
        "stray.csv": plain + ',size 5"\n' + body,
        "stray2.csv": plain + ',5" by 6",x\n' + body,
        "wide.csv": plain + "," + ",".join(f"c{k}" * 40 for k in range(12)) + "\n" + body,
        "broken.csv": plain + ',"no\nte","a\n\nb"\n' + body,
        "blank.csv": "\n  \n\n" + plain + "\n" + body,
        "open.csv": plain + ',"never closed\n' + body,
        "tail.csv": plain + "\n" + body + 'T-x,2026-06-02,1,AED,"left open,g\nmore\n',
        "quoted.csv": ",".join(f'"{c}"' for c in HEADER) + "\n" + body,
        "one.csv": plain,
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found, _, _ = parsed(spark, tmp_path)
    for name, text in texts.items():
        want = standard(text)
        assert found.get(name) == (want if len(want) > 1 else None), name


def test_a_stray_quote_stops_no_batch(spark, tmp_path):
    (tmp_path / "good.csv").write_text(",".join(HEADER) + "\nT-1,2026-06-02,1.5,AED,shop,g\n")
    (tmp_path / "stray.csv").write_text(",".join(HEADER) + ',size 5"\nT-2,2026-06-02,2.5,AED,shop,g,7\n')
    (tmp_path / "open.csv").write_text(",".join(HEADER) + ',"never closed\nT-3,2026-06-02,2.5,AED,shop,g,7\n')
    (tmp_path / "bad.csv").write_bytes(",".join(HEADER).encode() + b"\nT-4,2026-06-02,1,AED,caf\xe9,g\n")

    def make():
        done = refine(spark, str(tmp_path))
        rows = done.decisions.orderBy("source_file").select("source_file", "action", "method", "n_records", "fixes", "plan_issues").collect()
        return [tuple(r) for r in rows], [tuple(r) for r in done.profiles().orderBy("source_file").select("source_file", "row_count", "columns", "null_rates").collect()]

    decisions, profiles = at_sizes(spark, make)
    assert [d[:4] for d in decisions] == [("bad.csv", "REVIEW", "csv", 0), ("good.csv", "LOAD", "csv", 1), ("open.csv", "REVIEW", "csv+fixers", 0), ("stray.csv", "LOAD", "csv+fixers", 1)]
    assert decisions[3][4] == ['dropped unexpected column(s): size 5"']
    assert [p[1] for p in profiles] == [0, 1, 0, 1] and profiles[3][2] == [*HEADER, 'size 5"'] and profiles[3][3]['size 5"'] == 0.0


def plan_size(frame):
    return len(frame._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_thousands_of_headers_are_one_plan(spark):
    def feeds(n):
        headers = [("transaction_id", "transaction_date", f"extra {k}", "amount_aed", "merchant_name")[:: 1 if k % 2 else -1] for k in range(n)]
        rows = [(f"f{k}.csv", 0, k, [dict(zip(h, ("T", "03/07/2026", "x", "1,150.00", "m"))).get(c) for c in h]) for k, h in enumerate(headers)]
        rows = [(f, p, k, ["T" if "id" in c else "03/07/2026" if "date" in c else "1,150.00" if "amount" in c else "x" for c in headers[k]]) for f, p, k, _ in rows]
        return Feeds(spark.createDataFrame(rows, "source_file string, pos long, plan_id long, values array<string>"), header_table(spark, headers))

    few, many = (feeds(n) for n in (2, 5000))
    # Headers that are data are planned where they are, and give what headers at hand give.
    told = plan_table(spark, [r["header"] for r in few.headers.orderBy("plan_id").collect()], TRANSACTIONS)
    assert sorted(map(str, plan_table(spark, few.headers, TRANSACTIONS).collect())) == sorted(map(str, told.collect()))
    assert plan_size(repair_and_redact(few, TRANSACTIONS)) == plan_size(repair_and_redact(many, TRANSACTIONS))
    got = repair_and_redact(many, TRANSACTIONS).select("txn_id", "date", "amount", "currency", "drifted").distinct().collect()
    assert [tuple(r) for r in got] == [("T", "2026-07-03", 1150.0, "AED", True)]
    assert plan_size(profile(few)) == plan_size(profile(many)) and profile(many).count() == 5000


@pytest.mark.parametrize("header", [("a", "b", "a"), ("txn_id", "x", "x", "y"), ("date",)])
def test_profile_of_repeated_names(spark, header):
    rows = [("f.csv", k, 0, ["" if (k + j) % 3 == 0 else "v" for j in range(len(header))]) for k in range(9)]
    feeds = Feeds(spark.createDataFrame(rows, "source_file string, pos long, plan_id long, values array<string>"), header_table(spark, [header]))
    (got,) = profile(feeds).collect()
    want = {name: round(sum(not r[3][j] for r in rows) / 9, 3) for j, name in enumerate(header)}
    assert got["row_count"] == 9 and got["columns"] == list(dict.fromkeys(header)) and got["null_rates"] == want
    assert plan_header(header, TRANSACTIONS).header == header
