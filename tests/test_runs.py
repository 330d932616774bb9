"""The log of runs: crashes between any two writes, two runs at once, a run that is repeated."""

import pytest

from gristmill.plans.refine import refine
from gristmill.sinks.warehouse import Warehouse
from fixtures import CLEAN_CSV, INVOICE_TEXTS, MAILS


def batch(spark, folder, extra=""):
    folder.mkdir(exist_ok=True)
    (folder / "clean.csv").write_text(CLEAN_CSV + extra)
    (folder / "emails.txt").write_text(MAILS)
    (folder / INVOICE_TEXTS[0][0]).write_bytes(b"%PDF-1.4")
    texts = spark.createDataFrame(INVOICE_TEXTS[:1], "source_file string, raw_text string")
    return refine(spark, str(folder), texts=texts)


def seen(warehouse):
    names = ("transactions", "invoices", "documents", "chunks")
    return {name: sorted(map(str, warehouse.table(name).collect())) for name in names} | {
        "issues": sorted(str(r[:-1]) for r in warehouse.issues().collect()),
        "lineage": sorted(str((r["source_file"], r["decision"], r["records_loaded"])) for r in warehouse.lineage().collect()),
    }


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    return batch(spark, root / "one"), batch(spark, root / "two", "K-703,2026-06-09,1.25,AED,Night Bus,transport\nK-704,never,n/a,AED,x,y\n")


def test_a_crash_anywhere_leaves_what_was_there(spark, tmp_path, batches, monkeypatch):
    one, two = batches
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(one)
    before, append, count = seen(warehouse), Warehouse._append, Warehouse._count
    # Three tables of records, chunks, issues, lineage, and then the entry that makes the run count.
    for crash_at in range(7):
        calls = []

        def failing(self, *given, step=append):
            if len(calls) == crash_at:
                raise RuntimeError("lost")
            calls.append(given[0])
            return step(self, *given)

        monkeypatch.setattr(Warehouse, "_append", failing)
        monkeypatch.setattr(Warehouse, "_count", lambda self, *given: failing(self, *given, step=count))
        with pytest.raises(RuntimeError):
            warehouse.load(two)
        monkeypatch.undo()
        if crash_at in (0, 3, 6):
            assert seen(warehouse) == before
    warehouse.load(two)
    after = seen(warehouse)
    assert after != before and len(after["transactions"]) == 0 and len(after["invoices"]) == 1
    assert warehouse.runs().count() == 2


def test_a_repeated_run_is_not_written_again(spark, tmp_path, batches):
    one, two = batches
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    counts = [warehouse.load(b, retry=True).first() for b in (one, one, two, one)]
    assert counts[0] == counts[1] == counts[3]
    assert [r["number"] for r in warehouse.runs().orderBy("number").collect()] == [1, 2, 3]
    # A load that isn't called a retry is another run.
    warehouse.load(one)
    assert warehouse.runs().count() == 4
    alone = Warehouse(spark, str(tmp_path / "alone"))
    alone.load(one)
    again = {k: v for k, v in seen(warehouse).items() if k not in ("issues", "lineage")}
    assert again == {k: v for k, v in seen(alone).items() if k not in ("issues", "lineage")}
    assert seen(warehouse.compact(str(tmp_path / "compact"))) == seen(warehouse)


def test_two_runs_at_once_both_count(spark, tmp_path, batches, monkeypatch):
    one, two = batches
    first, second = (Warehouse(spark, str(tmp_path / "wh")) for _ in range(2))
    count = Warehouse._count

    def late(self, run_id, digest):
        # The other job enters the log after this one has looked at it.
        path, fs = self._path("runs")
        monkeypatch.setattr(Warehouse, "_count", count)
        second.load(two)
        assert fs.exists(path)
        count(self, run_id, digest)

    monkeypatch.setattr(Warehouse, "_count", late)
    first.load(one)
    assert sorted(r["number"] for r in first.runs().collect()) == [1, 2]
    # Each file's rows are those of one run, the one that was written last.
    alone = Warehouse(spark, str(tmp_path / "alone"))
    alone.load(two)
    tables = ("transactions", "invoices", "documents", "chunks")
    assert {k: seen(first)[k] for k in tables} == {k: seen(alone)[k] for k in tables}
