"""A run that stops after any of its appends leaves nothing that is seen, and can be repeated."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from stowage.plans import jobs
from stowage.sources import CatalogueStore
from stowage.sources import store as store_module

AT = datetime.datetime(2024, 3, 1)
TABLES = list(CatalogueStore.LAYOUT)


class Crash(Exception):
    pass


def crashing(monkeypatch, after):
    """Appends succeed ``after`` times, then the process dies; at that count commits die too."""
    left, plain, commit = [after], store_module.Run.append, store_module.Run.commit

    def append(self, table, rows):
        if not left[0]:
            raise Crash
        left[0] -= 1
        plain(self, table, rows)

    def last(self):
        if not left[0]:
            raise Crash
        commit(self)

    monkeypatch.setattr(store_module.Run, "append", append)
    monkeypatch.setattr(store_module.Run, "commit", last)


def seen(store):
    return {t: store.read(t).count() for t in TABLES}


@pytest.fixture
def store(spark, tmp_path):
    root = tmp_path / "files"
    for name, text in {"a.txt": "same", "b/c.txt": "same", "b/d.py": "other", "b/Code/e.py": "in place"}.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_text(text)
    found = CatalogueStore(spark, str(tmp_path / "store"))
    found.tree = str(root)
    return found


def test_every_stop_of_every_run(spark, store, monkeypatch):
    def scan():
        return jobs.run_scan(store, store.tree, AT, scan_id="s")

    def dedupe():
        return jobs.run_dedupe(store, "s", AT + datetime.timedelta(days=1), "keep-oldest", trash=store.tree + "/.trash", transaction_id="d")

    def rollback():
        acts = store.actions().filter("transaction_id = 'd'")
        return jobs.run_rollback(store, "d", acts.select(F.col("to_path").alias("path")), AT + datetime.timedelta(days=2), rollback_id="r")

    for run, appends, rows in ((scan, 4, {"file_records": 4, "scans": 1}), (dedupe, 2, {"actions": 1, "transactions": 1}),
                               (rollback, 3, {"actions": 1, "transactions": 1, "status_events": 1})):
        before = seen(store)
        for after in range(appends + 1):
            with monkeypatch.context() as patch, pytest.raises(Crash):
                crashing(patch, after)
                run()
            assert seen(store) == before
        run()
        after = seen(store)
        assert {t: after[t] - before[t] for t in TABLES if after[t] != before[t]} == rows
        run()  # saved already
        assert seen(store) == after
    assert store.status_events().first().rollback_transaction_id == "r"


def test_first_commit_of_a_run_counts(spark, store):
    first, second = store.begin("x/~y"), store.begin("x/~y")
    for run, path in ((second, "late"), (first, "early")):
        run.append("scan_errors", spark.createDataFrame([("s", path, "E")], "scan_id string, file_path string, error string"))
    assert store.scan_errors().count() == 0 and second.read("scan_errors").count() == 1
    second.commit()
    folder = os.path.join(store.root, "commits")
    os.utime(os.path.join(folder, os.listdir(folder)[0]), (1, 1))
    first.commit()
    assert [r.file_path for r in store.scan_errors().collect()] == ["late"]
    assert store.begin("x/~y").done and not store.begin("x").done


def test_many_commits_are_joined(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "NAMED_ATTEMPTS", 1)
    for i in range(3):
        store.append("scan_errors", spark.createDataFrame([("s", str(i), "E")], "scan_id string, file_path string, error string"))
    assert sorted(r.file_path for r in store.scan_errors().collect()) == ["0", "1", "2"]


def test_rollbacks_in_order(spark, store):
    """Two runs that moved different files out of one place: the second undone finds it taken."""
    rows = spark.createDataFrame([
        ("t1", 1, "a", "move", "/a", "/x", "completed", None, "h", 1, None), ("t2", 1, "b", "move", "/a", "/y", "completed", None, "h", 1, None)],
        "transaction_id string, seq bigint, action_id string, type string, from_path string, to_path string, status string, error string, "
        "file_hash string, file_size bigint, outcome string")
    heads = spark.createDataFrame([("t1",), ("t2",)], "transaction_id string").select(
        "transaction_id", F.lit(None).alias("scan_id"), F.lit("organize").alias("type"), F.lit("completed").alias("status"),
        F.lit(None).alias("summary"), F.lit("/").alias("target_path"), F.lit(False).alias("dry_run"), F.lit(None).alias("strategy"),
        F.lit(AT).alias("created_at"), F.lit(AT).alias("completed_at"))
    store.append("actions", rows)
    store.append("transactions", heads)
    present = spark.createDataFrame([("/x",), ("/y",)], "path string")
    with pytest.raises(ValueError, match="already been rolled back"):
        jobs.run_rollbacks(store, ["t1", "t1"], present, AT)
    ids = jobs.run_rollbacks(store, ["t2", "t1"], present, AT)
    got = {r.transaction_id: (r.from_path, r.to_path, r.outcome) for r in store.actions().filter("type = 'restore'").collect()}
    assert [got[i] for i in ids] == [("/y", "/a", "restored"), ("/x", "/a", "skipped")]
    assert {r.transaction_id: r.rollback_transaction_id for r in store.status_events().collect()} == {"t2": ids[0], "t1": ids[1]}
