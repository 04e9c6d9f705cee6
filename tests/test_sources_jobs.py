import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from stowage.plans import jobs, ledger, scan
from stowage.session import checkpoint_root, cut_lineage
from stowage.sources import CatalogueStore, hash_files, list_errors, list_files, list_folders, partial_hash_files

AT = datetime.datetime(2024, 3, 1)


@pytest.fixture
def tree(tmp_path):
    contents = {
        "a.txt": b"one", "b.txt": b"one", ".hidden": b"h", "_x": b"", "sub dir/c.PY": b"two", "sub dir/deep/a.txt": b"one",
        "node_modules/m.js": b"m", ".hid/n": b"n", "sub dir/node_modules/o": b"o", "empty/z": b"",
    }
    for name, data in contents.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    os.symlink(tmp_path / "sub dir", tmp_path / "dirlink")
    return str(tmp_path)


def names(root, df):
    return sorted(r.file_path[len(root) + 1:] for r in df.collect())


def test_walk_rules(spark, tree):
    found = list_files(spark, tree)
    assert names(tree, found) == sorted([".hidden", "_x", "a.txt", "b.txt", "empty/z", "sub dir/c.PY", "sub dir/deep/a.txt"])
    assert names(tree, list_files(spark, tree + "/", recursive=False)) == sorted([".hidden", "_x", "a.txt", "b.txt"])
    assert names(tree, list_files(spark, tree, keep=F.col("size") == 0)) == ["_x", "empty/z"]
    assert "sub dir/deep" in names(tree, list_folders(spark, tree))
    row = found.filter(F.col("file_path").endswith("/c.PY")).first()
    assert row["size"] == 3 and row.file_modified_at.year >= 2024


def test_unreadable_folder_is_reported_not_fatal(spark, tmp_path):
    missing = str(tmp_path / "gone")
    assert [tuple(r) for r in list_errors(spark, missing).collect()] == [(missing, "ENOENT", False)]
    assert list_files(spark, missing).count() == 0


def test_hashes_of_files(spark, tree):
    big = os.path.join(tree, "big.bin")
    data = os.urandom(200_001)
    with open(big, "wb") as handle:
        handle.write(data)
    rows = spark.createDataFrame([(big, len(data)), (os.path.join(tree, "_x"), 0), (tree + "/nope", 1)], "file_path string, size bigint")
    full = {r.file_path: (r["hash"], r.error) for r in hash_files(rows).collect()}
    assert full[big] == (hashlib.sha256(data).hexdigest(), None) and full[tree + "/nope"] == (None, "ENOENT")
    part = {r.file_path: r.partial_hash for r in partial_hash_files(rows).collect()}
    assert part[big] == hashlib.sha256(data[:65536] + data[-65536:] + b"200001").hexdigest()
    assert part[os.path.join(tree, "_x")] == hashlib.sha256(b"empty").hexdigest()


def test_cut_uses_the_shared_folder(spark):
    cut = cut_lineage(spark.range(10).withColumn("t", F.lit(AT)))
    assert cut.count() == 10 and all(f.startswith("file:" + checkpoint_root(spark)) or checkpoint_root(spark) in f for f in cut.inputFiles())


def test_whole_life_of_a_tree(spark, tree, tmp_path_factory):
    store = CatalogueStore(spark, str(tmp_path_factory.mktemp("store")))
    assert store.scans().count() == 0
    scan_id, progress = jobs.run_scan(store, f" {tree}//", AT)
    assert progress["rows"] == 7 and progress["errors"] == 0
    head = scan.scan_by_id(store.scans(), scan_id).first()
    assert (head.total_files, head.total_size, head.duplicates_count, head.duplicates_size) == (7, 13, 3, 6)
    assert head.categories["Documents"].asDict() == {"count": 3, "size": 9}
    before = scan.records_of_scan(store.file_records(), scan_id)

    dry = jobs.run_dedupe(store, scan_id, AT, dry_run=True, trash=tree + "/.trash")
    row = store.transactions().filter(F.col("transaction_id") == dry).first()
    assert (row.status, row.summary.saved_bytes, row.summary.total_processed, row.completed_at) == ("pending", 0, 3, None)
    with pytest.raises(ValueError, match="dry-run"):
        jobs.run_rollback(store, dry, spark.createDataFrame([], "path string"), AT)

    done = jobs.run_dedupe(store, scan_id, AT, "keep-oldest", trash=tree + "/.trash")
    acts = store.actions().filter(F.col("transaction_id") == done)
    targets = [r.to_path for r in acts.collect()]
    assert len(set(targets)) == 3 and all(t.startswith(tree + "/.trash/1709251200000_") for t in targets)

    gone = before.join(acts.select(F.col("from_path").alias("file_path")), "file_path", "left_anti").select("file_path")
    present = gone.union(acts.select("to_path")).withColumnRenamed("file_path", "path")
    undo = jobs.run_rollback(store, done, present, AT + datetime.timedelta(days=1))
    steps = store.actions().filter(F.col("transaction_id") == undo)
    back = gone.union(steps.filter("status = 'completed'").select("to_path"))
    assert sorted(r[0] for r in back.collect()) == sorted(r.file_path for r in before.collect())
    assert [r.seq for r in steps.orderBy("seq").collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="already been rolled back"):
        jobs.run_rollback(store, done, present, AT)
    with pytest.raises(ValueError, match="not found"):
        jobs.run_rollback(store, "nope", present, AT)

    later = AT + datetime.timedelta(days=2)
    moved = jobs.run_organize(store, scan_id, later, recursive=True)
    places = {r.from_path[len(tree) + 1:]: r.to_path[len(tree) + 1:] for r in store.actions().filter(F.col("transaction_id") == moved).collect()}
    assert places["a.txt"] == "Documents/a.txt" and places["sub dir/deep/a.txt"] == "Documents/a_1.txt"
    assert places["sub dir/c.PY"] == "Code/c.PY" and places["_x"] == "Others/_x"
    # Nothing is where it was moved to, so undoing skips every step and still closes the run.
    lost = jobs.run_rollback(store, moved, spark.createDataFrame([], "path string"), later)
    row = store.transactions().filter(F.col("transaction_id") == lost).first()
    assert (row.status, row.summary.restored_count, row.summary.total_processed) == ("completed", 0, 7)
    assert {r.outcome for r in store.actions().filter(F.col("transaction_id") == lost).collect()} == {"skipped"}
    row = store.transactions().filter(F.col("transaction_id") == undo).first()
    assert (row.status, row.summary.restored_count) == ("completed", 3)

    # By the ledger the files are still in the category folders: nothing is left to organize.
    flat = jobs.run_organize(store, scan_id, later, dry_run=True)
    assert store.actions().filter(F.col("transaction_id") == flat).count() == 0

    report = jobs.run_report(store).first()
    assert report.overview.total_files_scanned == 7 and report.overview.total_transactions == 6
    assert report.overview.total_disk_space_saved == 0 and report.duplicate_stats.total_groups == 2
    assert report.extension_stats[0].extension == ".txt" and report.extension_stats[0]["count"] == 3
    assert len(report.recent_activity) == 6 and report.recent_scans[0].scan_id == scan_id


def test_a_missing_root_and_scan_are_refused(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="does not exist"):
        jobs.run_scan(store, str(tmp_path / "none"), AT)
    with pytest.raises(ValueError, match="Scan not found"):
        jobs.run_organize(store, "none", AT)


def test_runs_build_on_each_other(spark, tree, tmp_path_factory):
    store = CatalogueStore(spark, str(tmp_path_factory.mktemp("store")))
    os.makedirs(tree + "/Documents")
    with open(tree + "/Documents/b.txt", "w") as handle:
        handle.write("another b")
    scan_id, _ = jobs.run_scan(store, tree, AT, recursive=False)  # does not see the folder
    day = lambda n: AT + datetime.timedelta(days=n)
    acts = lambda tx: {r.from_path[len(tree) + 1:]: r.to_path[len(tree) + 1:] for r in store.actions().filter(F.col("transaction_id") == tx).collect()}
    first = jobs.run_dedupe(store, scan_id, day(1), "keep-largest")
    assert acts(first) == {"b.txt": ""}
    assert acts(jobs.run_dedupe(store, scan_id, day(2), "keep-largest")) == {}
    moved = jobs.run_organize(store, scan_id, day(3))
    assert acts(moved)["a.txt"] == "Documents/a.txt" and "b.txt" not in acts(moved)
    now = ledger.current_files(scan.records_of_scan(store.file_records(), scan_id), store.actions(), store.transactions())
    assert {r.file_path[len(tree) + 1:] for r in now.collect()} == {"Documents/a.txt", "Others/_x", "Others/.hidden"} and now.columns == store.file_records().columns
    # Undone with everything in place, the files are back and can be organised again.
    undo = jobs.run_rollback(store, moved, store.actions().filter(F.col("transaction_id") == moved).select(F.col("to_path").alias("path")), day(4))
    assert store.actions().filter((F.col("transaction_id") == undo) & (F.col("outcome") == "restored")).count() == 3
    again = jobs.run_organize(store, scan_id, day(5))
    assert acts(again) == acts(moved)


def test_existing_target_names_are_not_overwritten(spark, tree, tmp_path_factory):
    store = CatalogueStore(spark, str(tmp_path_factory.mktemp("store")))
    os.makedirs(tree + "/Documents")
    with open(tree + "/Documents/a.txt", "w") as handle:
        handle.write("another a")
    scan_id, _ = jobs.run_scan(store, tree, AT, recursive=False)
    moved = jobs.run_organize(store, scan_id, AT)
    places = {r.from_path[len(tree) + 1:]: r.to_path[len(tree) + 1:] for r in store.actions().filter(F.col("transaction_id") == moved).collect()}
    assert places["a.txt"] == "Documents/a_1.txt" and places["b.txt"] == "Documents/b.txt"


def test_folder_errors_are_saved_and_a_vanished_file_is_named(spark, tree, tmp_path, monkeypatch):
    from stowage.sources import filesystem, list_each

    files, errors = list_each(spark.createDataFrame([(tree,), (str(tmp_path / "none"),)], "file_path string"))
    assert names(tree, files) == sorted([".hidden", "_x", "a.txt", "b.txt"])
    assert [tuple(r) for r in errors.collect()] == [(str(tmp_path / "none"), "ENOENT", False)]

    class Entry:
        name = "lost"

        def is_dir(self, follow_symlinks):
            return False

        def is_file(self, follow_symlinks):
            return True

        def stat(self, follow_symlinks):
            raise OSError(2, "gone")

    class Scan(list):
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

    monkeypatch.setattr(filesystem.os, "scandir", lambda _: Scan([Entry()]))
    assert list(filesystem.entries("/x")) == [("/x/lost", False, None, None, None, "ENOENT")]


def test_work_tables_are_discarded(spark):
    from stowage.session import discard

    cut = cut_lineage(spark.range(10))
    folder = cut.work_folder
    assert os.path.isdir(folder.removeprefix("file:"))
    discard(cut, spark.range(1))
    assert not os.path.exists(folder.removeprefix("file:"))
