"""First arrivals by batches: hot content, late rows, repeated batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from stowage.plans import scan
from stowage.streaming import ArrivalLog, arrivals, first_arrivals
from tests.test_streaming import FILES, T0, file_rows

ROW = "scan_id string, hash string, file_path string, size bigint, arrived_at timestamp_ntz"


def batch(spark, rows):
    return spark.createDataFrame([("s", h, p, 1, None if at is None else T0 + datetime.timedelta(seconds=at)) for h, p, at in rows], ROW)


def originals(log):
    return {r.file_path: r.duplicate_of for r in log.rows().collect()}


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_two_runs_of_a_stream_equal_batch(spark, tmp_path, hot_rows):
    source = str(tmp_path / "in")
    log = ArrivalLog(spark, str(tmp_path / "log"), hot_rows)
    for part in (file_rows(0, 60), file_rows(60, 120)):
        spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").parquet(source)
        first_arrivals(spark.readStream.schema(FILES).parquet(source), log).trigger(availableNow=True).start().awaitTermination()
    flagged = scan.flag_duplicates(spark.createDataFrame(file_rows(0, 120), FILES))
    # Rows arrive in creation order here, so the first arrival is the oldest file.
    assert originals(log) == {r.file_path: r.duplicate_of for r in flagged.collect()}
    assert log.rows().filter("is_duplicate <> (duplicate_of IS NOT NULL)").isEmpty()


def test_late_rows_and_ties(spark, tmp_path):
    log = ArrivalLog(spark, str(tmp_path))
    log.add(batch(spark, [("x", "/b", 50), ("x", "/a.txt", 50), ("x", "/a/z", 50), ("y", "/n", None), ("y", "/o", 9), ("z", "/q", None), ("z", "/p", None)]), 0)
    # Walk order puts the folder's file before the name that begins with the folder's.
    first = {"/b": "/a/z", "/a.txt": "/a/z", "/a/z": None, "/n": "/o", "/o": None, "/q": "/p", "/p": None}
    assert originals(log) == first
    log.add(batch(spark, [("x", "/early", 1), ("w", "/w", 2), ("x", "/late", 99)]), 1)  # an earlier batch comes first
    assert originals(log) == {**first, "/early": "/a/z", "/late": "/a/z", "/w": None}


def test_a_batch_handed_in_again(spark, tmp_path, monkeypatch):
    log = ArrivalLog(spark, str(tmp_path), merge_every=2)
    parts = [batch(spark, [("x", f"/x{i}", 10 - i), (f"only{i}", f"/o{i}", i)]) for i in range(5)]
    plain = ArrivalLog._write

    def dies(self, rows, kind, number):
        if kind == "rows":
            raise OSError("disk full")
        plain(self, rows, kind, number)

    for number, part in enumerate(parts):
        with monkeypatch.context() as patch, pytest.raises(OSError):
            patch.setattr(ArrivalLog, "_write", dies)
            log.add(part, number)
        log.add(part, number)
        before = originals(log)
        log.add(batch(spark, [("x", "/other", 0)]), number)  # written already: not looked at
        assert originals(log) == before
    assert before == {**{f"/x{i}": "/x0" if i else None for i in range(5)}, **{f"/o{i}": None for i in range(5)}}
    assert log._written("merged") == [1, 3] and log.heads(99).count() == 6


def test_no_task_holds_the_hot_content(spark, tmp_path):
    """Half of all rows have one content; dealt out, they lie in many partitions of the written rows."""
    rows = spark.range(4000).selectExpr(
        "'s' AS scan_id", "IF(id % 2 = 0, 'hot', CAST(id AS STRING)) AS hash", "concat('/', id) AS file_path", "id AS size",
        "timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS arrived_at")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        log = ArrivalLog(spark, str(tmp_path), hot_rows=100)
        log.add(rows, 0)
        files = log.rows().filter("hash = 'hot'").groupBy(F.input_file_name()).count().collect()
        assert sum(r["count"] for r in files) == 2000 and max(r["count"] for r in files) < 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert arrivals.HEADS and log.rows().filter("NOT is_duplicate").count() == 2001
