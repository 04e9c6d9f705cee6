import datetime
import time

from pyspark.sql import functions as F

from stowage.plans import scan
from stowage.streaming import activity_by_session, activity_by_window, duplicate_group_stream, first_arrival_stream, resolve_originals

T0 = datetime.datetime(2024, 1, 1)
FILES = "scan_id string, hash string, file_path string, size bigint, arrived_at timestamp_ntz, file_created_at timestamp_ntz, file_modified_at timestamp_ntz"


def file_rows(first, last):
    return [("s", f"h{i % 7}" if i % 3 else "hot", f"/f{i:03d}", 5, *[T0 + datetime.timedelta(seconds=i)] * 3) for i in range(first, last)]


def run(query, folder, sink=None, mode="append"):
    writer = query.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    started = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{folder}/out").start()
    started.awaitTermination()


def test_first_arrival_over_two_runs_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in (file_rows(0, 60), file_rows(60, 120)):
        spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FILES).parquet(source)
        run(first_arrival_stream(stream, salts=4), tmp_path)
    arrived = spark.read.parquet(str(tmp_path / "out"))
    assert arrived.count() == 120
    for hot_rows in (1_000_000, 10):
        found = resolve_originals(arrived, hot_rows)
        batch = scan.flag_duplicates(spark.createDataFrame(file_rows(0, 120), FILES))
        keyed = lambda df: {r.file_path: (r.is_duplicate, r.duplicate_of) for r in df.collect()}
        # Rows arrive in creation order here, so the first arrival is the oldest file.
        assert keyed(found) == keyed(batch)


def test_state_with_an_end_gives_the_same_while_it_lasts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(file_rows(0, 30), FILES).write.parquet(source)
    stream = spark.readStream.schema(FILES).parquet(source)
    # State that expires by the clock keeps the query awake, so it is stopped by hand.
    query = (
        first_arrival_stream(stream, salts=1, keep_for_ms=3_600_000).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out")
        .trigger(processingTime="1 second").start()
    )
    until = time.time() + 90
    while time.time() < until and not any(p.numInputRows for p in query.recentProgress):
        query.awaitTermination(1)
    query.stop()
    heads = spark.read.parquet(str(tmp_path / "out")).groupBy("hash").agg(F.countDistinct("head_path").alias("heads"))
    assert {r.heads for r in heads.collect()} == {1}


def test_running_groups_equal_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "groups")
    for number, part in enumerate((file_rows(0, 50), file_rows(50, 90))):
        spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").parquet(source)
        sink = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(target)
        run(duplicate_group_stream(spark.readStream.schema(FILES).parquet(source)), tmp_path, sink, "update")
    newest = spark.read.parquet(target).groupBy("scan_id", "hash").agg(F.max_by(F.struct("copies", "wasted_size", "original"), "batch").alias("g"))
    batch = scan.duplicate_groups(spark.createDataFrame(file_rows(0, 90), FILES))
    assert {r["hash"]: tuple(r.g) for r in newest.collect()} == {r["hash"]: (r.copies, r.wasted_size, r.original) for r in batch.collect()}


EVENTS = "ts timestamp, user_id bigint, type string, size bigint"


def event(minute, user=1, kind="view", size=1):
    return (T0 + datetime.timedelta(minutes=minute), user, kind, size)


def stream_of(spark, tmp_path, batches, build):
    """Feeds one file per run; a later run sees the watermark of the one before."""
    source = str(tmp_path / "events")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        run(build(spark.readStream.schema(EVENTS).parquet(source)), tmp_path)
    return spark.read.parquet(str(tmp_path / "out"))


def test_tumbling_stream_drops_late_rows(spark, tmp_path):
    batches = [[event(5), event(50), event(65)], [event(300)], [event(10), event(310)], [event(900)]]
    got = stream_of(spark, tmp_path, batches, activity_by_window)
    counts = {r.window_start: r.n for r in got.collect()}
    assert counts == {T0: 2, T0 + datetime.timedelta(hours=1): 1, T0 + datetime.timedelta(hours=5): 2}


def test_sliding_stream(spark, tmp_path):
    got = stream_of(spark, tmp_path, [[event(5)], [event(2000)]], lambda e: activity_by_window(e, "6 hours", "1 hour"))
    assert got.count() == 6 and {r.n for r in got.collect()} == {1}


def test_session_stream(spark, tmp_path):
    batches = [[event(0), event(20), event(70), event(10, user=2)], [event(600)]]
    got = stream_of(spark, tmp_path, batches, activity_by_session)
    spans = {(r.user_id, r.session_start): (r.n, r.session_end) for r in got.collect()}
    minute = lambda m: T0 + datetime.timedelta(minutes=m)
    assert spans == {(1, minute(0)): (2, minute(50)), (1, minute(70)): (1, minute(100)), (2, minute(10)): (1, minute(40))}
