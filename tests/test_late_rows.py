"""Live figures and the account of late rows together are the batch query."""

import datetime
import random

import pytest

from stowage.streaming import ActivityLog, activity_by_window, activity_with_late_rows

T0 = datetime.datetime(2024, 1, 1)
EVENTS = "ts timestamp, type string, size bigint"


def events(spark, hours):
    return spark.createDataFrame([(T0 + datetime.timedelta(hours=h), t, s) for h, t, s in hours], EVENTS)


def figures(df, *more):
    return sorted((r.window_start, r.type, r.n, r["size"], *[r[m] for m in more]) for r in df.collect())


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_stream_and_side_table_equal_batch(spark, tmp_path, slide):
    rng = random.Random(4)
    source, rows = str(tmp_path / "in"), []
    log = ActivityLog(spark, str(tmp_path / "log"), "1 hour", slide, "2 hours", merge_every=2)
    for day in range(4):  # one batch each; some rows are up to a day late
        part = [(day * 10 + rng.random() * 10 - (rng.random() * 24 if rng.random() < 0.2 else 0), rng.choice("ab"), rng.randint(1, 9)) for _ in range(80)]
        rows += part
        events(spark, part).coalesce(1).write.mode("append").parquet(source)
        activity_with_late_rows(spark.readStream.schema(EVENTS).parquet(source), log).trigger(availableNow=True).start().awaitTermination()
    batch = activity_by_window(events(spark, rows), "1 hour", slide)
    assert figures(log.reconciled()) == figures(batch)
    late = log.late().agg({"n": "sum"}).first()[0]
    assert late and late == sum(r.late_n for r in log.reconciled().collect()) and log._written("merged_late") == [1, 3]


def test_which_rows_are_late(spark, tmp_path):
    log = ActivityLog(spark, str(tmp_path), lateness="1 hour")
    log.add(events(spark, [(5.5, "a", 1), (0.1, "a", 1)]), 0)  # nothing is late in the first batch
    log.add(events(spark, [(3.9, "a", 2), (4.2, "a", 3), (0.2, "b", 4)]), 1)  # closed up to 4:30
    log.add(events(spark, []), 2)
    log.add(events(spark, [(3.9, "a", 7)]), 1)  # written already
    assert figures(log.late()) == [(T0, "b", 1, 4), (T0 + datetime.timedelta(hours=3), "a", 1, 2)]
    assert [f[2:] for f in figures(log.live())] == [(1, 1), (1, 3), (1, 1)]
