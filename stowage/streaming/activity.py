"""Live activity: counts and bytes per type in time windows. The same code runs on batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stowage.session import cut_lineage, discard
from stowage.streaming.batchlog import MERGE_EVERY, BatchLog

LATENESS = "1 hour"
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def late_rows_dropped(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Watermark on ``ts``: a stream forgets windows older than this and drops their late rows."""
    return events.withWatermark("ts", lateness) if events.isStreaming else events


def activity_by_window(events: DataFrame, length: str = "1 hour", slide: str | None = None,
                       lateness: str = LATENESS) -> DataFrame:
    """Tumbling windows, or sliding ones when ``slide`` is given."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        late_rows_dropped(events, lateness)
        .groupBy(span.alias("span"), "type")
        .agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "type", "n", "size")
    )


def activity_by_session(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions per user, closed by a pause of ``gap``.

    A stream uses session windows; with ``LOCAL_MERGE`` set in the session they are merged on the map side first. A batch
    table is cut into slices as long as the gap: the events of a user in one slice belong to one session, so they are
    summed up before the shuffle, and what is left per user is bounded by the time covered, not by the rows.
    """
    if not events.isStreaming:
        return _sessions_of_table(events, gap)
    return (
        late_rows_dropped(events, lateness)
        .groupBy(F.session_window("ts", gap).alias("span"), "user_id")
        .agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        .select(F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "user_id", "n", "size")
    )


def _merge(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (first, close, n, size) of each key, joined while the next one starts before the last closes."""
    in_order = Window.partitionBy(*keys).orderBy("first", "close")
    apart = F.coalesce(F.col("first") >= F.max("close").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return (
        spans.withColumn("__apart", apart.cast("int"))
        .withColumn("__no", F.sum("__apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__no")
        .agg(F.min("first").alias("first"), F.max("close").alias("close"), F.sum("n").alias("n"), F.sum("size").alias("size"))
        .drop("__no")
    )


def _sessions_of_table(events: DataFrame, gap: str) -> DataFrame:
    length = F.expr(f"INTERVAL {gap}")
    slices = events.groupBy("user_id", F.window("ts", gap).alias("slice")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.sum("size").alias("size")
    )
    spans = slices.select("user_id", "first", (F.col("last") + length).alias("close"), "n", "size")
    return _merge(spans, ["user_id"]).select(F.col("first").alias("session_start"), F.col("close").alias("session_end"), "user_id", "n", "size")


FIGURES = "window_start timestamp, window_end timestamp, type string, n bigint, size bigint"


class ActivityLog(BatchLog):
    """Live figures of a stream with an account of its late rows: what came in time, and by window what came too late.

    A window is closed when the latest time of the batches before, less ``lateness``, has reached its end; rows that
    still come for it are counted in a table of their own. Both together are what the batch query gives over all rows. A batch adds its sums, one
    row for each window and type; every so many batches they are merged.
    """

    def __init__(self, spark: SparkSession, folder: str, length: str = "1 hour", slide: str | None = None, lateness: str = LATENESS,
                 merge_every: int = MERGE_EVERY):
        super().__init__(spark, folder, merge_every)
        self.length, self.slide, self.lateness = length, slide, lateness

    def watermark(self, before: int) -> DataFrame:
        """One row: the time up to which windows are closed when a batch comes; null before the first row."""
        marks = self._since_merge("merged_marks", "marks", before, "latest timestamp")
        return marks.agg((F.max("latest") - F.expr(f"INTERVAL {self.lateness}")).alias("mark"))

    def add(self, batch: DataFrame, number: int) -> None:
        if number in self._written("marks"):
            return
        mark = self.watermark(number).first()["mark"]
        span = F.window("ts", self.length, self.slide) if self.slide else F.window("ts", self.length)
        sums = cut_lineage(
            batch.groupBy(span.alias("span"), "type").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("ts").alias("latest"))
            .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "type", "n", "size", "latest"), "sums")
        late = F.lit(False) if mark is None else F.col("window_end") <= F.lit(mark)
        self._write(sums.filter(~late).drop("latest"), "windows", number)
        self._write(sums.filter(late).drop("latest"), "late", number)
        self._write(sums.agg(F.max("latest").alias("latest")), "marks", number)  # last: the batch is complete
        discard(sums)
        if self._merges(number):
            for kind in ("windows", "late"):
                self._write(self._summed(kind, number + 1), f"merged_{kind}", number)
            self._write(self._since_merge("merged_marks", "marks", number + 1, "latest timestamp").agg(F.max("latest").alias("latest")), "merged_marks", number)

    def _summed(self, kind: str, before: int) -> DataFrame:
        rows = self._since_merge(f"merged_{kind}", kind, before, FIGURES)
        return rows.groupBy("window_start", "window_end", "type").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))

    def _complete(self) -> int:
        return max(self._written("marks"), default=-1) + 1

    def live(self) -> DataFrame:
        """Figures of the rows that came in time."""
        return self._summed("windows", self._complete())

    def late(self) -> DataFrame:
        """Figures of the rows that came after their window was closed."""
        return self._summed("late", self._complete())

    def reconciled(self) -> DataFrame:
        """Figures of all rows with the part that came late: what the batch query gives, and ``late_n``, ``late_size``."""
        keys = ["window_start", "window_end", "type"]
        none = F.lit(0).cast("bigint")
        both = self.live().withColumns({"late_n": none, "late_size": none}).unionByName(
            self.late().withColumns({"late_n": F.col("n"), "late_size": F.col("size")}))
        return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "size", "late_n", "late_size")])


def activity_with_late_rows(events: DataFrame, log: ActivityLog) -> DataStreamWriter:
    """Writer of a stream of events (ts, type, size) into the log; give it a trigger and start it."""
    return events.writeStream.option("checkpointLocation", f"{log.folder}/state").foreachBatch(log.add)
