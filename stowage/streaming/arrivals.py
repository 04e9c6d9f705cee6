"""First arrivals of a stream of manifest rows, batch by batch, with native operators and a table of heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stowage.functions.paths import order_key
from stowage.operators.keepone import GROUP
from stowage.operators.skew import HOT_ROWS, lookup
from stowage.session import cut_lineage, discard
from stowage.streaming.batchlog import MERGE_EVERY, BatchLog

HEADS = "scan_id string, hash string, original string"
ROWS = "scan_id string, hash string, file_path string, size bigint, arrived_at timestamp_ntz, is_duplicate boolean, duplicate_of string"


class ArrivalLog(BatchLog):
    """Tables below one shared folder: the rows of each batch with their originals, and the heads, one row per content.

    A batch writes the heads of new content first and its rows last. Handed in again, it does nothing if its rows are there.
    """

    def __init__(self, spark: SparkSession, folder: str, hot_rows: int = HOT_ROWS, merge_every: int = MERGE_EVERY):
        super().__init__(spark, folder, merge_every)
        self.hot_rows = hot_rows

    def heads(self, before: int) -> DataFrame:
        """Originals known before a batch: the newest merged table and the heads of the batches since."""
        return self._since_merge("merged", "heads", before, HEADS)

    def add(self, batch: DataFrame, number: int) -> None:
        """One batch. The group sizes matter nowhere: first rows are found by a combining aggregate, and the join to
        the heads deals out the rows of very common content."""
        if number in self._written("rows"):
            return
        rows = cut_lineage(batch.select("scan_id", "hash", "file_path", "size", "arrived_at"), "batch")  # read three times
        order = F.struct(F.col("arrived_at").isNull().alias("late"), "arrived_at", order_key("file_path").alias("walk"))
        firsts = rows.groupBy(*GROUP).agg(F.min_by("file_path", order).alias("first"))
        known = self.heads(number)
        same = firsts.join(known, GROUP, "left")
        batch_heads = cut_lineage(same.select(*GROUP, F.coalesce("original", "first").alias("original"), F.col("original").isNull().alias("new")), "heads")
        self._write(batch_heads.filter("new").drop("new"), "heads", number)
        found = lookup(rows, batch_heads.drop("new"), GROUP, F.col("file_path"), self.hot_rows)
        copy = F.col("original") != F.col("file_path")
        self._write(found.withColumn("is_duplicate", copy).withColumn("duplicate_of", F.when(copy, F.col("original"))).drop("original"), "rows", number)
        discard(rows, batch_heads)
        if self._merges(number):
            self._write(self.heads(number + 1), "merged", number)

    def rows(self) -> DataFrame:
        """All rows of complete batches, each with its original."""
        return self._read("rows", self._written("rows"), ROWS)


def first_arrivals(files: DataFrame, log: ArrivalLog) -> DataStreamWriter:
    """Writer of a stream of rows (scan_id, hash, file_path, size, arrived_at) into the log; give it a trigger and start it.

    The first file that arrives with its content is the original of all others with the same, for good: a row of an earlier
    batch comes before those of later ones, whatever their times say; inside a batch the earliest time decides, a missing one last,
    then walk order. How rows are cut into batches is up to the source.
    """
    return files.writeStream.option("checkpointLocation", f"{log.folder}/state").foreachBatch(log.add)
