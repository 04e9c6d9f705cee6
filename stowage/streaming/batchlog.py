"""Tables that a stream writes batch by batch, safe to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: After so many batches their summaries are merged into one table.
MERGE_EVERY = 64


class BatchLog:
    """Folders ``<folder>/<kind>/<batch number>`` that appear when they are complete.

    A batch that is handed in again after a crash is written anew from the batches before it alone, so it comes out the same.
    """

    def __init__(self, spark: SparkSession, folder: str, merge_every: int = MERGE_EVERY):
        self.spark, self.folder, self.merge_every = spark, folder.rstrip("/"), merge_every

    def _written(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(s.getPath().getParent().getName()) for s in found)

    def _read(self, kind: str, numbers: list[int], schema: str) -> DataFrame:
        folders = [f"{self.folder}/{kind}/{n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{number}")

    def _since_merge(self, merged: str, kind: str, before: int, schema: str) -> DataFrame:
        """The newest merged table before a batch and what the batches since have written."""
        last = max((n for n in self._written(merged) if n < before), default=-1)
        since = [n for n in self._written(kind) if last < n < before]
        return self._read(merged, [last] if last >= 0 else [], schema).union(self._read(kind, since, schema))

    def _merges(self, number: int) -> bool:
        return number % self.merge_every == self.merge_every - 1
