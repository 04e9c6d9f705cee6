"""Catalogue tables as Parquet folders below one root. Everything is append-only and becomes visible by commits."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage import schemas
from stowage.session import COMPRESSION

ATTEMPT = "attempt"
#: Up to so many commits are named in a partition filter, more are joined.
NAMED_ATTEMPTS = 1000


class CatalogueStore:
    """Reads and appends the catalogue tables.

    File records are partitioned by scan, so a query about one scan reads one folder, and sorted by
    hash inside the files, so row groups can be skipped on it.

    A run writes to several tables. Its rows lie in folders of their own, one for each attempt, and a marker is created last; readers
    see attempts with a marker only. So a run that dies half-way leaves nothing that is seen, and may be repeated under
    the same id. Should two attempts of a run finish, the first marker counts.
    """

    LAYOUT = {
        "file_records": (schemas.FILE_RECORDS, ["scan_id"], ["hash"]),
        "scans": (schemas.SCANS, [], []),
        "scan_errors": (schemas.SCAN_ERRORS, [], []),
        "transactions": (schemas.TRANSACTIONS, ["type"], []),
        "actions": (schemas.ACTIONS, ["status"], []),
        "status_events": (schemas.STATUS_EVENTS, [], []),
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _commits(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> dict[str, str]:
        """Attempt that counts for each run: one listing of a folder with one empty file for each."""
        folder, system = self._commits()
        if not system.exists(folder):
            return {}
        found = sorted((s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(folder))
        runs: dict[str, str] = {}
        for _, name in found:
            run, _, attempt = name.rpartition("~")
            runs.setdefault(unquote(run), attempt)
        return runs

    def begin(self, run_id: str | None = None) -> "Run":
        return Run(self, run_id or str(uuid.uuid4()))

    def append(self, table: str, rows: DataFrame) -> None:
        """A run of one table."""
        run = self.begin()
        run.append(table, rows)
        run.commit()

    def rows_of(self, table: str, attempts: list[str]) -> DataFrame:
        schema: T.StructType = self.LAYOUT[table][0]
        empty = self.spark.createDataFrame([], schema)
        if not attempts:
            return empty
        try:
            rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(ATTEMPT, T.StringType())])).parquet(self.path(table))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty
        if len(attempts) <= NAMED_ATTEMPTS:
            return rows.filter(F.col(ATTEMPT).isin(*attempts)).drop(ATTEMPT)
        named = self.spark.createDataFrame([(a,) for a in attempts], f"{ATTEMPT} string")
        return rows.join(named, ATTEMPT, "left_semi").drop(ATTEMPT)

    def read(self, table: str) -> DataFrame:
        return self.rows_of(table, list(self.committed().values()))

    def file_records(self) -> DataFrame:
        return self.read("file_records")

    def scan_errors(self) -> DataFrame:
        return self.read("scan_errors")

    def scans(self) -> DataFrame:
        return self.read("scans")

    def transactions(self) -> DataFrame:
        return self.read("transactions")

    def actions(self) -> DataFrame:
        return self.read("actions")

    def status_events(self) -> DataFrame:
        return self.read("status_events")


class Run:
    """One attempt of a run: appends to any tables, seen by others after ``commit``. ``done`` tells that an earlier attempt was
    committed, so that there is nothing left to do."""

    def __init__(self, store: CatalogueStore, run_id: str):
        self.store, self.run_id, self.attempt = store, run_id, uuid.uuid4().hex
        self.done = run_id in store.committed()

    def append(self, table: str, rows: DataFrame) -> None:
        schema, partitions, order = CatalogueStore.LAYOUT[table]
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        if order:
            typed = typed.sortWithinPartitions(*partitions, *order)
        typed.withColumn(ATTEMPT, F.lit(self.attempt)).write.mode("append").partitionBy(ATTEMPT, *partitions).parquet(
            self.store.path(table), compression=COMPRESSION)

    def read(self, table: str) -> DataFrame:
        """Rows of this attempt."""
        return self.store.rows_of(table, [self.attempt])

    def commit(self) -> None:
        folder, system = self.store._commits()
        name = f"{quote(self.run_id, safe='')}~{self.attempt}"
        system.create(self.store.spark._jvm.org.apache.hadoop.fs.Path(folder, name), False).close()
