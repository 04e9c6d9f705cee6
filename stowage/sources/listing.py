"""Directory listing as a job: each level of the tree is a table of folders, listed in parallel.

Spark's own file sources drop hidden and empty files, follow links and enter every folder, so the walk
is our own. Each level is cut with a reliable checkpoint; the driver only learns how many folders come
next. Work is spread by folder, so a folder is the unit of one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.paths import SKIPPED_FOLDERS, basename
from stowage.session import cut_lineage
from stowage.sources.filesystem import SILENT_ERRORS, entries, error_code

ENTRY = "file_path string, is_dir boolean, size bigint, file_created_at timestamp_ntz, file_modified_at timestamp_ntz, error string"
BATCH = 10_000
FOLDERS_PER_TASK = 64


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in ENTRY.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(rows, columns=names)
        for name in ("file_created_at", "file_modified_at"):
            table[name] = pd.to_datetime(table[name])
        return table

    for batch in batches:
        rows: list[tuple] = []
        for folder in batch["file_path"]:
            try:
                for entry in entries(folder):
                    rows.append(entry)
                    if len(rows) >= BATCH:  # a huge folder leaves the worker in pieces
                        yield frame(rows)
                        rows = []
            except OSError as problem:
                rows.append((folder, True, None, None, None, error_code(problem)))
        if rows:
            yield frame(rows)


def _enter(path: Column) -> Column:
    name = basename(path)
    return ~(name.startswith(".") | name.isin(*SKIPPED_FOLDERS))


def _walk(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "file_path string")
    levels, folders = [], 1
    while folders:
        tasks = folders // FOLDERS_PER_TASK + 1
        found = cut_lineage(level.repartition(tasks).mapInPandas(_list, ENTRY))
        levels.append(found)
        if not recursive:
            break
        level = found.filter(F.col("is_dir") & F.col("error").isNull() & _enter(F.col("file_path"))).select("file_path")
        folders = level.count()
    return reduce(DataFrame.unionByName, levels)


def _files(found: DataFrame) -> DataFrame:
    return found.filter("NOT is_dir AND error IS NULL").drop("is_dir", "error")


def _errors(found: DataFrame) -> DataFrame:
    failed = found.filter("error IS NOT NULL")
    return failed.select("file_path", "error", (F.col("is_dir") & F.col("error").isin(*SILENT_ERRORS)).alias("silent"))


def walk(spark: SparkSession, root: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Files (path, size, created, modified) and errors (path, error, silent) of one walk below ``root``."""
    found = _walk(spark, root, recursive)
    return _files(found), _errors(found)


def list_files(spark: SparkSession, root: str, recursive: bool = True, keep: Column | None = None) -> DataFrame:
    """Regular files below ``root``: path, size, created, modified. ``keep`` is any boolean column."""
    files = _files(_walk(spark, root, recursive))
    return files if keep is None else files.filter(keep)


def list_each(folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and errors of every folder in a table (file_path), not recursive."""
    spread = folders.select("file_path").distinct().repartition("file_path")
    found = cut_lineage(spread.mapInPandas(_list, ENTRY), "listed")
    return _files(found), _errors(found)


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    return _walk(spark, root, True).filter("is_dir AND error IS NULL").select("file_path")


def list_errors(spark: SparkSession, root: str) -> DataFrame:
    """Folders and files that could not be read. Missing permission on a folder is expected and marked ``silent``."""
    return _errors(_walk(spark, root, True))
