"""Hashes of file contents, read in chunks inside the tasks."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.hashing import EMPTY_TEXT, PARTIAL_CHUNK
from stowage.sources.filesystem import error_code, open_file

CHUNK = 4 << 20
BYTES_PER_TASK = 8 << 30
#: Opening a file counts as reading so many bytes.
OPEN_COST = 64 << 10


def _full(handle) -> str:
    digest = hashlib.sha256()
    while chunk := handle.read(CHUNK):
        digest.update(chunk)
    return digest.hexdigest()


def _partial(handle) -> str:
    size = handle.seek(0, os.SEEK_END) or handle.tell()
    if size == 0:
        return hashlib.sha256(EMPTY_TEXT.encode()).hexdigest()
    chunk = min(PARTIAL_CHUNK, size // 2)
    handle.seek(0)
    digest = hashlib.sha256(handle.read(chunk))
    if size > 2 * chunk:
        handle.seek(size - chunk)
        digest.update(handle.read(chunk))
    digest.update(str(size).encode())
    return digest.hexdigest()


def spread_by_cost(files: DataFrame, cost: Column) -> DataFrame:
    """The files in as many tasks as the bytes to read ask for, each with about the same number of them.

    Files are put in an order, and a file goes to the task in whose share of the running sum it begins; so a task reads its share and at
    most one file beyond. The sum is formed in parts, by a hash of the path, and shifted by the parts before; one number per part meets in one place.
    """
    rows = files.withColumn("__cost", cost)
    total = rows.agg(F.sum("__cost")).first()[0] or 0
    tasks = int(max(files.sparkSession.sparkContext.defaultParallelism, total // BYTES_PER_TASK + 1))
    share = max(1, -(-total // tasks))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("file_path"), F.lit(tasks)).cast("int"))
    so_far = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__part").agg(F.sum("__cost").alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(so_far), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("__before") + F.coalesce(F.sum("__cost").over(inside), F.lit(0))
    dealt = rows.join(before, "__part").withColumn("__task", F.least(F.floor(begins / share), F.lit(tasks - 1)).cast("int"))
    return dealt.repartitionById(tasks, "__task").select(*files.columns)


def _apply(files: DataFrame, column: str, digest: Callable, most: int | None = None) -> DataFrame:
    schema = T.StructType([
        *files.schema.fields, T.StructField(column, T.StringType()), T.StructField("error", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, errors = [], []
            for path in batch["file_path"]:
                try:
                    with open_file(path) as handle:
                        values.append(digest(handle))
                        errors.append(None)
                except OSError as problem:
                    values.append(None)
                    errors.append(error_code(problem))
            yield batch.assign(**{column: values, "error": errors})

    size = F.coalesce(F.col("size"), F.lit(0))
    return spread_by_cost(files, (size if most is None else F.least(size, F.lit(most))) + OPEN_COST).mapInPandas(run, schema)


def hash_files(files: DataFrame) -> DataFrame:
    """Add ``hash`` and ``error``; an unreadable file gets a code instead of a hash and never stops the job."""
    return _apply(files, "hash", _full)


def partial_hash_files(files: DataFrame) -> DataFrame:
    return _apply(files, "partial_hash", _partial, 2 * PARTIAL_CHUNK)
