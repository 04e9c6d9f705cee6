"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Shuffle partitions to start from: about this many bytes each, before adaptive execution merges small ones.
PARTITION_BYTES = 256 << 20

# Of the Parquet files written here: identifiers and paths take about half the bytes they take by the default codec.
COMPRESSION = "zstd"


def shuffle_partitions(data_bytes: int) -> int:
    """Initial number of shuffle partitions for a job that shuffles ``data_bytes``."""
    return max(200, -(-data_bytes // PARTITION_BYTES))


def build_session(app: str = "stowage", master: str | None = None, data_bytes: int | None = None, **conf) -> SparkSession:
    """Session with the settings the operators work best with; ``conf`` wins over them.

    ``data_bytes`` is the expected size of the largest shuffle. Starting with enough partitions keeps each
    within memory; adaptive execution merges those that turn out small and splits skewed ones.
    """
    sized = {} if data_bytes is None else {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_partitions(data_bytes)),
    }
    settings = {
        **sized,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all tasks run in this process.

    Executors of a cluster do not share their local disks, so there a folder has to be named.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stowage-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder name for one run below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Like a reliable checkpoint it survives the loss of any executor; unlike one it is columnar, so later
    steps read only the columns they need and the optimizer knows the size.
    """
    spark = df.sparkSession
    folder = work_folder(spark, label)
    df.write.parquet(folder, compression=COMPRESSION)
    rows = spark.read.schema(df.schema).parquet(folder)
    rows.work_folder = folder
    return rows


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`cut_lineage` wrote for these tables, once nothing reads them any more."""
    for table in tables:
        folder = getattr(table, "work_folder", None)
        if folder:
            jvm = table.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
