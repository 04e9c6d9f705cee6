import random

import pytest
from pyspark.sql import functions as F

from stowage.sources import contents


@pytest.mark.parametrize("alpha", [0.6, 1.1, 3.0])
def test_no_task_reads_twice_the_mean(spark, monkeypatch, alpha):
    """Sizes with a heavy tail, the largest of them about a task's share."""
    rng = random.Random(3)
    sizes = [min(int(rng.paretovariate(alpha) * 1000), 2_000_000) for _ in range(3000)]
    monkeypatch.setattr(contents, "BYTES_PER_TASK", max(2_000_000, sum(sizes) // 16))
    files = spark.createDataFrame([(f"/f{i}", s, "x") for i, s in enumerate(sizes)], "file_path string, size bigint, hash string")
    dealt = contents.spread_by_cost(files, F.col("size")).withColumn("p", F.spark_partition_id())
    tasks = dealt.rdd.getNumPartitions()
    loads = [r.n for r in dealt.groupBy("p").agg(F.sum("size").alias("n")).collect()]
    assert sum(loads) == sum(sizes) and max(loads) <= 2 * max(sum(sizes) / tasks, max(sizes))
    assert sorted(r.file_path for r in dealt.collect()) == sorted(f"/f{i}" for i in range(3000))


def test_empty_and_unknown_sizes(spark):
    files = spark.createDataFrame([("/a", None), ("/b", 0)], "file_path string, size bigint")
    assert contents.hash_files(files).count() == 2 and contents.partial_hash_files(files.limit(0)).count() == 0
