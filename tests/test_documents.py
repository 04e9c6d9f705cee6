import json

from pyspark.sql import functions as F

from stowage.plans import documents, organize, scan
from tests.test_rollback_ledger import ACTION, action

HEAD = ("transaction_id string, type string, status string, target_path string, dry_run boolean, strategy string, "
        "summary struct<moved_count: bigint, deleted_count: bigint, restored_count: bigint, failed_count: bigint, saved_bytes: bigint, total_processed: bigint>")


def test_pages_of_a_run(spark):
    heads = spark.createDataFrame([("t", "organize", "completed", "/r", False, None, (3, 0, 0, 0, None, 3)), ("none", "dedupe", "pending", "/r", True, "keep-latest", None)], HEAD)
    steps = spark.createDataFrame([action(i, "move", f"/r/{i}", f"/r/Code/{i}") for i in (3, 1, 2)], ACTION)
    got = {(r.transaction_id, r.page): json.loads(r.document) for r in documents.run_documents(heads, steps, 2).collect()}
    assert sorted(got) == [("none", 0), ("t", 0), ("t", 1)]
    assert [a["from"] for a in got["t", 0]["actions"]] == ["/r/1", "/r/2"] and [a["to"] for a in got["t", 1]["actions"]] == ["/r/Code/3"]
    assert got["none", 0]["actions"] == [] and got["none", 0]["summary"]["savedBytes"] == 0 and got["t", 0]["summary"]["movedCount"] == 3
    assert got["t", 0]["actions"][0] == {"from": "/r/1", "to": "/r/Code/1", "status": "completed", "error": None, "size": 10}
    skipped = steps.withColumn("outcome", F.lit("skipped"))
    assert {a["status"] for r in documents.run_documents(heads, skipped).collect() for a in json.loads(r.document)["actions"]} == {"skipped"}


def test_categories_come_largest_first(spark):
    files = spark.createDataFrame([("s", "Code", 1), ("s", "Images", 9), ("s", "Code", 2), ("r", "Audio", 1)], "scan_id string, category string, size bigint")
    assert [(r.scan_id, r.category) for r in scan.categories_by_size(files).collect()] == [("r", "Audio"), ("s", "Images"), ("s", "Code")]
    assert [(r.scan_id, r.category, r.files) for r in organize.by_category(files).collect()] == [("r", "Audio", 1), ("s", "Code", 2), ("s", "Images", 1)]
