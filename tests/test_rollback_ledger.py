import datetime

from pyspark.sql import functions as F

from stowage.plans import ledger, report, rollback
from stowage.schemas import SUMMARY_FIELDS

ACTION = ("transaction_id string, seq bigint, action_id string, type string, from_path string, to_path string, "
          "status string, error string, file_hash string, file_size bigint, outcome string")
AT = datetime.datetime(2024, 1, 1)


def action(seq, kind, source, to, status="completed", tx="t", size=10):
    return (tx, seq, f"a{seq}", kind, source, to, status, None, "h", size, None)


def judged(spark, rows, present, failures=None, hot_rows=1_000_000):
    paths = spark.createDataFrame([(p,) for p in present], "path string")
    return rollback.outcomes(spark.createDataFrame(rows, ACTION), paths, failures, hot_rows)


def test_every_branch(spark):
    rows = [
        action(1, "move", "/a", "/c/a"), action(2, "move", "/b", "/c/b"), action(3, "move", "/d", "/c/d"),
        action(4, "delete", "/e", "/t/e"), action(5, "delete", "/f", ""), action(6, "delete", "/g", "/t/g"),
        action(7, "restore", "/h", "/i"), action(8, "move", "/j", "/c/j", "failed"), action(9, "move", "/k", "/c/k"),
    ]
    refused = spark.createDataFrame([("t", 9, "Permission denied")], "transaction_id string, seq bigint, error string")
    present = ["/c/a", "/c/b", "/b", "/t/e", "/c/j", "/c/k", ""]
    for hot_rows in (1_000_000, 1):
        got = judged(spark, rows, present, refused, hot_rows).collect()
        assert {r.seq: (r.outcome, r.outcome_error) for r in got} == {
            1: ("restored", None), 2: ("skipped", rollback.PLACE_TAKEN), 3: ("skipped", rollback.TARGET_GONE),
            4: ("restored", None), 5: ("skipped", rollback.TRASH_GONE), 6: ("skipped", rollback.TRASH_GONE),
            7: ("skipped", "Unknown action type: restore"), 9: ("failed", "Permission denied"),
        }
    out = judged(spark, rows, present, refused)
    ledger_rows = {r.seq: r for r in rollback.rollback_actions(out, F.lit("u")).collect()}
    assert ledger_rows[5].from_path == "/f" and ledger_rows[1].from_path == "/c/a" and ledger_rows[1].to_path == "/a"
    assert ledger_rows[3].status == "completed" and ledger_rows[9].status == "failed"
    assert ledger_rows[3].outcome == "skipped" and ledger_rows[1].file_hash == "h"
    summary = rollback.rollback_summary(out).first().asDict()
    assert summary == {"transaction_id": "t", "total_actions": 8, "restored_count": 2, "failed_count": 1,
                       "skipped_count": 5, "status": "partially_completed"}
    rest = rollback.not_restored(out, 3).collect()
    assert [r.seq for r in rest] == [9, 7, 6] and {r.more for r in rest} == {3}


def test_restored_deletes_get_free_names_in_reverse_order(spark):
    rows = [action(1, "delete", "/r/a.txt", "/t/1"), action(2, "delete", "/r/a.txt", "/t/2"), action(3, "delete", "/r/b", "/t/3"),
            action(4, "move", "/r/m", "/c/m")]
    out = judged(spark, rows, ["/t/1", "/t/2", "/t/3", "/r/b", "/c/m"])
    paths = spark.createDataFrame([("/r/b",), ("/t/1",)], "path string")
    got = {r.seq: r.final_path for r in rollback.restored_paths(out, paths).collect()}
    assert got == {1: "/r/a_1.txt", 2: "/r/a.txt", 3: "/r/b_1", 4: "/r/m"}


def test_eligibility(spark):
    known = spark.createDataFrame([("a", "completed", False), ("b", "rolled_back", False), ("c", "pending", True)],
                                  "transaction_id string, status string, dry_run boolean")
    asked = spark.createDataFrame([(x,) for x in "abcd"], "transaction_id string")
    got = {r.transaction_id: r.reason for r in rollback.eligibility(asked, known).collect()}
    assert got == {"a": None, "b": rollback.ALREADY_DONE + "b", "c": rollback.WAS_DRY_RUN + "c", "d": rollback.NOT_FOUND + "d"}


def headers(spark, rows):
    data = [(i, kind, status, dry, AT + datetime.timedelta(days=day), dict(zip(SUMMARY_FIELDS, [0, 0, 0, 0, saved, 0])) if saved is not None else None)
            for i, kind, status, dry, day, saved in rows]
    summary = "struct<" + ", ".join(f"{f}: bigint" for f in SUMMARY_FIELDS) + ">"
    return spark.createDataFrame(data, f"transaction_id string, type string, status string, dry_run boolean, created_at timestamp_ntz, summary {summary}")


ROWS = [("a", "dedupe", "completed", False, 1, 100), ("b", "dedupe", "rolled_back", False, 2, 30),
        ("c", "dedupe", "pending", True, 3, 5), ("d", "rollback", "completed", False, 4, None),
        ("e", "organize", "partially_completed", False, 4, 7)]


def test_space_saved_keeps_the_double_subtraction_and_gives_the_plain_sum(spark):
    assert tuple(report.space_saved(headers(spark, ROWS)).first()) == (70, 100, 5)
    assert tuple(report.space_saved(headers(spark, [("b", "dedupe", "rolled_back", False, 2, 30)])).first()) == (0, 0, 1)
    assert tuple(report.space_saved(headers(spark, [])).first()) == (0, 0, 0)


def test_lookups(spark):
    tx = headers(spark, ROWS)
    ids = lambda df: [r.transaction_id for r in df.collect()]
    assert ids(ledger.rollbackable(tx)) == ["d", "e", "a"]
    assert ids(ledger.rollback_history(tx)) == ["d"]
    assert ids(ledger.recent(tx, 2)) == ["d", "e"] and ids(ledger.recent(tx, 5, "dedupe")) == ["c", "b", "a"]
    shown = ledger.rollbackable_on_dashboard(tx, 3, 2)
    assert [(r.transaction_id, r.can_roll_back) for r in shown.collect()] == [("d", False), ("e", True)]
    assert [r.saved_bytes for r in report.recent_activity(tx).collect()] == [0, 7, 5, 30, 100]


def test_newest_event_wins(spark):
    tx = spark.createDataFrame([("a", "completed"), ("b", "completed")], "transaction_id string, status string")
    events = spark.createDataFrame([("a", 0, "completed", None, None), ("a", 1, "rolled_back", AT, "r")],
                                   "transaction_id string, event_seq bigint, status string, rolled_back_at timestamp_ntz, rollback_transaction_id string")
    got = {r.transaction_id: (r.status, r.rollback_transaction_id) for r in ledger.current_state(tx, events).collect()}
    assert got == {"a": ("rolled_back", "r"), "b": ("completed", None)}


def test_counters_status_and_nesting(spark):
    rows = [action(1, "delete", "/a", "", size=10), action(2, "delete", "/b", "", "failed", size=5), action(3, "delete", "/c", "", "failed", size=6)]
    tx = spark.createDataFrame([("t", False), ("empty", False)], "transaction_id string, dry_run boolean")
    acts = spark.createDataFrame(rows, ACTION)
    got = {r.transaction_id: r for r in ledger.transaction_summary(tx, acts).collect()}
    assert (got["t"].saved_bytes, got["t"].saved_bytes_exact, got["t"].failed_count) == (7, 10, 2)
    assert got["empty"].total_processed == 0
    status = {(d, f): s for d, f, s in spark.createDataFrame([(True, 0), (False, 0), (False, 3)], "d boolean, f int").select(
        "d", "f", ledger.outcome_status(F.col("d"), F.col("f"))).collect()}
    assert status == {(True, 0): "pending", (False, 0): "completed", (False, 3): "partially_completed"}
    nested = {r.transaction_id: [a.seq for a in r.actions] for r in ledger.nested(tx, acts).collect()}
    assert nested == {"t": [1, 2, 3], "empty": []}
    pages = {(r.transaction_id, r.page): [a.seq for a in r.actions] for r in ledger.nested(tx, acts, 2).collect()}
    assert pages == {("t", 0): [1, 2], ("t", 1): [3], ("empty", 0): []}


def test_open_actions(spark):
    tx = headers(spark, ROWS)
    acts = spark.createDataFrame([action(1, "delete", f"/{t}", "", tx=t) for t in "abcdz"] + [action(2, "delete", "/x", "", "failed", tx="a")], ACTION)
    for hot_rows in (1_000_000, 1):
        assert sorted(r.transaction_id for r in ledger.open_actions(acts, tx, hot_rows).collect()) == ["a", "d"]


def test_outcomes_and_error_texts(spark):
    planned = spark.createDataFrame([action(i, "move", f"/{i}", f"/c/{i}", "pending") for i in range(3)], ACTION)
    said = spark.createDataFrame([(0, True, None, "/c/0_1"), (1, False, "locked", None)], "seq bigint, ok boolean, error string, final_path string")
    got = {r.seq: (r.status, r.error, r.to_path) for r in ledger.record_outcomes(planned, said, ["seq"]).collect()}
    assert got == {0: ("completed", None, "/c/0_1"), 1: ("failed", "locked", "/c/1"), 2: ("pending", None, "/c/2")}
    codes = spark.createDataFrame([("EACCES", "x"), ("EBUSY", ""), ("ENOENT", "gone"), ("EIO", "disk"), ("EIO", None)], "c string, m string")
    texts = codes.select(ledger.error_reason("c", "m"), ledger.error_reason("c", "m", move=False)).collect()
    assert [tuple(t) for t in texts] == [("Permission denied",) * 2, ("File is locked/busy",) * 2, ("File not found", "gone"),
                                         ("disk", "disk"), ("Unknown error", "Unknown error")]
