import random

import pytest

from stowage.operators.collisions import COLLISION_LIMIT
from stowage.plans import rollback
from stowage.plans.rollback_batch import outcomes_in_order
from tests.test_rollback_ledger import ACTION, action


def numbered(path, k):
    folder, _, name = path.rpartition("/")
    stem, dot, end = name.rpartition(".")
    stem, end = (stem, dot + end) if stem else (name, "")
    return f"{folder}/{stem}_{k}{end}" if k else path


def replay(rows, order, present, refused):
    """Step by step."""
    place, there, out = dict(order), set(present), {}
    todo = [r for r in rows if r[6] == "completed" and r[0] in place]
    for tx, seq, _, kind, source, to, *_ in sorted(todo, key=lambda r: (place[r[0]], -r[1])):
        skip, final = None, None
        if kind == "move":
            skip = rollback.TARGET_GONE if to not in there or not to else rollback.PLACE_TAKEN if source in there else None
            final = source
        elif kind == "delete":
            skip = None if to in there and to else rollback.TRASH_GONE
            final = next((p for p in (numbered(source, k) for k in range(1000)) if p not in there), None)
        else:
            skip = rollback.UNKNOWN_TYPE + kind
        error = skip or refused.get((tx, seq)) or (COLLISION_LIMIT if final is None else None)
        if error:
            out[tx, seq] = ("skipped" if skip else "failed", error, None)
        else:
            there.remove(to)
            there.add(final)
            out[tx, seq] = ("restored", None, final)
    return out


def check(spark, rows, order, present, refused=None, **settings):
    refused = refused or {}
    got = outcomes_in_order(
        spark.createDataFrame(rows, ACTION), spark.createDataFrame(order, "transaction_id string, place bigint"),
        spark.createDataFrame([(p,) for p in present], "path string"),
        spark.createDataFrame([(*k, e) for k, e in refused.items()], "transaction_id string, seq bigint, error string"), **settings)
    got = {(r.transaction_id, r.seq): (r.outcome, r.outcome_error, r.final_path) for r in got.collect()}
    assert got == replay(rows, order, present, refused)
    return got


def test_two_moves_onto_one_path(spark):
    rows = [action(1, "move", "/a", "/x", tx="t1"), action(1, "move", "/a", "/y", tx="t2")]
    got = check(spark, rows, [("t2", 0), ("t1", 1)], ["/x", "/y"])
    assert got["t2", 1][0] == "restored" and got["t1", 1] == ("skipped", rollback.PLACE_TAKEN, None)


def test_chain_of_transactions_and_freed_places(spark):
    rows = [action(1, "move", f"/p{i}", f"/p{i + 1}", tx=f"t{i}") for i in range(6)]
    got = check(spark, rows, [(f"t{i}", 10 - i) for i in range(6)], ["/p6"])
    assert {o for o, _, _ in got.values()} == {"restored"}
    check(spark, rows, [(f"t{i}", i) for i in range(6)], ["/p6"])  # oldest first: only one step finds its file
    check(spark, rows, [(f"t{i}", 10 - i) for i in range(6)], ["/p6", "/p3"])


def test_series_of_names(spark):
    rows = [action(i, "delete", "/d/a.txt", f"/t/{i}", tx=f"t{i % 3}") for i in range(1, 9)]
    rows += [action(20, "move", "/d/a_1.txt", "/m/1", tx="t1"), action(21, "delete", "/d/a_2.txt", "/t/x", tx="t2"),
             action(22, "delete", "/t/1", "/t/1_1", tx="t0"), action(23, "move", "/s", "/s", tx="t0"), action(24, "restore", "/r", "/q", tx="t0")]
    present = [f"/t/{i}" for i in range(1, 9)] + ["/m/1", "/t/x", "/t/1_1", "/d/a_4.txt", "/s"]
    for order in ([("t0", 0), ("t1", 1), ("t2", 2)], [("t2", 0), ("t0", 1), ("t1", 2)]):
        check(spark, rows, order, present, {("t0", 3): "Permission denied"})


def test_full_series_fails(spark):
    rows = [action(i, "delete", "/d/a", f"/t/{i}") for i in range(1, 4)]
    got = check(spark, rows, [("t", 0)], ["/t/1", "/t/2", "/t/3", "/d/a"] + [f"/d/a_{k}" for k in range(1, 999)])
    assert sorted(o for o, _, _ in got.values()) == ["failed", "failed", "restored"]


@pytest.mark.parametrize("seed, hot_rows", [(1, 1_000_000), (2, 4), (3, 1)])
def test_random_steps_equal_replay(spark, seed, hot_rows):
    rng = random.Random(seed)
    names = [f"/g/{n}" for n in ("a", "a_1", "a_1_1", "a_2", "b.x", "b_1.x", "c", "d", "e", "f")]
    rows, present = [], set()
    for group in range(12):
        paths = [f"/{group}{n}" for n in names] + ["/shared", ""]
        present |= {p for p in paths if p and rng.random() < 0.5}
        for i in range(rng.randint(3, 20)):
            kind = rng.choice(["move", "move", "delete", "restore"]) if rng.random() < 0.9 else "delete"
            rows.append(action(group * 100 + i, kind, rng.choice(paths[:-1]), rng.choice(paths), rng.choice(["completed"] * 8 + ["failed"]), tx=f"t{rng.randint(0, 4)}"))
    refused = {(r[0], r[1]): "locked" for r in rows if rng.random() < 0.1}
    check(spark, rows, [("t0", 3), ("t1", 1), ("t2", 2), ("t3", 0)], sorted(present), refused, hot_rows=hot_rows)


def test_nothing_to_undo(spark):
    assert check(spark, [action(1, "move", "/a", "/b", "failed")], [("t", 0)], []) == {}
