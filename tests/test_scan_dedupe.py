import datetime
import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import STRATEGIES, validate_actions, validate_files, validate_transactions
from stowage.plans import dedupe, scan

SCHEMA = ("scan_id string, file_path string, hash string, size bigint, "
          "file_created_at timestamp_ntz, file_modified_at timestamp_ntz")
DAY = datetime.datetime(2024, 1, 1)


def files_of(rows):
    def at(hours):
        return None if hours is None else DAY + datetime.timedelta(hours=hours)

    return [(s, p, h, size, at(c), at(m)) for s, p, h, size, c, m in rows]


def frame(spark, rows):
    return spark.createDataFrame(files_of(rows), SCHEMA)


def random_rows(seed, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        h = "hot" if rng.random() < hot else f"h{rng.randrange(600)}"
        rows.append((f"s{rng.randrange(2)}", f"/r/{rng.randrange(30)}/f{i}", h, len(h) * 10, rng.randrange(1, 9), rng.randrange(1, 9)))
    return rows


def model(rows, strategy):
    """Group, sort, keep the first."""
    keys = {
        "keep-latest": lambda r: (-r[5], r[1].split("/")), "keep-oldest": lambda r: (r[4], r[1].split("/")),
        "keep-largest": lambda r: (-r[3], r[1].split("/")),
    }
    groups = {}
    for row in rows:
        groups.setdefault((row[0], row[2]), []).append(row)
    return {g: sorted(m, key=keys[strategy]) for g, m in groups.items() if len(m) > 1}


@pytest.mark.parametrize("strategy", list(STRATEGIES))
@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
def test_removals_and_ranks_equal_the_model(spark, strategy, hot_rows):
    rows = random_rows(1, 0.4)
    expected = model(rows, strategy)
    df = frame(spark, rows)
    got = {(r.scan_id, r.file_path): r.kept_path for r in dedupe.removals(df, strategy, hot_rows=hot_rows).collect()}
    assert got == {(g[0], m[1]): members[0][1] for g, members in expected.items() for m in members[1:]}
    ranks = {(r.scan_id, r.file_path): (r["rank"], r.is_kept)
             for r in dedupe.ranked_copies(df, strategy, hot_rows=hot_rows).collect()}
    assert ranks == {(g[0], m[1]): (i + 1, i == 0) for g, members in expected.items() for i, m in enumerate(members)}


@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
def test_flags_groups_and_totals_agree(spark, hot_rows):
    rows = random_rows(2, 0.3)
    expected = model(rows, "keep-oldest")
    df = frame(spark, rows)
    flagged = scan.flag_duplicates(df, hot_rows).collect()
    assert len(flagged) == len(rows)
    assert {(r.scan_id, r.file_path): r.duplicate_of for r in flagged if r.is_duplicate} == {
        (g[0], m[1]): members[0][1] for g, members in expected.items() for m in members[1:]
    }
    groups = {(r.scan_id, r.hash): (r.copies, r.total_size, r.wasted_size, r.original) for r in scan.duplicate_groups(df).collect()}
    assert groups == {g: (len(m), sum(x[3] for x in m), sum(x[3] for x in m[1:]), m[0][1]) for g, m in expected.items()}
    totals = scan.scan_summary(df)
    again = scan.summary_of_records(scan.flag_duplicates(df))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, again.collect()))


def test_files_without_times_never_win_and_ties_follow_the_walk(spark):
    df = frame(spark, [("s", "/a.txt", "h", 1, 3, 3), ("s", "/A", "h", 1, None, None), ("s", "/a/z", "h", 1, 3, 3), ("s", "/b", "h", 1, 3, 3), ("s", "/c", "x", 1, 1, 1)])
    for strategy in ("keep-latest", "keep-oldest"):
        assert {r.kept_path for r in dedupe.removals(df, strategy).collect()} == {"/a/z"}
    # Size needs no time: all are equal, so the first in walk order stays.
    assert {r.kept_path for r in dedupe.removals(df, "keep-largest").collect()} == {"/A"}


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="unknown strategy"):
        dedupe.removals(frame(spark, []), "keep-best")


def test_empty_and_single(spark):
    empty, single = frame(spark, []), frame(spark, [("s", "/a", "h", 5, 1, 1)])
    assert dedupe.removals(empty).count() == 0 and scan.scan_summary(empty).count() == 0
    assert scan.flag_duplicates(empty).count() == 0 and scan.duplicate_groups(single).count() == 0
    assert [tuple(r) for r in scan.scan_summary(single).collect()] == [("s", 1, 5, 0, 0)]


def test_actions_apply_and_summary(spark):
    rows = [("s", f"/r/{n}", "h", 10, 1, i + 1) for i, n in enumerate("abcd")] + [("s", "/r/x", "y", 7, 1, 1)]
    df = frame(spark, rows)
    planned = dedupe.delete_actions(dedupe.removals(df), F.lit("t"), "/r/.trash/").withColumn("scan_id", F.lit("s"))
    assert {r.from_path: r.to_path for r in planned.collect()} == {f"/r/{n}": f"/r/.trash/{n}" for n in "abc"}
    assert {r.to_path for r in dedupe.delete_actions(dedupe.removals(df), F.lit("t"), None).collect()} == {""}
    done = planned.withColumn("status", F.when(F.col("from_path") == "/r/a", "failed").otherwise("completed"))
    assert {r.file_path for r in dedupe.surviving_files(df, done).collect()} == {"/r/a", "/r/d", "/r/x"}
    row = dedupe.dedupe_summary(df, done).first()
    assert tuple(row) == ("s", 1, 3, 2, 1, 20, 20)
    assert dedupe.dedupe_summary(df, planned, dry_run=True).first().saved_bytes == 30


def test_progressive_reads_only_what_may_have_a_copy(spark):
    rows = [("s", "/a", None, 5, 1, 1), ("s", "/b", None, 5, 2, 2), ("s", "/c", None, 5, 3, 3), ("s", "/d", None, 9, 1, 1)]
    content = {"/a": "same", "/b": "same", "/c": "other"}
    opened = spark.sparkContext.accumulator(0)

    def add(column):
        def run(df):
            def read(batches):
                for batch in batches:
                    opened.add(len(batch))
                    yield batch.assign(**{column: [content[p] for p in batch["file_path"]]})
            names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
            return df.mapInPandas(read, f"{names}, {column} string")
        return run

    files = frame(spark, rows).drop("hash")
    found = dedupe.progressive_candidates(files, add("partial_hash"), add("hash"))
    assert {(r.file_path, r["hash"]) for r in found.collect()} == {("/a", "same"), ("/b", "same")}
    assert opened.value == 3 + 2


def test_directory_size(spark):
    df = frame(spark, [("s", "/a/b/c", "h", 5, 1, 1), ("s", "/a/d", "h", 2, 1, 1), ("s", "/e", "h", 1, 1, 1)])
    got = {r.folder: (r.files, r["size"]) for r in scan.directory_size(df).collect()}
    assert got == {"/": (3, 8), "/a": (2, 7), "/a/b": (1, 5)}


def test_top_groups_say_how_many_are_left_out(spark):
    df = frame(spark, [("s", f"/{g:02d}/{i}", f"h{g:02d}", g, 1, 1) for g in range(13) for i in range(2)])
    rows = scan.top_duplicate_groups(scan.duplicate_groups(df)).collect()
    assert [r.wasted_size for r in rows] == list(range(12, 2, -1)) and {r.more for r in rows} == {3}
    few = scan.top_duplicate_groups(scan.duplicate_groups(df.filter("size < 4"))).collect()
    assert len(few) == 4 and {r.more for r in few} == {0}


def test_validation_keeps_every_row_with_reasons(spark):
    actions = spark.createDataFrame(
        [("1", "move", "/a", "completed"), ("", "copy", None, "lost"), ("2", None, "/a", None)],
        "action_id string, type string, from_path string, status string")
    assert [r.reasons for r in validate_actions(actions).collect()] == [
        [], ["action_id missing", "type not allowed", "from_path missing", "status not allowed"], ["type missing"]]
    headers = spark.createDataFrame([("t", "dedupe", "failed", "/r"), ("t", "rollback", "open", None)],
                                    "transaction_id string, type string, status string, target_path string")
    assert [r.valid for r in validate_transactions(headers).collect()] == [True, False]
    files = spark.createDataFrame([("s", "n", "p", "p", None, "Code")],
                                  "scan_id string, file_name string, file_path string, original_path string, hash string, category string")
    assert validate_files(files).first().reasons == ["hash missing"]
