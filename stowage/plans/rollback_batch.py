"""Undoing several transactions one after another, as one job.

Each step takes a file from one path to another if the file is there and the place is free, so what a step does depends
on all steps before it that touch either path. With 0 for a free path and 1 for a taken one, a move from ``t`` back to
``p`` makes ``p`` the maximum of both and ``t`` the minimum. A restored delete does so with its place, then with what is left
over and the next name of its series. Along one path the steps are therefore a sequence of "at least x" and "at most y",
and a path's state before each step is a running aggregate, wherever x and y are known.

They become known in rounds. Unknown inputs lie between 0 and 1: a step whose file is known to be missing changes nothing, one
that finds a free place settles it for all later steps, whatever came before. So a path that very many steps touch takes no
more rounds than others; the rounds are as many as the longest chain of steps that really wait for each other, such as one file moved
by many transactions. The first open step is always settled, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.paths import basename
from stowage.operators.collisions import COLLISION_LIMIT, LAST_SUFFIX, _numbered, _parent
from stowage.operators.skew import HOT_ROWS, hot_keys, lookup, lookup_with, rank_with, rank_within
from stowage.plans.rollback import PLACE_TAKEN, TARGET_GONE, TRASH_GONE, UNKNOWN_TYPE
from stowage.session import cut_lineage, discard

FREE, OPEN, TAKEN = 0, 1, 2
#: What an event does to its path. Open ones raise (an arrival) or lower (a departure) it at most to OPEN.
CLEAR, UNKNOWN, FILL, NOTHING = 0, 1, 2, 3


def _beside(path: Column, name: Column) -> Column:
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(basename(path))), name)


def _steps(actions: DataFrame, order: DataFrame, failures: DataFrame | None) -> DataFrame:
    steps = actions.filter("status = 'completed'").join(order.select("transaction_id", "place"), "transaction_id")
    if failures is None:
        steps = steps.withColumn("refusal", F.lit(None).cast("string"))
    else:
        steps = steps.join(failures.select("transaction_id", "seq", F.col("error").alias("refusal")), ["transaction_id", "seq"], "left")
    return cut_lineage(steps.withColumn("sid", F.monotonically_increasing_id()), "steps")


def _places(live: DataFrame, present: DataFrame, hot_rows: int) -> DataFrame:
    """Events (sid, path, k) at the places that a step may fill, k = 0 for the original one.

    A delete has as many further names as may be taken when its turn comes: those of the series that exist or
    are wanted by others, and one for each earlier delete of the same path, up to the last suffix.
    """
    step = ["sid", "place", "back", "reads"]
    moves = live.filter("type = 'move' AND from_path <> to_path").select(*step, F.col("from_path").alias("path"), F.lit(0).alias("k"))
    deletes = rank_within(live.filter("type = 'delete'"), ["from_path"], [F.col("place"), F.col("back")], "earlier", hot_rows)
    names = present.select("path").union(live.select("from_path")).distinct()
    shorter = _parent(basename("path"))
    series = names.filter(shorter != "").select(_beside(F.col("path"), shorter).alias("from_path")).groupBy("from_path").agg(F.count("*").alias("series"))
    counted = lookup(deletes, series, ["from_path"], F.col("sid"), hot_rows)
    tries = F.least(F.coalesce("series", F.lit(0)) + F.col("earlier"), F.lit(LAST_SUFFIX)).cast("int")
    exploded = counted.select(*step, "from_path", "to_path", F.explode(F.sequence(F.lit(0), tries)).alias("k"))
    tried = exploded.select(*step, _beside(F.col("from_path"), _numbered(basename("from_path"), F.col("k"))).alias("path"), "k", "to_path")
    return moves.unionByName(tried.filter("path <> to_path").drop("to_path"))


def _before(events: DataFrame, many: bool) -> DataFrame:
    """The events of paths with open ones, and ``state``, that of the path before the event. A very common path is looked at block
    by block; ``events`` then have no others."""
    if not many:
        waits = F.max(~F.col("settled")).over(Window.partitionBy("path"))
        events = events.withColumn("__waits", waits).filter("__waits").drop("__waits")
    reset = F.when(F.col("effect").isin(CLEAR, FILL), F.struct("pos", "effect"))
    up, down = (F.when((F.col("effect") == UNKNOWN) & side, F.col("pos")) for side in (F.col("k") >= 0, F.col("k") < 0))
    parts = {"__reset": reset, "__up": up, "__down": down}
    earlier = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumns({n: F.max(c).over(earlier) for n, c in parts.items()})
    if many:
        whole = events.groupBy("path", "block").agg(*[F.max(c).alias(n) for n, c in parts.items()])
        blocks = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        whole = whole.select("path", "block", *[F.max(n).over(blocks).alias(f"{n}_so_far") for n in parts])
        rows = rows.join(whole, ["path", "block"]).withColumns({n: F.coalesce(n, f"{n}_so_far") for n in parts}).drop(*[f"{n}_so_far" for n in parts])
    base, since = F.coalesce("__reset.effect", "initial"), F.coalesce("__reset.pos", F.lit(0))
    state = (
        F.when((base == TAKEN) & (F.coalesce("__down", F.lit(0)) <= since), TAKEN)
        .when((base == FREE) & (F.coalesce("__up", F.lit(0)) <= since), FREE).otherwise(OPEN)
    )
    return rows.withColumn("state", state).drop(*parts)


def _judge(open_events: DataFrame) -> DataFrame:
    """Adds to the events of open steps what they do, as far as it is known, and what the step comes to:
    ``there`` (its file), ``chosen`` (its place), ``settled``."""
    step = Window.partitionBy("sid")
    earlier = step.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = open_events.withColumn("offered", F.min("state").over(earlier)).withColumns({
        "there": F.min(F.when(F.col("k") < 0, F.col("state"))).over(step),
        "full": F.min(F.when(F.col("k") >= 0, F.col("state"))).over(step),
        "chosen": F.min(F.when((F.col("k") >= 0) & (F.col("offered") == TAKEN) & (F.col("state") == FREE), F.col("k"))).over(step),
    })
    full = F.coalesce("full", F.lit(TAKEN))
    settled = (F.col("there") == FREE) | F.col("chosen").isNotNull() | ((F.col("there") == TAKEN) & (full == TAKEN))
    arrival = F.when((F.col("offered") == FREE) | (F.col("state") == TAKEN), NOTHING).when(F.col("offered") == TAKEN, FILL).otherwise(UNKNOWN)
    departure = F.when((F.col("there") == FREE) | (full == TAKEN), NOTHING).when(full == FREE, CLEAR).otherwise(UNKNOWN)
    effect = F.when(F.col("reads"), NOTHING).when(F.col("k") >= 0, arrival).otherwise(departure)
    return rows.withColumns({"settled": settled, "effect": effect}).drop("offered", "full")


def outcomes_in_order(
    actions: DataFrame, order: DataFrame, present_paths: DataFrame, failures: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Outcome of every completed action of the transactions in ``order`` (transaction_id, place), undone by ascending
    place, inside one transaction from the last action to the first: the columns of the action with ``place``, outcome,
    outcome_error and final_path (where a restored file is put).

    ``present_paths`` is a set of paths, as they are before the first step; ``failures`` (transaction_id, seq, error) are steps
    that the file system refuses. A deleted file whose series of names is full fails.
    """
    steps = _steps(actions, order, failures)
    live = steps.filter("type IN ('move', 'delete') AND to_path <> ''").select(
        "sid", "place", (-F.col("seq")).alias("back"), "type", "from_path", "to_path",
        (F.col("refusal").isNotNull() | (F.col("type") == "move") & (F.col("from_path") == F.col("to_path"))).alias("reads"))
    leaving = live.select("sid", "place", "back", "reads", F.col("to_path").alias("path"), F.lit(-1).alias("k"))
    events = leaving.unionByName(_places(live, present_paths, hot_rows))
    turn = [F.col("place"), F.col("back")]
    hot = hot_keys(events, ["path"], hot_rows)
    many = hot is not None
    events = rank_with(events, ["path"], turn, "pos", hot_rows, hot)
    there = present_paths.select("path", F.lit(True).alias("__there")).distinct()
    events = lookup_with(events, there, ["path"], F.col("sid"), hot)
    # Each path is read again in every round: where none is very common, its first event stands for it.
    first = F.first(F.struct("sid", "k")).over(Window.partitionBy("path").orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0))
    block = F.floor((F.col("pos") - 1) / hot_rows).cast("long") if many else F.lit(0).cast("long")
    events = events.select(
        (F.col("path") if many else first).alias("path"), "pos", block.alias("block"), "sid", "k", "reads",
        F.when(F.col("__there"), TAKEN).otherwise(FREE).alias("initial"), F.lit(UNKNOWN).alias("effect"), F.lit(False).alias("settled"))
    events = cut_lineage(events, "events")

    columns = events.columns
    done: list[DataFrame] = []
    while True:
        # One shuffle by path, one by step and one table for each round. Events of settled steps pass through.
        states = _before(events, many)
        passed = states.filter("settled").select(*columns, *[F.lit(None).cast("int").alias(c) for c in ("there", "chosen")])
        judged = _judge(states.filter("NOT settled")).select(*columns, "there", "chosen")
        judged = cut_lineage(judged if not done else passed.unionByName(judged), "judged")
        done.append(judged.filter("settled AND k < 0 AND there IS NOT NULL").select("sid", "there", "chosen"))
        waiting = judged.filter("NOT settled").select("path")
        old = events
        if not waiting.isEmpty():
            events = judged.select(*columns)
            if many:
                events = cut_lineage(events.join(waiting.distinct(), "path", "left_semi"), "events")
        discard(old)
        if events is old:
            break
    found = done[0]
    for more in done[1:]:
        found = found.union(more)

    kind = F.col("type")
    gone = F.coalesce(F.col("there") == FREE, F.lit(True))
    skip = (
        F.when((kind == "move") & gone, F.lit(TARGET_GONE)).when((kind == "move") & F.col("chosen").isNull(), F.lit(PLACE_TAKEN))
        .when((kind == "delete") & gone, F.lit(TRASH_GONE)).when(~kind.isin("move", "delete"), F.concat(F.lit(UNKNOWN_TYPE), kind))
    )
    refusal = F.coalesce("refusal", F.when(F.col("chosen").isNull(), F.lit(COLLISION_LIMIT)))
    outcome = F.when(skip.isNotNull(), "skipped").when(refusal.isNotNull(), "failed").otherwise("restored")
    place = _beside(F.col("from_path"), _numbered(basename("from_path"), F.col("chosen")))
    return steps.join(found, "sid", "left").withColumns({
        "outcome": outcome, "outcome_error": F.coalesce(skip, refusal), "final_path": F.when(outcome == "restored", place),
    }).drop("sid", "refusal", "there", "chosen")
