"""First free name for every planned move, exactly as if the moves ran one after another.

A file that wants ``x.ext`` takes it if free, else the first free of ``x_1.ext`` ... ``x_999.ext``,
else fails. Names are only ever taken, never freed, and that makes the sequence a set problem:

* The slot ``x_k`` can be wanted by two parties only: files named ``x_k`` themselves (first choice)
  and overflow from ``x``. So a name is affected by others only through its *parent* (the name with
  one ``_k`` removed, k = 1..999 without leading zero) and its existing *children*.
* Without parent and children the answer is arithmetic: the r-th file takes slot r-1 (one later when
  the name already exists).
* A child ``x_k`` with files of its own blocks slot k from the moment its first own file comes. Going
  through the files of ``x`` in order with those moments known gives their slots.
* The only thing a parent passes down is one bit per child: "my overflow took your name before your
  first file came". Slots are worked out for both values of that bit, and the bit is then folded along
  the chain of ancestors, which every name spells out itself.

Ranks above 1000 cannot get a slot, since the 1000 files before them fill the chain. So every array
below has at most 1000 entries and no group grows with the data, however often a name occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.paths import basename, dirname, join_path, stem, suffix
from stowage.operators.skew import HOT_ROWS, local_hot_keys, lookup_with, rank_with
from stowage.session import cut_lineage

# Fixed value: the highest suffix tried.
LAST_SUFFIX = 999
SLOTS = LAST_SUFFIX + 1
COLLISION_LIMIT = "collision limit"

NODE = ["dir", "name"]
_CHILD = r"(?s)^(.+)_([1-9][0-9]{0,2})$"


def _with_node(df: DataFrame, path: Column | str) -> DataFrame:
    return df.withColumn("dir", dirname(path)).withColumn("name", basename(path))


def _numbered(name: Column, slot: Column) -> Column:
    return F.when(slot == 0, name).otherwise(F.concat(stem(name), F.lit("_"), slot.cast("string"), suffix(name)))


def _parent(name: Column) -> Column:
    """Name whose overflow could reach this one, ``''`` when there is none."""
    shorter = F.regexp_extract(stem(name), _CHILD, 1)
    return F.when(shorter == "", F.lit("")).otherwise(F.concat(shorter, suffix(name)))


def _nodes(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per wanted or existing name; ``first`` is null when it exists from the start."""
    both = planned.select(*NODE, F.col("__order").alias("at"), F.lit(False).alias("is_there")).unionByName(
        existing.select(*NODE, F.lit(None).cast("string").alias("at"), F.lit(True).alias("is_there"))
    )
    return both.groupBy(*NODE).agg(
        F.count("at").alias("wanted"),
        F.when(~F.max("is_there"), F.min("at")).alias("first"),
        F.max("is_there").alias("is_there"),
    )


def _there(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_there AND wanted > 0").select(*NODE)


def _edges(nodes: DataFrame) -> DataFrame:
    """Names that overflow from their parent could reach, with the parent and the slot they sit on.

    A parent wanted once, not there yet and out of reach of its own parent never overflows.
    """
    child = (
        nodes.withColumn("parent", _parent(F.col("name")))
        .filter("parent <> ''")
        .withColumn("slot", F.regexp_extract(stem("name"), _CHILD, 2).cast("int"))
    )
    may_overflow = (F.col("wanted") > 1) | F.col("is_there") | (_parent(F.col("name")) != "")
    able = nodes.filter((F.col("wanted") > 0) & may_overflow).select("dir", F.col("name").alias("parent"))
    return child.join(able, ["dir", "parent"], "left_semi")


def _slots(files: Column, blocks: Column, start: int) -> Column:
    """Slot of each file in order, given ``blocks`` = sorted (slot, first) of the children.

    The next slot is the smallest one past the last that no child holds at that moment. Among the held
    slots from there on, sorted, those that still equal ``next + position`` form the run to jump over.
    """
    def place(done: Column, moment: Column) -> Column:
        nxt = done["last"] + 1
        held = F.filter(blocks, lambda b: (b["slot"] >= nxt) & (b["first"].isNull() | (b["first"] < moment)))
        run = F.filter(F.transform(held, lambda b, i: b["slot"] - i), lambda v: v == nxt)
        slot = (nxt + F.size(run)).cast("int")
        return F.struct(slot.alias("last"), F.concat(done["all"], F.array(slot)).alias("all"))

    empty = F.struct(F.lit(start).cast("int").alias("last"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(files, empty, place, lambda done: done["all"])


def _parted(rows: DataFrame, hot: DataFrame | None, hot_rows: int) -> DataFrame:
    """Adds ``parts``: over how many tasks the files of a name are spread before they are limited."""
    if hot is None:
        return rows.withColumn("parts", F.lit(1).cast("bigint"))
    return rows.join(F.broadcast(hot.select(*NODE, F.col("n").alias("__n"))), NODE, "left").withColumn(
        "parts", F.coalesce(F.ceil(F.col("__n") / hot_rows) + 1, F.lit(1)).cast("bigint")).drop("__n")


def _parents(wanted: DataFrame, edges: DataFrame, hot: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Slots of the first 1000 files of every name with children, for both values of the bit."""
    blocks = edges.groupBy("dir", F.col("parent").alias("name")).agg(
        F.array_sort(F.collect_list(F.struct("slot", "first"))).alias("blocks")  # at most 999
    )
    # First 1000 per part and then per name. The names are repeated for each part, so that the join already deals a
    # very common one out by part; the limit on row_number comes before the rows of a name meet.
    parts = _parted(blocks.select(*NODE), hot, hot_rows).select(*NODE, F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    mine = _parted(wanted.select(*NODE, "__order"), hot, hot_rows).select(
        *NODE, "__order", F.pmod(F.xxhash64("__order"), F.col("parts")).alias("part"))
    parted = mine.join(parts, [*NODE, "part"], "left_semi")
    for keys in ([*NODE, "part"], NODE):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__order"))
        parted = parted.withColumn("nth", nth).filter(F.col("nth") <= SLOTS)
    files = parted.groupBy(*NODE).agg(F.array_sort(F.collect_list("__order")).alias("files"))  # at most 1000
    return files.join(blocks, NODE).select(
        *NODE,
        _slots(F.col("files"), F.col("blocks"), -1).alias("if_free"),
        _slots(F.col("files"), F.col("blocks"), 0).alias("if_taken"),
    )


def _taken(edges: DataFrame, parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names that are gone before their own first file comes: existing, or reached by overflow."""
    there = _there(nodes)
    steps = edges.join(parents.withColumnRenamed("name", "parent"), ["dir", "parent"]).select(
        *NODE, F.array_contains("if_free", F.col("slot")).alias("if_free"),
        F.array_contains("if_taken", F.col("slot")).alias("if_taken"),
    )
    bits = (
        steps.unionByName(there.withColumn("if_free", F.lit(True)).withColumn("if_taken", F.lit(True)))
        .groupBy("dir", F.col("name").alias("link"))
        .agg(F.bool_or("if_free").alias("if_free"), F.bool_or("if_taken").alias("if_taken"))
    )
    # Ancestors of a name, itself first: x_1_2 -> [x_1_2, x_1, x]. A missing step resets the bit.
    tail = suffix("name")
    cuts = F.regexp_count(F.regexp_extract(stem("name"), r"(?s)^.+?((?:_[1-9][0-9]{0,2})+)$", 1), F.lit("_"))
    chain = edges.select(*NODE, F.posexplode(F.transform(
        F.sequence(F.lit(0), cuts),
        lambda i: F.concat(
            F.array_join(F.slice(F.split(stem("name"), "_"), F.lit(1), F.size(F.split(stem("name"), "_")) - i), "_"),
            tail,
        ),
    )).alias("level", "link"))
    folded = (
        chain.join(bits, ["dir", "link"], "left")
        .groupBy(*NODE)
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct(
            "level", F.coalesce("if_free", F.lit(False)).alias("if_free"),
            F.coalesce("if_taken", F.lit(False)).alias("if_taken"),
        )))).alias("steps"))
        .filter(F.aggregate(
            "steps", F.lit(False), lambda bit, s: F.when(bit, s["if_taken"]).otherwise(s["if_free"])
        ))
        .select(*NODE)
    )
    return folded.union(there).distinct()


class _Clashes:
    """Tables both results below start from.

    The planned moves, the count per name and the links between names are written once each: they are
    read several times, and the plan that made them may be long.
    """

    def __init__(self, planned: DataFrame, existing: DataFrame, target: str, order: Column, hot_rows: int):
        self.columns = planned.columns
        self.hot_rows = hot_rows
        # Folder, name and order key are worked out again after reading: cheaper than storing paths thrice.
        self.wanted = _with_node(cut_lineage(planned, "wanted"), target).withColumn("__order", order)
        there = _with_node(existing.select("path"), "path").select(*NODE)
        self.nodes = cut_lineage(_nodes(self.wanted, there), "names")
        self.edges = cut_lineage(_edges(self.nodes), "links")
        self.hot = local_hot_keys(self.nodes, NODE, "wanted", hot_rows)

    def ranked(self, facts: DataFrame) -> DataFrame:
        """Wanted names with ``rank`` and the facts of their name; one shuffle serves both."""
        rows = lookup_with(self.wanted, facts, NODE, F.col("__order"), self.hot)
        return rank_with(rows, NODE, [F.col("__order")], "rank", self.hot_rows, self.hot)


def clash_classes(planned: DataFrame, existing: DataFrame, target: str, order: Column,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank of each file among those that want its name, and whether arithmetic alone settles it.

    ``linked`` names have a parent or child in use; for the others the r-th file takes suffix r-1.
    """
    clashes = _Clashes(planned, existing, target, order, hot_rows)
    edges = clashes.edges
    linked = edges.select(*NODE).union(edges.select("dir", F.col("parent").alias("name"))).distinct()
    facts = linked.withColumn("linked", F.lit(True)).join(
        _there(clashes.nodes).withColumn("exists", F.lit(True)), NODE, "full_outer"
    )
    slot = F.col("rank") - 1 + F.coalesce("exists", F.lit(False)).cast("int")
    linked_flag = F.coalesce("linked", F.lit(False))
    path = F.when(~linked_flag & (slot <= LAST_SUFFIX), join_path("dir", _numbered(F.col("name"), slot)))
    return clashes.ranked(facts).select(
        *clashes.columns, "rank", linked_flag.alias("linked"), path.alias("final_path")
    )


def resolve_names(planned: DataFrame, existing: DataFrame, target: str, order: Column,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``final_path`` (null when no name is free) and ``error`` to every planned move.

    ``existing`` has one column ``path``; ``order`` is a string column giving the sequence of the moves.
    """
    clashes = _Clashes(planned, existing, target, order, hot_rows)
    edges = clashes.edges
    if edges.isEmpty():
        facts = _there(clashes.nodes).withColumns({
            "taken": F.lit(True), "if_free": F.lit(None).cast("array<int>"), "if_taken": F.lit(None).cast("array<int>"),
        })
    else:
        parents = cut_lineage(_parents(clashes.wanted, edges, clashes.hot, hot_rows), "parents")
        taken = _taken(edges, parents, clashes.nodes).withColumn("taken", F.lit(True))
        facts = taken.join(parents, NODE, "full_outer")

    gone = F.coalesce("taken", F.lit(False))
    plain = F.col("rank") - 1 + gone.cast("int")
    worked = F.get(F.when(gone, F.col("if_taken")).otherwise(F.col("if_free")), (F.col("rank") - 1).cast("int"))
    slot = F.when(F.col("if_free").isNull(), plain).otherwise(F.coalesce(worked, F.lit(SLOTS)))
    fits = F.col("__slot") <= LAST_SUFFIX
    return clashes.ranked(facts).withColumn("__slot", slot).select(
        *clashes.columns,
        F.when(fits, join_path("dir", _numbered(F.col("name"), F.col("__slot")))).alias("final_path"),
        F.when(~fits, F.lit(COLLISION_LIMIT)).alias("error"),
    )
