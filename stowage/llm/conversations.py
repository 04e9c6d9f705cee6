"""Repair of conversations: the cheapest edits to a legal order of roles, by a grammar-compressed min-plus DP."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.skew import HOT_ROWS, lookup, rank_within
from stowage.session import cut_lineage, discard

#: Rows of a conversation that are folded into one matrix; a longer conversation has several, which are folded again.
CHUNK = 4096
#: Symbols that share a grammar. Results do not depend on it.
GRAMMAR_SYMBOLS = 1 << 17

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A row's symbol: the initial of its role (``o``: any other), a capital letter for a truncated row, ``x`` for one that has to go.
SYMBOLS = "suaoSUAOx"
#: What has been written so far: nothing, the system row, or rows that end with a user's or an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Insertions that end a conversation legally.
ENDING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def turn_of(state: int) -> str:
    """The only role but ``s`` that may follow."""
    return "a" if state == USER else "u"


# --- ropes -----------------------------------------------------------------------------------------------------------


class Rope:
    """A string as a tree. Equal pairs of parts are one object (see :class:`Ropes`), so most comparisons end early."""
    __slots__ = ("text", "left", "right", "size")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if text is not None else left.size + right.size

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.text is not None:
                out.append(r.text)
            else:
                todo += [r.right, r.left]
        return "".join(out)


class Ropes:
    def __init__(self):
        self.leaves: dict[str, Rope] = {}
        self.joins: dict[tuple[int, int], Rope] = {}

    def leaf(self, text: str) -> Rope:
        return self.leaves.setdefault(text, Rope(text))

    def join(self, a: Rope, b: Rope) -> Rope:
        return self.joins.setdefault((id(a), id(b)), Rope(None, a, b))

    def less(self, a: Rope, b: Rope) -> bool:
        """Whether one string comes before the other; neither begins with the other unless they are equal."""
        left, right = [a], [b]
        while left and right:
            x, y = left.pop(), right.pop()
            if x is y:
                continue
            if x.text is not None and y.text is not None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                left += [self.leaf(x.text[n:])] if x.size > n else []
                right += [self.leaf(y.text[n:])] if y.size > n else []
            elif y.text is not None or x.text is None and x.size >= y.size:
                left += [x.right, x.left]
                right.append(y)
            else:
                left.append(x)
                right += [y.right, y.left]
        return bool(right)


# --- min-plus matrices: [from][to] is (cost, rope of edit initials) or None ---------------------------------------------


def symbol_matrix(symbol: str, ropes: Ropes) -> list[list[tuple[int, Rope] | None]]:
    """All ways past one row: insertions before it, then one edit of it. Insertions after it belong to the next row or the end."""
    out: list[list] = [[None] * 4 for _ in STATES]

    def offer(a: int, b: int, cost: int, audit: str) -> None:
        if out[a][b] is None or (cost, audit) < (out[a][b][0], str(out[a][b][1])):
            out[a][b] = (cost, ropes.leaf(audit))

    for state in STATES:
        at, cost, audit = state, 0, ""
        for _ in range(3):  # any state is reached by at most two
            offer(state, at, cost + DELETE, audit + "D")
            if symbol != "x":
                extra = TRUNCATED if symbol.isupper() else 0
                offer(state, NEXT[at, turn_of(at)], cost + REROLE + extra, audit + "R")
                if (at, symbol.lower()) in NEXT:
                    offer(state, NEXT[at, symbol.lower()], cost + KEEP + extra, audit + "K")
            at, cost, audit = NEXT[at, turn_of(at)], cost + INSERT, audit + "I"
    return out


def product(a: list[list], b: list[list], ropes: Ropes) -> list[list]:
    """Min-plus product: the cheapest way through both; of equally cheap ones the least string. Ways of the same rows and cost
    never begin with one another, so the least whole consists of the least parts."""
    out: list[list] = [[None] * 4 for _ in STATES]
    for i in STATES:
        for k in STATES:
            best = None
            for j in STATES:
                x, y = a[i][j], b[j][k]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost <= best[0]:
                    rope = ropes.join(x[1], y[1])
                    if best is None or cost < best[0] or ropes.less(rope, best[1]):
                        best = (cost, rope)
            out[i][k] = best
    return out


def product_of(matrices: list[list], ropes: Ropes) -> list[list]:
    while len(matrices) > 1:
        pairs = [product(a, b, ropes) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(matrices) - len(matrices) % 2:]
    return matrices[0]


# --- Re-Pair ---------------------------------------------------------------------------------------------------------


def re_pair(sequences: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (pairs of symbols; rule k is symbol len(SYMBOLS) + k) and the sequences written with them.

    The most frequent pair becomes a rule until none occurs twice. Pairs do not reach across sequences, rules hold for all.
    """
    code = {c: i for i, c in enumerate(SYMBOLS)}
    at: list[int] = []
    for s in sequences:
        at += [code[c] for c in s]
        at.append(-1)
    after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for i in range(len(at) - 1):
        if at[i] >= 0 and at[i + 1] >= 0:
            places.setdefault((at[i], at[i + 1]), set()).add(i)
    heap = [(-len(where), pair) for pair, where in places.items() if len(where) > 1]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heappop(heap)
        now = len(places.get(pair, ()))
        if now < 2:
            continue
        if now != -count:
            heappush(heap, (-now, pair))
            continue
        new, changed = len(SYMBOLS) + len(rules), set()
        rules.append(pair)
        for i in sorted(places.pop(pair)):
            j = after[i]
            if at[i] != pair[0] or j >= len(at) or at[j] != pair[1]:
                continue  # a neighbour has taken one of the two, as in aaa
            h, k = before[i], after[j]
            if h >= 0 and at[h] >= 0:
                places.get((at[h], at[i]), set()).discard(h)
            if at[k] >= 0:
                places.get((at[j], at[k]), set()).discard(j)
            at[i], at[j], after[i], before[k] = new, -2, k, i
            if h >= 0 and at[h] >= 0:
                places.setdefault((at[h], new), set()).add(h)
                changed.add((at[h], new))
            if at[k] >= 0:
                places.setdefault((new, at[k]), set()).add(i)
                changed.add((new, at[k]))
        for p in changed:
            if len(places[p]) > 1:
                heappush(heap, (-len(places[p]), p))
    out, i = [], 0
    for _ in sequences:
        row = []
        while at[i] != -1:
            row.append(at[i])
            i = after[i]
        out.append(row)
        i = after[i]
    return rules, out


def transfer(sequences: list[str]) -> list[tuple[list[int | None], list[int | None], list[str | None]]]:
    """Costs, ranks and audits of the ways through each sequence, at 4 * from + to. Rules come before their uses, so one pass
    from the bottom gives the matrix of every rule, once for all sequences. A rank orders the ways from one state by their string."""
    ropes = Ropes()
    rules, written = re_pair(sequences)
    matrices = [symbol_matrix(s, ropes) for s in SYMBOLS]
    for a, b in rules:
        matrices.append(product(matrices[a], matrices[b], ropes))
    out = []
    for row in written:
        m = product_of([matrices[s] for s in row], ropes)
        costs, ranks, audits = [], [], []
        for line in m:
            texts = [str(e[1]) if e else None for e in line]
            order = sorted(t for t in texts if t is not None)
            costs += [e[0] if e else None for e in line]
            ranks += [order.index(t) if t is not None else None for t in texts]
            audits += texts
        out.append((costs, ranks, audits))
    return out


def cheapest_path(chunks: list[tuple[list, list]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost and (from, to) of each chunk, given the chunks' costs and ranks from the last to the first.

    Ways from one state to two others have different strings, so the first chunk in which two equally cheap paths differ
    decides by its ranks.
    """
    best = {state: ENDING[state][0] for state in STATES}
    steps = []
    for costs, ranks in chunks:
        now, step = {}, {}
        for a in STATES:
            ways = [(costs[4 * a + b] + best[b], ranks[4 * a + b], b) for b in STATES if costs[4 * a + b] is not None and b in best]
            if ways:
                now[a], _, step[a] = min(ways)
        best = now
        steps.append(step)
    state, path = START, []
    for step in reversed(steps):
        path.append((state, step[state]))
        state = step[state]
    return best[START], path


# --- tables ----------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text) of the conversations after the damage that a checksum of conversation and turn asks for: 0 of
    20 drops a row, 1 empties it, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's. A null text or role is one space.
    ``key`` names the conversation, a null one as well."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(conversation_key().alias("key"), "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    rows = rows.filter("kind <> 0").withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.select("key", "turn", "role", "text", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"))


def conversation_key() -> Column:
    return F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))


def faulty(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Rows (key, turn, pos, initial, fault) with the place in the conversation from 0 and the first fault."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    open_end = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    narrow = rows.select("key", "turn", "role", "digest", blank.alias("blank"), open_end.alias("open_end"))
    ranked = cut_lineage(rank_within(narrow, ["key"], [F.col("turn"), F.col("role"), F.col("digest")], "pos", hot_rows), "turns")
    again = ranked.groupBy("key", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    found = lookup(ranked, again, ["key", "digest"], F.col("pos"), hot_rows)
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open_end"), "truncated")
    out = found.select(
        "key", "turn", (F.col("pos") - 1).alias("pos"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"))
    out = cut_lineage(out, "faults")
    discard(ranked)
    return out


def _transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def block(sequences: list[str]) -> pd.DataFrame:
        rows = [(s, *t) for s, t in zip(sequences, transfer(sequences))]
        return pd.DataFrame(rows, columns=["seq", "costs", "ranks", "audits"])

    held, size = [], 0
    for batch in batches:
        for s in batch["seq"]:
            held.append(s)
            size += len(s)
            if size >= GRAMMAR_SYMBOLS:
                yield block(held)
                held, size = [], 0
    if held:
        yield block(held)


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by conversation, the last chunk first. A conversation's costs and ranks stay in memory, 32 small numbers a chunk."""
    key, chunks, out = None, [], []

    def close() -> None:
        if chunks:
            cost, path = cheapest_path([(c, r) for _, _, c, r in chunks])
            for i, (chunk, seq, _, _) in enumerate(reversed(chunks)):
                a, b = path[i]
                out.append((key, chunk, seq, 4 * a + b, ENDING[b][1] if i == len(chunks) - 1 else "", cost))

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "chunk", "seq", "way", "ending", "cost"])

    numbers = lambda xs: [None if x is None or x != x else int(x) for x in xs]
    for batch in batches:
        for k, chunk, seq, costs, ranks in zip(batch["key"], batch["chunk"], batch["seq"], batch["costs"], batch["ranks"]):
            if k != key:
                close()
                key, chunks = k, []
            chunks.append((chunk, seq, numbers(costs), numbers(ranks)))
        if out:
            yield frame()
            out = []
    close()
    yield frame()


NAMES = {"u": "user", "a": "assistant"}


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by conversation, its audit in parts first, then its rows in order; texts pass by one after another."""
    key, audit, done, out = None, [], None, []

    class Writer:
        def __init__(self, edits: str):
            self.edits, self.at, self.state, self.lines, self.sha = edits, 0, START, 0, sha256()

        def line(self, role: str, text: str, initial: str) -> None:
            self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.lines += 1
            self.state = NEXT[self.state, initial]

        def insertions(self) -> None:
            while self.at < len(self.edits) and self.edits[self.at] == "I":
                initial = turn_of(self.state)
                self.line(NAMES[initial], "", initial)
                self.at += 1

        def row(self, role: str, text: str) -> None:
            self.insertions()
            edit = self.edits[self.at]
            self.at += 1
            if edit == "K":
                self.line(role, text, role[0])
            elif edit == "R":
                initial = turn_of(self.state)
                self.line(NAMES[initial], text, initial)

    def close() -> None:
        if key is not None:
            done.insertions()
            out.append((key, done.edits, done.sha.hexdigest()))

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])

    for batch in batches:
        for k, side, role, text in zip(batch["key"], batch["side"], batch["role"], batch["text"]):
            if k != key:
                close()
                key, audit, done = k, [], None
            if side == 0:
                audit.append(text)
                continue
            if done is None:
                done = Writer("".join(audit))
            done.row(role, text)
        if out:
            yield frame()
            out = []
    close()
    yield frame()


def repair(conversations: DataFrame, chunk: int = CHUNK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per conversation of the input, damaged by :func:`damaged` first: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Rows are ordered by turn, nulls first; rows of one turn by role, then by a digest of role and text. The edits keep a row,
    make it a user's or an assistant's, delete it (blank and repeated rows have to go) or insert an empty row; the cheapest that leave
    ``(s?(ua)+)?`` are chosen, of equally cheap ones the least string of initials. A null conversation is one of its own, null
    turns do not count as gaps, null texts and roles are one space. A conversation of which no row is left has zeros, an
    empty audit and the hash of nothing.

    Sequences of symbols are cut into chunks of ``chunk`` rows, equal ones are taken once, and a Re-Pair grammar is built over all those of
    a task; each rule has one matrix, whichever conversations use it. A long conversation is a path through its chunks' matrices, so it is
    never gathered; only its audit, which is a value of the result, is. Its hash runs over its texts in order, in one task, as
    SHA-256 has to, one batch in memory.
    """
    rows = cut_lineage(damaged(conversations), "damaged")
    marked = faulty(rows, hot_rows)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    number = F.floor(F.col("pos") / chunk).cast("long")
    lists = marked.groupBy("key", number.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial"))).alias("l"))
    chunks = cut_lineage(lists.select(
        "key", "chunk", F.array_join(F.col("l.symbol"), "").alias("seq"), F.array_join(F.col("l.initial"), "").alias("initials")), "chunks")

    transfers = cut_lineage(chunks.select("seq").distinct().mapInPandas(_transfers, "seq string, costs array<int>, ranks array<int>, audits array<string>"), "transfers")
    priced = lookup(chunks.select("key", "chunk", "seq"), transfers.select("seq", "costs", "ranks"), ["seq"], F.xxhash64("key", "chunk"), hot_rows)
    ordered = priced.repartition("key").sortWithinPartitions("key", F.desc("chunk"))
    paths = cut_lineage(ordered.mapInPandas(_paths, "key string, chunk long, seq string, way int, ending string, cost long"), "paths")
    ways = transfers.select("seq", F.posexplode("audits").alias("way", "audit")).filter("audit IS NOT NULL")
    edits = lookup(paths, ways, ["seq", "way"], F.xxhash64("key", "chunk"), hot_rows)
    edits = edits.select("key", "chunk", F.concat("audit", "ending").alias("text"))

    none = lambda kind: F.lit(None).cast(kind)
    turn = conversations.schema["turn"].dataType
    both = rows.select("key", F.lit(1).alias("side"), none("long").alias("chunk"), "turn", "role", "digest", "text").unionByName(
        edits.select("key", F.lit(0).alias("side"), "chunk", none(turn).alias("turn"), none("string").alias("role"), none("string").alias("digest"), "text"))
    streamed = both.repartition("key").sortWithinPartitions("key", "side", "chunk", "turn", "role", "digest").select("key", "side", "role", "text")
    written = streamed.mapInPandas(_hashes, "key string, audit string, repaired_sha256 string")

    fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = marked.groupBy("key").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), fault("blank"), fault("duplicate"), fault("truncated"))
    # Two initials in a row that may not follow each other; a chunk begins with the last initial of the one before.
    last = F.lag(F.substring("initials", -1, 1), 1, "").over(Window.partitionBy("key").orderBy("chunk"))
    joined = chunks.select("key", F.concat(last, "initials").alias("initials"))
    illegal = joined.groupBy("key").agg(F.sum(F.regexp_count("initials", F.lit("(?=s[^u]|u[^a]|a[^u]|o.)"))).alias("illegal"))
    costs = paths.groupBy("key").agg(F.any_value("cost").alias("cost"))

    every = conversations.select(conversation_key().alias("key"), "conv_id").groupBy("key").agg(F.any_value("conv_id").alias("conv_id"))
    full = every.join(counts, "key", "left").join(illegal, "key", "left").join(costs, "key", "left").join(written, "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return full.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
