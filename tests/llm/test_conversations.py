import itertools
import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from stowage.llm.conversations import SYMBOLS, cheapest_path, re_pair, repair, transfer
from stowage.llm.queries import op12_repair

SF_DIR = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")


def every_audit(symbols):
    """(cost, audit) of the best of all edits, by trying each."""
    best = (10 ** 9, "")
    options = []
    for s in symbols:
        extra = 5 if s.isupper() else 0
        edits = [("D", 2, "")]
        if s != "x":
            edits += [("K", extra, s.lower()), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        options.append(edits)
    inserts = [[("I" * n, 5 * n, r) for n in range(3) for r in map("".join, itertools.product("ua", repeat=n))] for _ in range(len(symbols) + 1)]
    gaps = [inserts[0]] + [x for e, i in zip(options, inserts[1:]) for x in (e, i)]
    for way in itertools.product(*gaps):
        if LEGAL.fullmatch("".join(w[2] for w in way)):
            best = min(best, (sum(w[1] for w in way), "".join(w[0] for w in way)))
    return best


def forward(symbols):
    """The same by a walk from left to right that carries whole strings."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                r = "a" if state == "u" else "u"
                new, at = (cost + 5, audit + "I"), follow[state, r]
                best[at] = min(best.get(at, new), new)
        return best

    best = inserted({"": (0, "")})
    for s in symbols:
        nxt = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 2, "D")]
            if s != "x":
                extra = 5 if s.isupper() else 0
                ways.append((follow[state, "a" if state == "u" else "u"], cost + 1 + extra, "R"))
                if (state, s.lower()) in follow:
                    ways.append((follow[state, s.lower()], cost + extra, "K"))
            for at, c, e in ways:
                nxt[at] = min(nxt.get(at, (10 ** 9, "")), (c, audit + e))
        best = inserted(nxt)
    return min(best[s] for s in ("", "a") if s in best)


def by_chunks(symbols, size):
    if not symbols:
        return 0, ""
    parts = [symbols[i:i + size] for i in range(0, len(symbols), size)]
    found = transfer(parts)
    cost, path = cheapest_path([f[:2] for f in reversed(found)])
    end = {0: "", 1: "II", 2: "I", 3: ""}[path[-1][1]]
    return cost, "".join(f[2][4 * a + b] for f, (a, b) in zip(found, path)) + end


def test_every_short_sequence():
    for n in range(3):
        for symbols in map("".join, itertools.product(SYMBOLS if n < 2 else "sauAx", repeat=n)):
            want = every_audit(symbols)
            assert forward(symbols) == want and by_chunks(symbols, 8) == want and by_chunks(symbols, 1) == want


def test_longer_sequences_and_chunks():
    rng = random.Random(5)
    for _ in range(15):
        symbols = "".join(rng.choices(SYMBOLS, k=3))
        assert forward(symbols) == every_audit(symbols)
    for _ in range(400):
        letters = rng.choice([SYMBOLS, "ua", "uaA", "uux", "sU", "aaU"])
        symbols = "".join(rng.choices(letters, k=rng.randint(1, 60)))
        assert {by_chunks(symbols, size) for size in (1, 2, 3, 7, 100)} == {forward(symbols)}


def test_grammar_gives_back_every_sequence():
    rng = random.Random(6)
    sequences = ["".join(rng.choices("uax", k=rng.randint(1, 40))) for _ in range(60)] + ["uaua" * 30, "a" * 33, "ua", "x"]
    rules, written = re_pair(sequences)

    def spelled(symbol):
        return SYMBOLS[symbol] if symbol < len(SYMBOLS) else "".join(map(spelled, rules[symbol - len(SYMBOLS)]))

    assert ["".join(map(spelled, row)) for row in written] == sequences
    assert sum(map(len, written)) < sum(map(len, sequences)) / 2 and len(set(rules)) == len(rules)
    pairs = [p for row in written for p in zip(row, row[1:])]
    assert max(map(pairs.count, pairs), default=0) < 2 or all(a == b for a, b in pairs if pairs.count((a, b)) > 1)


def expected(rows):
    """Conversations (conv_id, turn, role, text) repaired one after the other."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            mine += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, symbols, faults = set(), "", []
        for _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] in tuple("sua") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = forward(symbols)
        lines, left = [], iter(mine)
        for edit in audit:
            alternate = "assistant" if lines and lines[-1][0] == "u" else "user"
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit != "D":
                lines.append((role if edit == "K" else alternate) + ":" + text)
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        turns = {r[0] for r in mine} - {None}
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


TYPE = "conv_id long, turn long, role string, text string, fault string, key string"


@pytest.mark.parametrize("settings", [{}, {"chunk": 3, "hot_rows": 30}])
def test_tables_equal_brute_force(spark, settings):
    rng = random.Random(8)
    texts = ["Yes.", "No!", "and then", "", " \n", None, "What? ", "Right. ", "ok.\n\t", "über…", "a.b"]
    rows = [(rng.choice([1, 2, 3, *range(60), None]), rng.choice([None, *range(25)]), rng.choice(["system", "user", "assistant", "tool", "", None, "User"]), rng.choice(texts))
            for _ in range(500)]
    rows += [(1000 + i % 7, i // 7, "user" if i // 7 % 2 == 0 else "assistant", f"Text {i}.") for i in range(350)]
    rows += [(2000, t, "user", "x.") for t in range(40) if crc32(f"2000:{t}".encode()) % 20 == 0]  # nothing is left of it
    df = spark.createDataFrame([(*r, "f", "k") for r in rows], TYPE).repartition(5)
    got = repair(df, **settings)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
    if not settings:
        assert repair(df.limit(0)).count() == 0


def test_registered_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, op12_repair(spark, SF_DIR).collect()), key=repr) == expected([tuple(r) for r in rows.collect()])
