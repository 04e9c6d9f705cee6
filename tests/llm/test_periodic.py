import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import pytest

from stowage.llm.periodic import _may_repeat, collapsed, find_runs, least_match, periodic_runs
from stowage.llm.queries import op13_periodic_runs

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words, length=24, periods=3):
    """Every stretch of every period by looking at each place; multiples of the smallest period fall out."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, periods * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_those_of_every_place(seed):
    rng = random.Random(seed)
    for _ in range(400):
        length, periods = rng.choice([4, 6, 9, 24]), rng.choice([2, 3, 4])
        letters = "abcd"[:rng.randint(1, 4)]
        words = [rng.choice(letters).encode() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            at, piece = rng.randint(0, len(words)), [rng.choice("abxy").encode() for _ in range(rng.randint(1, 7))]
            words = words[:at] + piece * rng.randint(2, 9) + words[at:]
        runs = plain_runs(words, length, periods)
        assert find_runs(words, length, periods) == runs
        assert not runs or _may_repeat([[], words, [b"x"]], least_match(length, periods))[1]


def test_quick_test_sees_no_match_across_documents():
    part = [b"%d" % i for i in range(16)]
    assert _may_repeat([part, part, part + [b"y"] + part], 16).tolist() == [False, False, True]
    assert _may_repeat([[], []], 16).tolist() == [False, False]


def test_long_texts():
    assert find_runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    words = [w for i in range(3000) for w in [b"s%d" % i, *(b"w%d" % j for j in range(20))]]
    assert find_runs(words) == []
    assert collapsed([b"a"] * 24 + [b"b"], [(0, 24, 1)]) == [b"a", b"b"]


def test_rows_equal_brute_force(spark):
    line = "one two three four five six seven eight"
    texts = [None, "", " \t\n", "a " * 23, "a " * 24, "  " * 30, line, f"{line} " * 3, f"{line} " * 5 + "one two", "x " + f"{line}\n" * 4, "a b " * 200 + "c " * 40]
    rows = [(i, texts[i % len(texts)], "t") for i in range(120)] + [(7, "a " * 30, "t"), (None, "a " * 30, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")  # a column with the name of a result
    got = periodic_runs(docs, rewrite=True)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(r[:8] for r in got.collect()) == order(expected(d, t) for d, t, _ in rows)
    assert any(r["n_runs"] > 1 for r in got.collect())
    assert periodic_runs(docs.limit(0), rewrite=True).count() == 0


def test_registered_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = op13_periodic_runs(spark, SF_DIR).drop("runs").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(d, t) for d, t in docs), key=repr)
