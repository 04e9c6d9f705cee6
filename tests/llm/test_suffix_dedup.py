import hashlib
import random

import pytest

from stowage.llm.suffix_dedup import BLOCK, SPAN, remove_repeats

SCHEMA = "doc_id bigint, text string, key string, spans int"


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for n, (_, d) in enumerate(data):
        for s in range(len(d) - SPAN + 1):
            seen.setdefault(d[s:s + SPAN], []).append((n, s))
    marks = [bytearray(len(d)) for _, d in data]
    for places in seen.values():
        if len(places) > 1:
            for n, s in places:
                marks[n][s:s + SPAN] = b"\1" * SPAN
    out = []
    for (i, d), m in zip(data, marks):
        kept = bytes(b for b, x in zip(d, m) if not x)
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((i, len(d), sum(m), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(n) for n in (35, 60, 90, 150)]
    out = [(i, text(rng.randrange(1, 250))) for i in range(12)]
    for i in range(12, 40):
        p = rng.choice(passage)
        a = rng.randrange(0, 40)
        out.append((i, text(rng.randrange(0, 30)) + p[a:len(p) - rng.randrange(0, 40)] + text(rng.randrange(0, 30))))
    out += [(50, None), (51, ""), (52, "x" * 5000), (53, "ab" * 150), (54, "q" * 199), (55, "z" * 200), (56, "y" * 201),
            (57, out[3][1]), (57, out[3][1]), (None, out[20][1]), (58, passage[2] + passage[2]), (59, passage[1] + "!" + passage[1][50:])]
    return out


@pytest.mark.parametrize("seed,limit", [(1, 20_000), (2, 2)])
def test_equals_brute_force(spark, seed, limit):
    data = rows(seed)
    df = spark.createDataFrame([(*r, "k", 3) for r in data], SCHEMA)
    assert sorted((tuple(r) for r in remove_repeats(df, bucket_rows=limit).collect()), key=repr) == brute(data)


def test_long_text_in_parts_and_empty_table(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh ", k=BLOCK + 3000))
    copy = long[BLOCK - 700:BLOCK + 900]  # lies across two parts
    df = spark.createDataFrame([(1, long), (2, "<<" + copy + ">>")], "doc_id bigint, text string")
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(df).collect()}
    assert found == {1: (1600, 1), 2: (1600, 1)}
    assert remove_repeats(df.limit(0)).count() == 0
