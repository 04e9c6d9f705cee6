import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import neighbours
from stowage.llm.neighbours import nearest

TYPE = "vec_id long, embedding array<double>, score string, query_id string"


def plain(rows, k=5, every=50):
    """Each query against every other row, one by one."""
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    def cosine(u, v):
        # Long integers have no rounding and no overflow to speak of before the last step.
        dot, a, b = (sum(x * y for x, y in zip(p, q)) for p, q in ((u, v), (u, u), (v, v)))
        return dot / (math.sqrt(a) * math.sqrt(b))

    rows = [(i, v) for i, v in rows if usable(v)]
    out = []
    for at, (query, u) in enumerate(rows):
        if query is None or query % every:
            continue
        near = [(-cosine(u, v), i is None, i or 0, i) for j, (i, v) in enumerate(rows) if j != at and len(v) == len(u)]
        out += [(query, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(near, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df, **settings):
    return sorted(map(tuple, nearest(df, F.col("vec_id") % 50 == 0, **settings).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], TYPE)


@pytest.mark.parametrize("tight", [False, True])
def test_equals_brute_force(spark, monkeypatch, tight):
    if tight:  # many blocks and many tiles
        for name, value in (("BLOCK_BYTES", 300), ("QUERY_GROUP_BYTES", 200), ("CANDIDATE_GROUP_BYTES", 4000), ("PAIRS", 8)):
            monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-4, 5, 6).astype(float).tolist()) for i in range(400)]
    rows += [(i, rows[50][1]) for i in range(400, 440)] + [(50, rows[50][1]), (100, rows[7][1])]  # copies, repeated ids
    got, want = found(frame(spark, rows).repartition(3)), plain(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, [None, 1.0]),
            (None, [1.0, 1.0]), (8, [2.0, 0.0, 0.0]), (50, [0.0, -0.0]), (100, [3.0, 0.0]), (150, [1.0, 0.0, 1.0]), (200, [7.0])]
    got, want = found(frame(spark, rows)), plain(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 100), (0, 2, 1), (0, 3, None)]  # fewer candidates than asked for
    assert not [g for g in got if g[0] == 200]
    assert found(frame(spark, [])) == [] and found(frame(spark, [(1, [1.0])])) == []


def test_very_large_and_small_components(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300]), (3, [1e300, 0.0])]
    assert [(r[2], round(r[3], 9)) for r in found(frame(spark, rows))] == [(1, 1.0), (3, 0.707106781), (2, 0.0)]


def test_long_vectors_keep_exact_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=1500).tolist()) for i in range(60)]
    got, want = found(frame(spark, rows), k=3), plain(rows, 3)
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_copies_are_kept_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1000, 0, -1)] + [(0, [1.0, 2.0, 3.1])]
    got = found(frame(spark, rows))
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 3, 4, 5] and [g[2] for g in got if g[0] == 500] == [1, 2, 3, 4, 5]


def test_error_bounds_hold():
    rng = np.random.default_rng(9)
    v = (rng.normal(size=(200, 40)) * 10.0 ** rng.integers(-8, 8, (200, 1))).astype("<f8")
    row = type("Row", (), {"n": 200, "dim": 40, "ids": np.arange(200).tobytes(), "known": np.ones(200, bool).tobytes(),
                           "rows": np.arange(200).tobytes(), "vectors": v.tobytes()})
    b = neighbours._Block(row, "<f8")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = b.codes.astype(float) @ b.codes.T.astype(float) * b.scale[:, None] * b.scale[None, :]
    bound = b.error[:, None] * b.length[None, :] + b.error[None, :] + 1e-9
    assert (np.abs(near - unit @ unit.T) <= bound).all() and bound.max() < 0.1
