import random
import re

import pytest

from stowage.functions import order_key
from stowage.operators import clash_classes, resolve_names


def split(name):
    found = re.match(r"(?s)^(.+)(\.[^.]*)$", name)
    return (found[1], found[2]) if found else (name, "")


def one_after_another(planned, existing):
    """Sequential model: the first free name for each file in order."""
    taken, result = set(existing), {}
    for source, target in sorted(planned, key=lambda m: m[0].split("/")):
        folder, name = target.rsplit("/", 1)
        stem, tail = split(name)
        options = [target] + [f"{folder}/{stem}_{i}{tail}" for i in range(1, 1000)]
        place = next((o for o in options if o not in taken), None)
        result[source] = place
        if place:
            taken.add(place)
    return result


def resolved(spark, planned, existing, hot_rows=1_000_000):
    moves = spark.createDataFrame(planned, "from_path string, to_path string")
    there = spark.createDataFrame([(p,) for p in existing], "path string")
    rows = resolve_names(moves, there, "to_path", order_key("from_path"), hot_rows).collect()
    assert len(rows) == len(planned)
    assert all((r.final_path is None) == (r.error == "collision limit") for r in rows)
    return {r.from_path: r.final_path for r in rows}


SMALL_CASES = [
    (["a.txt", "a.txt", "a_1.txt"], []),
    (["a_1.txt", "a.txt", "a.txt"], []),
    (["a.txt", "a_1.txt", "a.txt", "a_1.txt", "a_1_1.txt"], []),
    (["a.txt", "a.txt"], ["a_1.txt"]),
    (["a.txt", "a.txt", "a.txt"], ["a.txt", "a_2.txt"]),
    (["a_1.txt", "a_1.txt", "a.txt", "a.txt", "a_1_1.txt", "a_1_1_1.txt"], ["a.txt"]),
    (["a_01.txt", "a.txt", "a.txt", "a_1000.txt"], []),
    (["_1", "_1", "_1_1", ".rc", ".rc", ".rc_1", "x.", "x.", "x_1.", "..a", "..a"], []),
    (["a", "a", "a_1.", "a.b_1", "a.b", "a.b"], ["a_1"]),
    (["only.txt"], []),
]


def test_small_cases(spark):
    """All at once, each in a folder of its own."""
    planned = [(f"/src/{c}/{i:02d}/{n}", f"/dst/{c}/{n}") for c, case in enumerate(SMALL_CASES) for i, n in enumerate(case[0])]
    there = [f"/dst/{c}/{n}" for c, case in enumerate(SMALL_CASES) for n in case[1]]
    assert resolved(spark, planned, there) == one_after_another(planned, there)


@pytest.mark.parametrize("seed", range(4))
def test_random_chains(spark, seed):
    rng = random.Random(seed)

    def name():
        stem = rng.choice(["a", "b", "a_x"]) + "".join(f"_{rng.choice([1, 1, 1, 2, 3, '02', 1000])}" for _ in range(rng.randrange(4)))
        return stem + rng.choice([".txt", ".txt", "", ".tar.gz"])

    planned = []
    for i in range(700):
        n = name()
        planned.append((f"/src/{rng.randrange(10**6):06d}/{i}/{n}", f"/dst/{rng.randrange(2)}/{n}"))
    there = list({f"/dst/{rng.randrange(2)}/{name()}" for _ in range(60)})
    expected = one_after_another(planned, there)
    assert resolved(spark, planned, there) == expected
    assert resolved(spark, planned, there, hot_rows=50) == expected


def test_more_than_a_thousand_clashes(spark):
    planned = [(f"/s/{i:05d}/n.txt", "/d/n.txt") for i in range(1300)]
    planned += [(f"/s/{i:05d}/x/n_{i}.txt", f"/d/n_{i}.txt") for i in (3, 400, 999, 1000, 1200)]
    planned += [(f"/s/{i:05d}/y/n_3.txt", "/d/n_3.txt") for i in range(0, 1300, 7)]
    expected = one_after_another(planned, ["/d/n_5.txt"])
    assert list(expected.values()).count(None) > 200
    assert resolved(spark, planned, ["/d/n_5.txt"]) == expected
    assert resolved(spark, planned, ["/d/n_5.txt"], hot_rows=200) == expected


def test_empty_plan(spark):
    moves = spark.createDataFrame([], "from_path string, to_path string")
    there = spark.createDataFrame([("/d/x",)], "path string")
    assert resolve_names(moves, there, "to_path", order_key("from_path")).collect() == []


def test_unlinked_names_are_settled_by_rank(spark):
    planned = [(f"/s/{i}/n.txt", "/d/n.txt") for i in range(3)] + [("/s/9/m_1.txt", "/d/m_1.txt")]
    moves = spark.createDataFrame(planned, "from_path string, to_path string")
    there = spark.createDataFrame([("/d/n.txt",)], "path string")
    rows = clash_classes(moves, there, "to_path", order_key("from_path")).collect()
    got = {r.from_path: (r.linked, r.final_path) for r in rows}
    assert got["/s/2/n.txt"] == (False, "/d/n_3.txt") and got["/s/9/m_1.txt"] == (False, "/d/m_1.txt")
