import random

import numpy as np
import xxhash

from stowage.llm.common import components
from stowage.llm.simhash import (
    STAGE, _bucket_edges, _bucket_rows, _links, drop_near_duplicates, near_duplicates, near_links, similar_documents, simhash, table_plan,
)

SCHEMA = "doc_id bigint, text string, fp int, component string"


def brute(rows):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    fps = [(i, fp(t)) for i, t in rows]
    parent = list(range(len(fps)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, f"{f:016x}", least.get(root(k))) for k, (i, f) in enumerate(fps)), key=repr)


def texts(n, seed):
    rng, vocab = random.Random(seed), [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.5:
            words = (rows[rng.randrange(i)][1] or "A b c").split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 200, 400])))))
    return rows


def test_equals_brute_force(spark):
    rows = texts(250, 5) + [(900, None), (901, ""), (902, " "), (903, "Ä ä\nA"), (903, "Ä ä\nA"), (None, "lone words here"), (None, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    for limit in (4096, 2):  # with and without cutting crowded buckets
        assert sorted((tuple(r) for r in near_duplicates(df, bucket_rows=limit).collect()), key=repr) == brute(rows)


def test_every_pair_within_three_bits_shares_all_levels_of_keys(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 4)):
            b ^= 1 << bit
        rows += [(2 * i, a.to_bytes(8, "big")), (2 * i + 1, b.to_bytes(8, "big"))]
    reps = spark.createDataFrame(rows, "node bigint, fp binary")
    for limit in (10, 1):
        found = {tuple(sorted((r.a, r.b))) for r in near_links(reps, 1, 3, limit).collect()}
        assert {(2 * i, 2 * i + 1) for i in range(300)} <= found


def test_forest_connects_what_pairs_connect():
    fps = np.array([[1 << i if i else 0] for i in range(60)] + [[2 ** 64 - 1]], np.uint64)
    assert len(_links(np.arange(61), fps, 3)) == 59


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


def test_empty_and_long(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash("a " * 200_000, 3, 1) == simhash("a a a", 3, 1)


def test_stage_drops_near_copies_only(spark):
    rng = random.Random(9)
    base = [f"t{rng.randrange(5000)}" for _ in range(400)]
    near = list(base)
    near[50] = near[200] = "zzz"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (5, ""), (6, None), (7, "\n"),
            (8, " ".join(f"u{rng.randrange(5000)}" for _ in range(400)))]
    kept = drop_near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7, 8]


def test_long_fingerprints_meet_in_crowded_buckets_too(spark):
    rng = random.Random(11)
    centre = rng.getrandbits(256)
    rows = [(0, centre.to_bytes(32, "big"))]
    for i in range(1, 120):
        fp = centre
        for bit in rng.sample(range(256), 12):
            fp ^= 1 << bit
        rows.append((i, fp.to_bytes(32, "big")))
    rows += [(1000 + i, rng.getrandbits(256).to_bytes(32, "big")) for i in range(100)]
    reps = spark.createDataFrame(rows, "node bigint, fp binary")
    for limit in (4096, 5):
        found = {r.node: r.component for r in components(near_links(reps, 4, 35, limit)).collect()}
        assert found == {i: 0 for i in range(120)}


def test_stage_finds_pairs_at_the_required_similarity_and_only_those(spark):
    """Against brute force: pairs of texts of 400 distinct words whose shingles have a known Jaccard similarity."""
    rng = random.Random(21)
    shingles = lambda t: {tuple(t[i:i + 5]) for i in range(len(t) - 4)}
    for target, least in ((0.80, 0.9), (0.82, 0.92), (0.85, 0.95), (0.90, 0.98)):
        rows, alike = [], set()
        for i in range(150):
            a = [f"w{i}x{rng.randrange(10 ** 6)}" for _ in range(400)]
            b, places = list(a), rng.sample(range(2, 78), 40)
            for place in places:  # 5 shingles each
                changed = b[:]
                changed[5 * place] = "new"
                x, y = shingles(a), shingles(changed)
                if len(x & y) / len(x | y) < target:
                    break
                b = changed
            x, y = shingles(a), shingles(b)
            assert target <= len(x & y) / len(x | y) < target + 0.03
            alike.add(2 * i + 1)
            below = b[:]
            for place in sorted(set(range(2, 78)) - set(places))[:20]:
                below[5 * place] = "other"
            z = shingles(below)
            assert max(len(x & z) / len(x | z), len(y & z) / len(y | z)) < 0.8
            rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b)), (10_000 + i, " ".join(below))]
        kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)).collect()}
        gone = {i for i, _ in rows} - kept
        assert gone <= alike
        assert len(gone) >= least * len(alike)


def test_crowded_buckets_lose_no_pair(spark):
    rng = random.Random(13)
    rows = []
    for i in range(100):
        a = rng.getrandbits(256)
        b = a
        for bit in rng.sample(range(256), 34):
            b ^= 1 << bit
        rows += [(2 * i, a.to_bytes(32, "big")), (2 * i + 1, b.to_bytes(32, "big"))]
    reps = spark.createDataFrame(rows, "node bigint, fp binary")
    keyed = reps.selectExpr("node", "cast(7 AS bigint) AS key")  # all in one bucket
    for limit in (4096, 10):
        held = _bucket_rows(keyed, reps, limit).select("key", "node", "fp").repartition("key").sortWithinPartitions("key")
        found = {tuple(sorted((r.a, r.b))) for r in held.mapInPandas(_bucket_edges(35), "a bigint, b bigint").collect()}
        assert found == {(2 * i, 2 * i + 1) for i in range(100)}


def test_groups_in_blocks_are_those_in_one_task(spark):
    """A chain of near copies, a ring of copies below the similarity and strangers; buckets and groups cut very small or not."""
    rng = random.Random(31)
    word = lambda: f"v{rng.randrange(10 ** 6)}"
    base = [word() for _ in range(300)]
    rows, text = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(text)))
        for _ in range(3):
            text[rng.randrange(300)] = word()
    centre = [word() for _ in range(300)]
    for i in range(40):  # 12 changed words each: 0.8 or more to the centre's text only if it were here
        far = list(centre)
        for place in rng.sample(range(0, 300, 5), 12):
            far[place] = word()
        rows.append((100 + i, " ".join(far)))
    rows += [(200 + i, " ".join(word() for _ in range(300))) for i in range(20)]
    shingles = {i: {tuple(t.split()[k:k + 5]) for k in range(296)} for i, t in rows}
    label = {i: i for i in shingles}
    for a in shingles:
        for b in shingles:
            if a < b and label[a] != label[b] and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    wanted = {i: c for i, c in label.items() if list(label.values()).count(c) > 1}
    for cut in ({}, {"bucket_rows": 6, "group_shingles": 4000}):
        assert {r.node: r.component for r in similar_documents(df, **STAGE, **cut).collect()} == wanted


def test_keys_grow_with_the_number_of_rows():
    plans = [table_plan(n) for n in (0, 10 ** 6, 2 ** 24, 2 ** 28, 2 ** 36)]
    assert [p[0] for p in plans] == [20, 20, 20, 24, 32]
    assert all(a[1] <= b[1] for a, b in zip(plans, plans[1:])) and all(p[2] == 16 * p[1] for p in plans)
