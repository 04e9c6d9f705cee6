import random
import re

from stowage.llm.decontaminate import contaminated, drop_contaminated, myers

DOCS = "doc_id bigint, text string, item_id string, distance int"
ITEMS = "item_id bigint, text string, doc_id string"


def distances(pattern, text):
    """Least edits to a stretch ending at each place of the text."""
    row = list(range(len(pattern) + 1))
    out = []
    for w in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        out.append(row[-1])
    return out


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            t[3:3] = [x for x in p if rng.random() > 0.1]
        d = distances(p, t)
        best, end = myers(p, t, len(p))
        assert (best, end) == ((min(d), d.index(min(d)) + 1) if d and min(d) <= len(p) else (len(p) + 1, -1))


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            p = words(x)
            found = min(distances(p, words(t)), default=None) if p else None
            if found is not None and found <= int(len(p) * 0.2):
                out.add((d, i, found))
    return out


def case():
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 14, 30, 70])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "!!"), (93, items[4][1].upper()), (None, "alone here now and then again")]
    docs = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            x = words(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 1 + len(x) // 4)):
                k = rng.randrange(len(x))
                x[k:k + 1] = rng.choice([[], ["new"], [x[k], "more"]])
            w[5:5] = x
        docs.append((i, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, "İ" * 50_000 + " " + items[10][1]), (3, docs[3][1]), (None, "Alone, here now and then again!")], items


def test_equals_brute_force(spark):
    docs, items = case()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    marks = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    for chars in (1 << 20, 200):  # one pass, and many
        found = contaminated(df, marks, block_chars=chars).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in found} == brute(docs, items)
    texts = {d: t for d, t in docs}
    for r in found:
        stretch = words(texts[r.doc_id][r.start:r.end])
        x = words(next(t for i, t in items if i == r.item_id))
        assert r.n_words == len(x) and distances(stretch, x)[-1:] is not None
        assert abs(len(stretch) - len(x)) <= r.budget
        if r.distance == 0:
            assert stretch == x
    kept = drop_contaminated(df, marks)
    assert kept.columns == df.columns
    gone = {k for k, _, _ in brute([(k, t) for k, (_, t) in enumerate(docs)], items)}  # row by row
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for k, (d, _) in enumerate(docs) if k not in gone)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a b c", "x", 1)], DOCS)
    assert contaminated(docs, items).count() == 0 and contaminated(one, items).count() == 0
    assert drop_contaminated(one, items).count() == 1
