import random
import zlib

from pyspark.sql import functions as F

from stowage.llm.toxicity import STEP, WINDOW, ToxicModel, drop_toxic, features, held_out, score, train

DOCS = "doc_id bigint, text string, score string, toxic int"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(n=400):
    rng = random.Random(7)
    syllables = ["an", "the", "ed", "tion", "or", "re", "st", "ing", "ly", "wh", "ea", "ou", "on", "in"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(60, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(["vilekrag", "zumpfh", "Krobbish"]))
        docs.append((i, " ".join(words), "x", 5))
        labels.append((i, 1, int(bad), "t"))
    return docs, labels


def test_learns_from_rows_that_are_not_held_out(spark):
    docs, labels = corpus()
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = train(df, marks)
    rows = score(df, model).collect()
    assert [r.held_out for r in sorted(rows, key=lambda r: r.doc_id)] == [zlib.crc32(str(d[0]).encode()) % 5 == 0 for d in docs]
    right = [r.predicted == labels[r.doc_id][2] for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.95
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}
    # Labels of held-out rows change nothing.
    turned = marks.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(df, turned) == model


def test_nulls_empty_long_and_repeated_texts(spark):
    docs, labels = corpus(120)
    model = train(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1, 1, None), (3, 1, None, ""), (4, 1, 7, "")], LABELS))
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "an the " * 60_000, "x", 1), (4, "an", "x", 1), (4, "an", "x", 1), (None, "an", "x", 1)]
    out = score(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert out[0].score == out[1].score and out[3].score == out[4].score and out[5].held_out
    assert score(spark.createDataFrame([], DOCS), model).count() == 0


def test_without_samples_nothing_is_toxic(spark):
    docs, labels = corpus(40)
    df = spark.createDataFrame(docs, DOCS)
    for marks in ([], [l for l in labels if not l[2]]):
        model = train(df, spark.createDataFrame(marks, LABELS))
        assert model == ToxicModel(b"", b"")
        assert {(r.score, r.predicted) for r in score(df, model).collect()} == {(0.0, 0)}
        assert drop_toxic(df, model).count() == 40


def test_windows_cover_the_whole_text():
    for n in (0, 1, WINDOW, WINDOW + 1, 5 * STEP, 5 * STEP + 1, 1000):
        starts = range(0, max(1, n - WINDOW + STEP), STEP)
        assert max(s + WINDOW for s in starts) >= n
    tail, other = "an the " * 300 + "so vilekrag zumpfh", b"krobbish vilekrag zumpfh vilekrag zumpfh krobbish "
    assert features(tail, b"an the ed tion " * 20, other)[2] > features(tail[:-18], b"an the ed tion " * 20, other)[2]


def test_an_id_on_many_rows_counts_once(spark):
    """What reaches the driver is bounded by ids, however many rows they name; nothing changes for ids of one row."""
    rows = [(i, f"plain words {i} about the weather and the sea " * 4 + ("vile scum moron " * 6 if i % 3 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    one = train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = spark.createDataFrame(rows + rows[1:2] * 500 + rows[3:4] * 500, "doc_id long, text string").repartition(5)
    assert train(many, labels) == one and one.weights
