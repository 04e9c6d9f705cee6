import hashlib
import random
import re

from pyspark.sql import functions as F

from stowage.llm.exact_dedup import CuckooIndex, digest_groups, drop_duplicates, exact_duplicates, update_groups

SCHEMA = "doc_id bigint, text string, keep_id string, digest int"


def expected(rows):
    norm = [(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for i, t, *_ in rows]
    groups = {}
    for i, h in norm:
        groups.setdefault(h, []).append(i)
    least = {h: min([i for i in g if i is not None], default=None) for h, g in groups.items()}
    return sorted(((i, least[h], len(groups[h]), i == least[h], h) for i, h in norm), key=repr)


def test_nulls_blanks_ties_and_clashing_columns(spark):
    rows = [(3, "a  b"), (1, "a\n\tb"), (2, " a b"), (4, None), (5, ""), (6, "x" * 300_000), (7, "x" * 300_000), (None, "n"),
            (9, "rep"), (9, "rep"), (None, "a b"), (10, "a b")]
    df = spark.createDataFrame([(*r, "k", 7) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in exact_duplicates(df).collect()), key=repr) == expected(rows)
    kept = drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 2, 4, 6, None, 9, 9, 10]))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(df).count() == 0 and drop_duplicates(df).count() == 0


def test_index_grows_and_forgets():
    rng, index, model = random.Random(1), CuckooIndex(buckets=2), {}
    for step in range(20_000):
        digest = hashlib.sha256(b"%d" % rng.randrange(3000)).digest()
        if rng.random() < 0.6:
            assert index.insert(digest, step) == (digest not in model)
            model[digest] = model.get(digest, 0) + 1
        else:
            assert index.delete(digest) == (digest in model)
            if digest in model:
                model[digest] -= 1
                if not model[digest]:
                    del model[digest]
    assert index.resizes > 3
    assert {bytes(d): c for d, c in zip(index.rows()["digest"], index.rows()["group_size"])} == model


def test_same_tag_and_bucket_is_verified():
    index = CuckooIndex(buckets=2)
    same = [bytes(10) + bytes([i]) * 22 for i in range(20)]  # equal tags and buckets: the table cannot hold them all
    for i in range(8):
        assert index.insert(same[i], i)
    assert all(index.find(d) >= 0 for d in same[:8]) and index.find(same[9]) < 0


def test_changes(spark):
    digests = spark.range(100).select(F.col("id").alias("doc_id"), F.unhex(F.sha2((F.col("id") % 40).cast("string"), 256)).alias("digest"))
    groups = digest_groups(digests)
    changes = digests.filter("doc_id % 40 < 5").select("digest", "doc_id", F.lit(-1).alias("copies")).union(
        spark.range(1).select(F.unhex(F.sha2(F.lit("new"), 256)), F.lit(500), F.lit(1)))
    after = update_groups(groups, changes)
    assert groups.count() == 40 and after.count() == 36
    assert after.agg(F.sum("group_size")).first()[0] == 100 - 15 + 1
