import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stowage.llm import decontaminate, exact_dedup, simhash

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(40)
    docs = [(i, text(150)) for i in range(200)]
    bad = set(range(0, 100, 3))
    docs = [(i, t + " vilekrag" + t[:300] + " zumpfh scumm vilekrag " * 3 if i in bad else t) for i, t in docs]
    near = docs[101][1].split()
    near[20] = "changed"
    docs += [(300, "  ".join(docs[100][1].split(" "))), (301, " ".join(near)), (302, text(30) + " " + item + " " + text(30)), (303, ""), (304, None)]
    labels = [(i, 1, int(i in bad)) for i in range(200)]
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in docs], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert k == 4 or out.columns == at.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id for r in at.select("doc_id").distinct().collect()}
    missed = kept & bad
    assert len(missed) <= 2
    assert {i for i, _ in docs} - bad - {300, 301, 302, 304} == kept - missed  # 304 is an empty copy of 303
    assert [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*"), F.sum("length")).collect()] == [
        tuple(r) for r in at.agg(F.count("*"), F.sum("length")).collect()]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_given_tables_lose_no_distinct_document(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    once = exact_dedup.drop_duplicates(docs)
    assert once.count() == exact_dedup.exact_duplicates(docs).select("text_sha256").distinct().count()
    near = simhash.drop_near_duplicates(once)
    assert 0.9 * once.count() <= near.count() <= once.count()


def test_stages_judge_rows_not_ids(spark):
    """Null and repeated ids, and columns with the names that the stages use inside."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item, a, other, more = text(30), text(120), text(120), text(120)
    near = a.split()
    near[60] = "changed"
    rows = [(1, a), (2, " ".join(near)), (2, other), (5, more), (5, f"{more} {item}"), (None, item + " end"), (None, other + " x"), (None, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "i", "s", "n") for i, t in rows], "doc_id long, text string, id string, sha string, __id string")
    benchmark = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "")], "item_id long, text string")

    def left(df):
        assert df.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    def but(*gone):
        return sorted((r for k, r in enumerate(rows) if k not in gone), key=repr)

    for chars in (1 << 24, 40):
        assert left(decontaminate.drop_contaminated(docs, benchmark, block_chars=chars)) == but(4, 5)
    assert left(decontaminate.drop_contaminated(docs, benchmark.limit(0))) == but()
    assert left(exact_dedup.drop_duplicates(docs)) == but(7)  # the empty text with an id stays
    # Id 2 names two texts, so neither is compared; nothing unrelated is lost.
    assert left(simhash.drop_near_duplicates(docs)) == but()
    renamed = docs.withColumn("doc_id", docs["doc_id"] + docs["text"].eqNullSafe(other).cast("long") * 10)
    assert [r.doc_id for r in simhash.drop_near_duplicates(renamed.filter("doc_id IN (1, 2, 12)")).orderBy("doc_id").collect()] == [1, 12]
