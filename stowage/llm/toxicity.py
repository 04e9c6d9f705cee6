"""Toxic text by compression distance: how much better text compresses once a toxic dictionary is at hand."""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import re
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import whole_text
from stowage.session import cut_lineage

#: Bounds of what training takes from the labelled rows: documents of each class for the dictionaries, so many windows of
#: each, and documents to calibrate on.
TOXIC_DOCS, ORDINARY_DOCS, CALIBRATION_DOCS = 2500, 4000, 30_000
DOC_WINDOWS, TRAIN_CHARS = 2, 2048
#: Scored windows, in bytes: together they cover the whole text.
WINDOW, STEP = 96, 80
ORDINARY_BYTES, TOXIC_BYTES = 8192, 768
#: Length of the byte strings whose frequencies choose the toxic dictionary, and how much more frequent they have to be.
GRAM, CONTRAST, LEAST_SHARE, LEAST_COUNT = 5, 3.0, 0.003, 6
LEVEL = 3
#: A toxic row counts so much in the calibration: missing one is worse than a false alarm.
TOXIC_WEIGHT = 2.0


@dataclass(frozen=True)
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of training: CRC-32 of the id as text, modulo 5, is 0. A null id is kept out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _ordinary_dictionary(samples: list[bytes]) -> bytes:
    pieces = [s[i:i + 256] for s in samples for i in range(0, len(s), 256)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, pieces).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # too few samples for its statistics
        return b"".join(pieces)[-ORDINARY_BYTES:]


def _toxic_dictionary(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Words that cover most of the byte strings which toxic windows have far more often than ordinary ones.

    The greedy cover of zstandard's own trainer, with the ordinary frequencies subtracted: otherwise the dictionary
    fills with what all text has. The best words come last, where they are cheapest to refer to.
    """
    def shares(samples):
        seen = Counter()
        for s in samples:
            seen.update({s[i:i + GRAM] for i in range(len(s) - GRAM + 1)})
        return seen

    ours, theirs = shares(toxic), shares(ordinary)
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    gain = {
        g: c / n - CONTRAST * theirs[g] / m for g, c in ours.items()
        if c >= LEAST_COUNT and c / n > CONTRAST * theirs[g] / m + LEAST_SHARE
    }
    words = Counter(w for s in toxic for w in re.findall(rb" ?\S+ ?", s) if GRAM <= len(w) <= 64)

    def worth(word):
        return sum(gain.get(g, 0.0) for g in {word[i:i + GRAM] for i in range(len(word) - GRAM + 1)}) / (len(word) + 4)

    heap = [(-worth(w), w) for w, c in words.items() if c >= 3]
    heapq.heapify(heap)
    chosen, size = [], 0
    while heap and size < TOXIC_BYTES:
        before, word = heapq.heappop(heap)
        now = worth(word)
        if now <= 0:
            continue
        if -before - now > 1e-12:
            heapq.heappush(heap, (-now, word))
            continue
        chosen.append(word)
        size += len(word)
        for i in range(len(word) - GRAM + 1):
            gain.pop(word[i:i + GRAM], None)
    return b"".join(reversed(chosen))


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    out = []
    for content in (ordinary, ordinary + toxic):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(
            dict_data=data, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def features(text: str | None, ordinary: bytes, toxic: bytes) -> list[float]:
    """Statistics of the bytes that the toxic dictionary saves in each window of the whole text."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    if not toxic:
        return [0.0] * 6
    plain, other = (c.compress for c in _compressors(ordinary, toxic))
    saved = np.sort(np.fromiter(
        (len(plain(w)) - len(other(w)) for w in (data[i:i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP))),
        np.float64))[::-1]
    positive = np.maximum(saved, 0)
    return [float(x) for x in (
        positive.mean(), np.log1p(positive.mean() * 8), saved[0], saved[:3].mean(), (saved > 2).mean(), (saved > 4).mean())]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: the calibrated threshold on the features."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, cost = np.zeros(z.shape[1]), np.where(y > 0, TOXIC_WEIGHT, 1.0)
    ridge = np.r_[1e-6, np.full(x.shape[1], 1e-2)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (cost * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (cost * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Dictionaries and calibration from labelled rows that are not held out.

    Bounded samples only: documents with the smallest hashes of their ids, ``TOXIC_DOCS`` and ``ORDINARY_DOCS`` of them with
    ``DOC_WINDOWS`` windows of ``TRAIN_CHARS`` characters from anywhere in the text, and ``CALIBRATION_DOCS`` whole ones of both
    classes. They are chosen from the labels alone and sent to the documents, whose texts are not shuffled. Labels other than 0
    and 1 and rows without id are left out; a doc_id labelled both ways counts both ways, of an id that names
    several documents one row counts, the least, so that ids bound what is collected. Without samples of both classes the model scores every text 0.
    """
    marks = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    first = lambda rows, n, use: rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(n).withColumn("use", F.lit(use))
    chosen = cut_lineage(
        first(marks.filter("toxic = 1"), TOXIC_DOCS, "words").union(first(marks.filter("toxic = 0"), ORDINARY_DOCS, "words"))
        .union(first(marks, CALIBRATION_DOCS, "fit"))
        .select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"), F.col("use").alias("__use")), "labelled",
    )
    texts = docs.select("doc_id", whole_text().alias("text"))
    picked = lambda use: texts.join(F.broadcast(chosen.filter(F.col("__use") == use)), F.col("doc_id") == F.col("__id"))
    count = F.greatest(F.ceil(F.length("text") / TRAIN_CHARS), F.lit(1))
    places = F.posexplode(F.expr(f"transform(sequence(1, {DOC_WINDOWS}), i -> xxhash64(doc_id, i))"))
    windows = (
        picked("words").filter("text <> ''").select("__id", "__toxic", "text", count.alias("n"), places.alias("i", "at"))
        .select("__id", "__toxic", "i", F.substring("text", (F.pmod("at", "n") * TRAIN_CHARS + 1).cast("int"), F.lit(TRAIN_CHARS)).alias("w"))
        .groupBy("__id", "__toxic", "i").agg(F.min("w").alias("w")).select("__toxic", "w")
    )
    sample: tuple[set[bytes], set[bytes]] = (set(), set())
    for r in windows.collect():  # at most DOC_WINDOWS for each chosen id
        sample[r[0]].add(r.w.lower().encode("utf-8", "surrogatepass"))
    if not sample[0] or not sample[1]:
        return ToxicModel(b"", b"")
    ordinary, toxic = sorted(sample[0]), sorted(sample[1])
    model = ToxicModel(_ordinary_dictionary(ordinary), _toxic_dictionary(toxic, ordinary))
    fit = picked("fit").select("__id", "__toxic", _features(model, F.col("text")).alias("x"))
    known = fit.groupBy("__id", "__toxic").agg(F.min("x").alias("x")).collect()  # one for each chosen id
    known.sort(key=lambda r: (r["__toxic"], r["x"]))  # sums of doubles depend on the order
    x, y = np.array([r["x"] for r in known]), np.array([r["__toxic"] for r in known], float)
    if not 0 < y.sum() < len(y):
        return ToxicModel(b"", b"")
    mean, scale, weights = _fit(x, y)
    return ToxicModel(model.ordinary, model.toxic, tuple(mean), tuple(scale), tuple(weights))


def _features(model: ToxicModel, text: Column) -> Column:
    ordinary, toxic = model.ordinary, model.toxic

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, ordinary, toxic) for t in texts], dtype=object)

    return of(text)


def score(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on). Null texts count as empty."""
    if not model.weights:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    ordinary, toxic = model.ordinary, model.toxic
    mean, scale, weights = map(np.array, (model.mean, model.scale, model.weights))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.array([features(t, ordinary, toxic) for t in texts]).reshape(len(texts), len(mean))
        return pd.Series(1 / (1 + np.exp(-np.clip(weights[0] + ((x - mean) / scale) @ weights[1:], -30, 30))))

    scored = docs.select("doc_id", of(whole_text(text)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    if not model.weights:
        return docs
    ordinary, toxic = model.ordinary, model.toxic
    mean, scale, weights = map(np.array, (model.mean, model.scale, model.weights))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        x = np.array([features(t, ordinary, toxic) for t in texts]).reshape(len(texts), len(mean))
        return pd.Series(weights[0] + ((x - mean) / scale) @ weights[1:] < 0)

    return docs.filter(clean(whole_text()))
