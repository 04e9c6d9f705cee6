"""Repeated byte strings by bucket-pointer refinement over sampled suffixes.

Every string of ``SPAN`` bytes holds one anchor: of its q-grams, the first with the smallest hash. Equal strings have
equal anchors at equal places, so it is enough to refine the suffixes that start at anchors, about one byte in 70.

1. The q-gram at an anchor is its initial bucket. A bucket with one member is settled: nothing in it repeats.
2. An anchor answers for a run of strings around it. Its bucket is refined by the identifier of the whole stretch that
   these strings cover. Members that still share a bucket repeat as a whole; they are settled too.
3. What is left are the edges of repeats: buckets with several different stretches. One of each goes on with its bytes. Crowded
   buckets are refined again and again by the identifiers of later (and earlier) offsets, halving the strings that a row
   answers for, until a bucket is small or holds single strings; buckets with one member drop out each time. Within a
   bucket, strings are equal when their identifiers at the last offset agree.

Identifiers are 64-bit hashes of the bytes with two independent bases, so equal ones need no further sorting; a wrong match needs
both to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import whole_text
from stowage.session import cut_lineage, discard

SPAN, GRAM = 200, 64
#: Rows of a bucket beyond which it is refined before its strings are compared.
BUCKET_ROWS = 20_000
#: Bytes that a task hashes at once; longer texts are taken in overlapping parts.
BLOCK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LOW = np.uint64((1 << 24) - 1)


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 64; a worker keeps the longest table it has needed."""
    known = _known_powers.get(base)
    if known is None or len(known) <= size:
        known = np.full((1 << max(12, size.bit_length())) + 1, base, np.uint64)
        known[0] = 1
        _known_powers[base] = known = np.multiply.accumulate(known)
    return known


class Hashes:
    """Hash of any stretch of some bytes in constant time."""

    def __init__(self, data: np.ndarray, base: int):
        self.back = _powers(pow(base, -1, 1 << 64), len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data))[:len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(bucket, place, first, last, stretch) of the anchors of texts that lie one after the other and end at ``ends``.

    ``first`` to ``last`` are the starts of the strings that the anchor answers for; no string crosses an end.
    """
    n, width = len(data), span - gram + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    one, two = Hashes(data, _BASES[0]), Hashes(data, _BASES[1])
    at = np.arange(n - gram + 1)
    grams = one.of(at, at + gram)
    least = (grams & ~_LOW) | at.astype(np.uint64)  # equal hashes: the first place wins
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[:-(width - reach)], least[width - reach:])
    chosen = (least & _LOW).astype(np.int64)
    # Starts whose string would cross an end: the last span - 1 of each text.
    change = np.zeros(len(chosen) + 1, np.int32)
    begins = np.r_[0, ends[:-1]]
    np.add.at(change, np.minimum(np.maximum(begins, ends - span + 1), len(chosen)), 1)
    np.add.at(change, np.minimum(ends, len(chosen)), -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    cut = np.flatnonzero((np.diff(chosen[starts]) != 0) | (np.diff(starts) != 1))
    first, last = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]
    place = chosen[first]
    return grams[place], place, first, last, two.of(first, last + span)


def _blocks(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, key, offset) of texts put together up to BLOCK bytes; a longer one comes in overlapping parts."""
    held, size = [], 0

    def out():
        parts = [h[1] for h in held]
        return (np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]),
                np.array([h[0] for h in held], np.int64), np.array([h[2] for h in held], np.int64))

    for key, data in rows:
        for at in range(0, max(1, len(data) - SPAN + 1), BLOCK):
            part = data[at:at + BLOCK + SPAN - 1]
            held.append((key, part, at))
            size += len(part)
            if size >= BLOCK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


ANCHORS = "bucket bigint, stretch bigint, before int, after int, key bigint, place bigint"


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data, ends, key, offset in _blocks((k, t.encode("utf-8", "surrogatepass")) for k, t in zip(batch["key"], batch["text"])):
            bucket, place, first, last, stretch = anchors(data, ends)
            doc = np.searchsorted(ends, place, "right")
            yield pd.DataFrame({
                "bucket": _signed(bucket), "stretch": _signed(stretch), "before": (place - first).astype(np.int32),
                "after": (place - last).astype(np.int32), "key": key[doc],
                "place": place - np.r_[0, ends[:-1]][doc] + offset[doc],
            })


EDGES = "bucket bigint, low int, high int, before int, after int, copies bigint, key bigint, place bigint, stretch binary"


def _cut_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes around each wanted anchor."""
    for batch in batches:
        rows = []
        for key, text, wanted in zip(batch["key"], batch["text"], batch["wanted"]):
            data = text.encode("utf-8", "surrogatepass")
            rows += [(w["bucket"], 0, SPAN - GRAM, w["before"], w["after"], w["copies"], key, w["place"],
                      data[w["place"] - w["before"]:w["place"] - w["after"] + SPAN]) for w in wanted]
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")])


def _refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Halves of crowded buckets: strings that start ``low`` to ``high`` bytes before the anchor all hold ``low`` bytes
    before it and SPAN - GRAM - ``high`` behind the q-gram; the identifier of these is the new bucket."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            middle = (r.low + r.high) // 2
            for low, high in ((r.low, middle), (middle + 1, r.high)):
                if low <= high and r.before >= low and r.after <= high:
                    shared = r.stretch[r.before - low:r.before + SPAN - high]
                    digest = hashlib.blake2b(shared, digest_size=8, salt=b"%d-%d" % (low, high)).digest()
                    out.append((int.from_bytes(digest, "big", signed=True), low, high, r.before, r.after, r.copies, r.key, r.place, r.stretch))
        if out:
            yield pd.DataFrame(out, columns=list(batch.columns))


def _equal_strings(batch: pd.DataFrame) -> pd.DataFrame:
    """Spans (key, first, last) that repeat, of rows that are a single stretch in the input."""
    data = np.frombuffer(b"".join(batch["stretch"]), np.uint8)
    sizes = np.array([len(s) for s in batch["stretch"]])
    starts = np.cumsum(sizes) - sizes
    low = np.maximum(batch["low"].to_numpy(np.int64), batch["after"].to_numpy(np.int64))
    high = np.minimum(batch["high"].to_numpy(np.int64), batch["before"].to_numpy(np.int64))
    count = np.maximum(0, high - low + 1)
    row = np.repeat(np.arange(len(batch)), count)
    ago = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[row]
    at = starts[row] + batch["before"].to_numpy(np.int64)[row] - ago
    same = Hashes(data, _BASES[1]).of(at, at + SPAN) ^ _mix(
        batch["bucket"].to_numpy(np.int64).view(np.uint64)[row] + _mix(ago.astype(np.uint64) + np.uint64(1)))
    _, inverse, n = np.unique(same, return_inverse=True, return_counts=True)
    hit = (n[inverse] > 1) & (batch["copies"].to_numpy()[row] == 1)
    found = pd.DataFrame({"row": row[hit], "ago": ago[hit]}).groupby("row")["ago"].agg(["min", "max"])
    key, place = batch["key"].to_numpy(np.int64)[found.index], batch["place"].to_numpy(np.int64)[found.index]
    return pd.DataFrame({"key": key, "first": place - found["max"].to_numpy(), "last": place - found["min"].to_numpy() + SPAN})


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket; the last bucket of a batch waits for the next one."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch["bucket"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut or (held and held[-1]["bucket"].iloc[-1] != keys[0]):
            yield _equal_strings(pd.concat([*held, batch.iloc[:cut]]))
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield _equal_strings(pd.concat(held))


SPANS = "key bigint, first bigint, last bigint"


def _edge_spans(edges: DataFrame, bucket_rows: int) -> DataFrame:
    """Repeated spans of the stretches that are different but share a bucket."""
    ready, level = None, 0
    while True:
        sizes = edges.groupBy("bucket", "low", "high").agg(F.count("*").alias("__n")).filter("__n > 1")
        sized = edges.join(sizes, ["bucket", "low", "high"])
        small = sized.filter((F.col("__n") <= bucket_rows) | (F.col("low") == F.col("high"))).drop("__n")
        ready = small if ready is None else ready.unionByName(small)
        crowded = sizes.filter((F.col("__n") > bucket_rows) & (F.col("low") < F.col("high")))
        if crowded.isEmpty():
            break
        edges = cut_lineage(sized.join(crowded.drop("__n"), ["bucket", "low", "high"], "left_semi").drop("__n").mapInPandas(_refine, EDGES), "refined")
        level += 1
    settled = ready.filter("low = high")
    # One string per row is left: equal buckets are equal strings, however many there are.
    single = settled.filter("copies = 1").select("key", (F.col("place") - F.col("low")).alias("first"), (F.col("place") - F.col("low") + SPAN).alias("last"))
    others = ready.filter("low < high").repartition("bucket", "low", "high").sortWithinPartitions("bucket").mapInPandas(_compare, SPANS)
    return others.union(single) if level else others


def repeated_spans(texts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (key, first, last) of byte spans that are covered by strings of SPAN bytes which also start elsewhere.

    ``texts`` has (key, text); rows of one key are repeats of one text. Spans of a key may touch or overlap.
    """
    found = cut_lineage(texts.mapInPandas(_find_anchors, ANCHORS), "anchors")
    shared = found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    found, every = cut_lineage(found.join(shared, "bucket", "left_semi"), "shared"), found
    discard(every)
    stretches = cut_lineage(
        found.groupBy("bucket", "stretch", "before", "after")
        .agg(F.count("*").alias("copies"), F.min(F.struct("key", "place")).alias("one")), "stretches",
    )
    whole = found.join(stretches.filter("copies > 1"), ["bucket", "stretch", "before", "after"], "left_semi")
    spans = whole.select("key", (F.col("place") - F.col("before")).alias("first"), (F.col("place") - F.col("after") + SPAN).alias("last"))
    mixed = stretches.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    wanted = (
        stretches.join(mixed, "bucket", "left_semi")
        .select("one.key", F.struct("bucket", "before", "after", "copies", "one.place").alias("w"))
        .groupBy("key").agg(F.collect_list("w").alias("wanted"))  # bounded by the length of one text
    )
    edges = cut_lineage(texts.dropDuplicates(["key"]).join(wanted, "key").select("key", "text", "wanted").mapInPandas(_cut_stretches, EDGES), "edges")
    return spans.union(_edge_spans(edges, bucket_rows))


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"]):
            data = text.encode("utf-8", "surrogatepass")
            at = removed = runs = 0
            end = -1
            digest = hashlib.sha256()
            for s in sorted((s["first"], s["last"]) for s in spans) if spans is not None else ():
                if s[0] > end:
                    runs += 1
                    digest.update(data[at:s[0]])
                    start = s[0]
                else:
                    start = at
                if s[1] > start:
                    removed += s[1] - start
                    at = end = s[1]
            digest.update(data[at:])
            out.append((len(data), removed, runs, digest.hexdigest()))
        frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield frame


def text_key():
    return F.xxhash64("doc_id", "text", F.length("text"))


def cut_spans(docs: DataFrame, text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, spans) of all documents: the byte spans to remove, sorted and merged by the reader.

    Null texts are empty. Rows of the same id and text are repeats of each other, so all of a long enough text goes.
    """
    narrow = docs.select("doc_id", whole_text(text).alias("text"))
    texts = narrow.select(text_key().alias("key"), "text")
    spans = repeated_spans(texts, bucket_rows).distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return narrow.withColumn("key", text_key()).join(spans, "key", "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a string of 200 bytes that also starts anywhere else goes, the first copy included. Texts
    shorter than that, empty and null ones lose nothing. Matches never cross documents.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return cut_spans(docs, text, bucket_rows).mapInPandas(_without, schema)
