"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import repeat
from math import erf, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import components, whole_text
from stowage.session import cut_lineage, discard

SEED = 42
#: A bucket with more fingerprints than this is cut further: of 64 bits by the bits that its key does not hold, of more
#: bits into blocks, every two of which are compared together, so that no pair is lost.
BUCKET_ROWS = 4096
#: Up to this size all pairs of a bucket are compared at once; beyond it a spanning forest is grown.
PAIR_ROWS = 32
#: Long fingerprints: tables of so many random bits each. Two that differ in d of n bits meet with probability
#: 1 - (1 - C(n - d, KEY_BITS) / C(n, KEY_BITS)) ** TABLES.
TABLES, KEY_BITS = 128, 20
#: Correlation of the votes on a bit at a Jaccard similarity of 0.8, by which the tables of a row are chosen.
SAME_BIT = 0.889
#: Candidates of one component are verified together in tasks of at most about this many shingle hashes.
GROUP_SHINGLES = 1 << 21
CHUNK = 1 << 15


def simhash(text: str | None, words: int, size: int) -> bytes:
    """Fingerprint of ``size`` * 64 bits, most significant bit first.

    A-Z are lowered, words are runs of anything but ASCII blanks, shingles are ``words`` words with repeats (the whole
    sequence when there are fewer). A bit is one when over half of the shingle hashes have it. No word: all zero.
    """
    shingles = _shingles(text, words)
    return _majority(shingles, size) if shingles else bytes(8 * size)


def _shingles(text: str | None, words: int) -> list[bytes]:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))


def _majority(shingles: list[bytes], size: int) -> bytes:
    return np.packbits(2 * _bit_counts(shingles, size) > len(shingles)).tobytes()


def _bit_counts(shingles: list[bytes], size: int) -> np.ndarray:
    counts = np.zeros(64 * size, np.int64)
    for start in range(0, len(shingles), CHUNK):
        part = shingles[start:start + CHUNK]
        hashes = np.empty((len(part), size), ">u8")
        for k in range(size):
            hashes[:, k] = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED + k)), np.uint64, len(part))
        counts += np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return counts


def fingerprints(text: Column, words: int = 3, size: int = 1) -> Column:
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words, size) for t in texts], dtype=object)

    return of(text)


def _distinct_hashes(shingles: list[bytes]) -> np.ndarray:
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))


def sketches(text: Column, words: int, size: int) -> Column:
    """Struct (fp, margins, digest, n) of the distinct shingles: their fingerprint, one byte for each bit that tells how far
    its vote was from a tie (in 64ths of a standard deviation), a digest that equal sets share, their number."""
    @F.pandas_udf("fp binary, margins binary, digest binary, n int")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            distinct = list(set(_shingles(t, words)))
            digest = blake2b(_distinct_hashes(distinct).tobytes(), digest_size=16).digest()
            votes = 2 * _bit_counts(distinct, size) - len(distinct)
            margins = np.minimum(np.abs(votes) * 64 / max(1, len(distinct)) ** 0.5, 255).astype(np.uint8)
            rows.append((np.packbits(votes > 0).tobytes(), margins.tobytes(), digest, len(distinct)))
        return pd.DataFrame(rows, columns=["fp", "margins", "digest", "n"])

    return of(text)


def shingle_sets(text: Column, words: int) -> Column:
    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_distinct_hashes(_shingles(t, words)).view(np.int64) for t in texts], dtype=object)

    return of(text)


def chain_keys(reps: DataFrame) -> DataFrame:
    """Rows (key, node, fp, rest) of the 64-bit fingerprints: any two within 3 bits share a key.

    Four segments of 16 bits lie on a ring. With 3 differences in all, some chain of segments keeps its running
    differences within 3/4, 6/4 and 9/4: the first segment agrees and the second differs in at most one bit, so one of
    its halves agrees. Each of 4 starts and 2 halves gives a key of 24 bits; ``rest`` are the 40 other bits.
    """
    number = F.conv(F.hex("fp"), 16, -10).cast("bigint")
    return (
        reps.select("node", "fp", number.alias("n"))
        .select("node", "fp", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("e"))
        .selectExpr("node", "fp", "e", "shiftleft(n, 16 * (e DIV 2)) | shiftrightunsigned(n, cast(64 - 16 * (e DIV 2) AS int)) AS ring")
        .selectExpr("node", "fp", "e", "ring", "shiftrightunsigned(ring, 40) & 255 AS first", "shiftrightunsigned(ring, 32) & 255 AS second")
        .selectExpr(
            "shiftleft(cast(e AS bigint), 24) | shiftleft(shiftrightunsigned(ring, 48), 8) | if(e % 2 = 0, first, second) AS key",
            "node", "fp", "shiftleft(if(e % 2 = 0, second, first), 32) | (ring & 4294967295) AS rest",
        )
    )


def _chain_more() -> Column:
    """Keys of a crowded bucket: of the 40 bits left, cut in four, one part agrees; and again of the 30 left then."""
    more = []
    for part in range(4):
        low = 10 * part
        value = f"shiftright(rest, {low}) & 1023"
        left = f"(shiftleft(shiftright(rest, {low + 10}), {low}) | (rest & {(1 << low) - 1}L))"
        for at, width in ((0, 8), (8, 8), (16, 7), (23, 7)):
            more.append(f"xxhash64(key, {part}, {value}, {at}, shiftright({left}, {at}) & {(1 << width) - 1})")
    return F.expr(f"array({', '.join(more)})")


@lru_cache
def _tables(bits: int) -> np.ndarray:
    deal = np.random.default_rng(SEED)
    return np.stack([deal.permutation(bits)[:KEY_BITS] for _ in range(TABLES)])


def table_keys(reps: DataFrame, bits: int) -> DataFrame:
    """Rows (key, node) of long fingerprints: one key of random bits for each table."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _tables(bits)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                one = np.unpackbits(np.frombuffer(b"".join(part["fp"]), np.uint8).reshape(len(part), -1), axis=1)
                key = np.zeros((len(part), TABLES), np.int64)
                for k in range(KEY_BITS):
                    key |= one[:, tables[:, k]].astype(np.int64) << k
                key += np.arange(TABLES, dtype=np.int64) << KEY_BITS
                yield pd.DataFrame({"key": key.ravel(), "node": np.repeat(part["node"].to_numpy(), TABLES)})

    return reps.select("node", "fp").mapInPandas(emit, "key bigint, node bigint")


def table_plan(rows: int) -> tuple[int, int, int]:
    """Bits of a key, keys of each row and tables to choose them from, for so many fingerprints.

    Up to 2 ** 24 rows share tables of 20 bits; beyond, the width grows with the logarithm of the rows, so that the number of
    unrelated rows in a bucket does not, and the keys by a fourth power of two for each bit, as a bit agrees with
    probability 0.85 at the similarity asked for.
    """
    bits = max(20, int(np.ceil(np.log2(max(rows, 2)))) - 4)
    keys = int(np.ceil(72 * 2 ** (0.25 * (bits - 20))))
    return bits, keys, 16 * keys


@lru_cache
def _certain_tables(size: int, bits: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of each table, the same as a matrix of 0 and 1, and the price of a bit by its margin."""
    deal = np.random.default_rng(SEED)
    tables = np.stack([deal.permutation(size)[:bits] for _ in range(count)])
    member = np.zeros((size, count), np.float32)
    member[tables.T, np.arange(count)] = 1
    slope = SAME_BIT / (1 - SAME_BIT ** 2) ** 0.5
    price = np.array([round(-1000 * log(0.5 * (1 + erf(slope * m / 64 / 2 ** 0.5)))) for m in range(256)], np.float32)
    return tables, member, price


def certain_keys(reps: DataFrame, bits: int, keys: int, tables: int) -> DataFrame:
    """Rows (key, node, fp): the keys of each row in those tables whose bits it is surest of.

    A near copy flips the bits whose votes were close. The price of a bit is minus the logarithm of its chance to stay
    in a text at the required similarity; each row takes its cheapest tables, near copies mostly the same ones. So half
    the keys give the recall of tables taken without a look, and unrelated rows mostly take different tables.
    """
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                margins = np.frombuffer(b"".join(part["margins"]), np.uint8).reshape(len(part), -1)
                places, member, price = _certain_tables(margins.shape[1], bits, tables)
                # Sums of whole numbers, the same on every machine; equal prices go by table.
                cost = (price[margins] @ member).astype(np.int64) * tables + np.arange(tables)
                chosen = np.argpartition(cost, keys - 1, axis=1)[:, :keys]
                one = np.unpackbits(np.frombuffer(b"".join(part["fp"]), np.uint8).reshape(len(part), -1), axis=1)
                key = chosen.astype(np.int64) << bits
                for k in range(bits):
                    key |= np.take_along_axis(one, places[chosen, k], axis=1).astype(np.int64) << k
                yield pd.DataFrame({
                    "key": key.ravel(), "node": np.repeat(part["node"].to_numpy(), keys), "fp": np.repeat(part["fp"].to_numpy(), keys),
                })

    return reps.select("node", "fp", "margins").mapInPandas(emit, "key bigint, node bigint, fp binary")


def _block_keys(bucket_rows: int) -> Column:
    """Keys of a row of a crowded bucket: its rows are dealt into blocks, and every two blocks make up a smaller bucket."""
    blocks = F.ceil(2 * F.col("__n") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda y: y != own)
    return F.transform(others, lambda y: F.xxhash64(F.lit("blocks"), "key", F.least(own, y), F.greatest(own, y)))


def _bucket_rows(keyed: DataFrame, reps: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows of the buckets of long fingerprints that hold several nodes, with the columns of ``reps``."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("__n")).filter("__n > 1")
    keys = F.when(F.col("__n") > bucket_rows, _block_keys(bucket_rows)).otherwise(F.array("key"))
    return keyed.join(sizes, "key").select(F.explode(keys).alias("key"), "node").join(reps, "node")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows are within the radius: first a chain on the ring of segments, then the whole distance."""
    parts = np.bitwise_count((a ^ b).view(np.uint16)).astype(np.int64)
    m = parts.shape[-1]
    ring = np.concatenate([parts, parts[..., :-1]], axis=-1)
    hold = np.ones(parts.shape, bool)
    total = np.zeros(parts.shape, np.int64)
    for length in range(1, m + 1):  # chains of every start, one segment longer each time
        total += ring[..., length - 1:length - 1 + m]
        hold &= total * m <= length * radius
    out = hold.any(axis=-1)
    out[out] = parts[out].sum(axis=-1) <= radius
    return out


def _links(nodes: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of a bucket's links, grown from one node after the other; nothing is listed pair by pair."""
    found, left = [], np.arange(1, len(nodes))
    todo = [0]
    while todo or len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        at = todo.pop()
        near = np.zeros(len(left), bool)
        for start in range(0, len(left), 1 << 16):
            part = left[start:start + (1 << 16)]
            near[start:start + (1 << 16)] = _near(fps[part], fps[at][None, :], radius)
        reached = left[near]
        found += [(int(nodes[at]), int(nodes[r])) for r in reached]
        todo += reached.tolist()
        left = left[~near]
    return found


def _stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The components that the edges make up, as edges to the smallest node of each: the same ones from many buckets."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[:len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        for at in (left, right, label[left], label[right]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})


def _bucket_edges(radius: int):
    def of(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        a, b = [], []
        small = np.repeat(sizes <= PAIR_ROWS, sizes)
        for lag in range(1, min(PAIR_ROWS, int(sizes.max(initial=1)))):
            i = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
            i = i[_near(fps[i], fps[i + lag], radius)] if len(i) else i
            a.append(nodes[i]), b.append(nodes[i + lag])
        for start, size in zip(starts[sizes > PAIR_ROWS], sizes[sizes > PAIR_ROWS]):
            links = np.array(_links(nodes[start:start + size], fps[start:start + size], radius), np.int64).reshape(-1, 2)
            a.append(links[:, 0]), b.append(links[:, 1])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return _stars(join(a), join(b))

    return _by_bucket(of)


def _bucket_stars(radius: int, bucket_rows: int):
    """Edges (a, b) that connect the rows of a bucket within the radius. The rows of a bucket above ``bucket_rows`` come
    back as they are, with their key: they are counted and cut into blocks afterwards, and the worker never holds them."""
    edges = _bucket_edges(radius)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, large = [], 0, None

        def whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
            stars = pd.concat([*edges(iter(parts))] or [pd.DataFrame({"a": [], "b": []}, dtype=np.int64)])
            return stars.assign(key=None, fp=None)

        def passed(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"a": part["node"], "b": None, "key": part["key"], "fp": part["fp"]})

        for batch in batches:
            keys = batch["key"].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(batch) else []
            ends = np.r_[starts[1:], len(keys)] if len(batch) else []
            ready = []
            for start, end in zip(starts, ends):
                part = (start, end)
                if start == 0 and large == keys[0]:
                    yield passed(batch.iloc[start:end])
                    continue
                if start == 0 and held and held[-1]["key"].iloc[-1] == keys[0]:
                    held.append(batch.iloc[start:end])
                    rows += end - start
                else:
                    if held:
                        yield whole(held)
                    held, rows = [], 0
                    if end < len(keys) and end - start <= bucket_rows:
                        if end - start > 1:
                            ready.append(part)
                        continue
                    held, rows = [batch.iloc[start:end]], end - start
                if rows > bucket_rows:
                    large = keys[start]
                    yield from map(passed, held)
                    held, rows = [], 0
            if ready:
                yield whole([batch.iloc[np.concatenate([np.arange(x, y) for x, y in ready])]])
        if held:
            yield whole(held)

    return found


def _similar_edges(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the rows whose sets have the Jaccard similarity, among those whose fingerprints are within the radius."""
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    held = np.zeros(1 + max((int(x.max()) for x in ids if len(x)), default=0), bool)
    found, left, todo = [], np.arange(1, len(nodes)), [0]
    while todo or len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        at = todo.pop()
        other = left[sizes[left] > 0]
        other = other[np.minimum(sizes[other], sizes[at]) / np.maximum(sizes[other], sizes[at]) >= similarity]
        other = other[_near(fps[other], fps[at][None, :], radius)] if len(other) else other
        if not len(other):
            continue
        held[ids[at]] = True
        shared = np.add.reduceat(held[np.concatenate([ids[o] for o in other])].astype(np.int64), np.r_[0, np.cumsum(sizes[other])[:-1]])
        held[ids[at]] = False
        reached = other[shared / (sizes[other] + sizes[at] - shared) >= similarity]
        found += [(int(nodes[at]), int(nodes[r])) for r in reached]
        todo += reached.tolist()
        left = np.setdiff1d(left, reached, assume_unique=True)
    return found


def _group_links(radius: int, similarity: float):
    """Rows (key, node, fp, s) come sorted by key; a key's rows are a bounded group and are verified together."""
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def edges() -> pd.DataFrame:
            nodes, fps, sets = zip(*held)
            prints = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)
            links = _similar_edges(np.array(nodes, np.int64), prints, [np.asarray(s, np.int64) for s in sets], radius, similarity)
            return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

        for batch in batches:
            for row in zip(batch["key"], batch["node"], batch["fp"], batch["s"]):
                if row[0] != key:
                    if len(held) > 1:
                        yield edges()
                    key, held = row[0], []
                held.append(row[1:])
        if len(held) > 1:
            yield edges()

    return found


def _by_bucket(of):
    """Hands whole buckets to ``of``: arrays of the keys, nodes, fingerprints and whatever columns follow."""
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; the last bucket of a batch waits for the next one."""
        held: list[tuple] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch["key"].to_numpy(np.int64)
            fps = np.frombuffer(b"".join(batch["fp"]), np.uint64).reshape(len(batch), -1)
            rows = (keys, batch["node"].to_numpy(np.int64), fps, *(batch[c].to_numpy(np.int64) for c in batch.columns[3:]))
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if held and (cut or keys[0] != held[-1][0][-1]):
                first = int(np.searchsorted(keys, held[-1][0][-1], side="right")) if keys[0] == held[-1][0][-1] else 0
                held.append(tuple(x[:first] for x in rows))
                yield of(*(np.concatenate(x) for x in zip(*held)))
                held = []
                if cut > first:
                    yield of(*(x[first:cut] for x in rows))
            elif cut:
                yield of(*(x[:cut] for x in rows))
            held.append(tuple(x[cut:] for x in rows))
        if held:
            yield of(*(np.concatenate(x) for x in zip(*held)))

    return found


def near_links(reps: DataFrame, size: int, radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that connect every two of the rows (node, fp) that are within the radius and share a bucket.

    Only keys and nodes go through the first shuffle; fingerprints join them once buckets of one node are gone. Buckets above
    ``bucket_rows`` are cut by their further keys, those of long fingerprints into blocks.
    """
    keyed = cut_lineage(chain_keys(reps) if size == 1 else table_keys(reps, 64 * size), "keys")
    if size == 1:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("__n")).filter("__n > 1")
        crowded = F.col("__n") > bucket_rows
        rows = keyed.join(sizes, "key").select(F.explode(F.when(crowded, _chain_more()).otherwise(F.array("key"))).alias("key"), "node", "fp")
    else:
        rows = _bucket_rows(keyed, reps, bucket_rows).select("key", "node", "fp")
    edges = cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInPandas(_bucket_edges(radius), "a bigint, b bigint"), "links")
    discard(keyed)
    return edges


def near_duplicates(
    docs: DataFrame, words: int = 3, size: int = 1, radius: int = 3, text: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    Fingerprints of ``size`` * 64 bits link at ``radius`` or fewer differing bits; a component is named by the smallest
    doc_id reachable. With 64 bits and a radius up to 3 every link is found; longer fingerprints meet in random
    tables (see ``TABLES``). Equal fingerprints are one node, so copies cost nothing more. Null and empty texts have
    fingerprint zero and link like any other. Rows without doc_id take the component of their fingerprint, null if it
    has no id at all.
    """
    rows = cut_lineage(docs.select("doc_id", fingerprints(whole_text(text), words, size).alias("fp")), "fingerprints")
    reps = rows.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("node"))
    if size == 1 and radius > 3:
        raise ValueError("a 64-bit fingerprint takes a radius of at most 3")
    links = near_links(reps.filter("node IS NOT NULL"), size, radius, bucket_rows)
    parts = components(links)
    discard(links)
    named = reps.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: The pipeline's setting: distinct 5-word shingles and 256 bits. Of two sets of equal size 256 * acos(2J / (1 + J)) / pi
#: bits differ on average: 38.8 at a Jaccard similarity J of 0.8 with a standard deviation of 5.7, 26.6 at 0.9, 128 with no
#: relation. The radius is three deviations above the mean at 0.8; what lies within it is verified.
STAGE = {"words": 5, "size": 4, "radius": 56, "similarity": 0.8}


def candidate_groups(reps: DataFrame, radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (node, component): components of the rows (node, fp, margins) that are within the radius and share a key.

    Keys and fingerprints go through one shuffle, and only stars of edges leave it. Buckets above ``bucket_rows`` are cut
    into blocks, every two of which meet.
    """
    keyed = certain_keys(reps, *table_plan(reps.count())).repartition("key").sortWithinPartitions("key")
    stars = cut_lineage(keyed.mapInPandas(_bucket_stars(radius, bucket_rows), "a bigint, b bigint, key bigint, fp binary"), "stars")
    crowded = stars.filter("b IS NULL").select("key", F.col("a").alias("node"), "fp")
    sizes = crowded.groupBy("key").agg(F.count("*").alias("__n"))
    blocks = crowded.join(sizes, "key").select(F.explode(_block_keys(bucket_rows)).alias("key"), "node", "fp")
    more = blocks.repartition("key").sortWithinPartitions("key").mapInPandas(_bucket_edges(radius), "a bigint, b bigint")
    groups = cut_lineage(components(stars.filter("b IS NOT NULL").select("a", "b").union(more)), "groups")
    discard(stars)
    return groups


def similar_documents(
    docs: DataFrame, words: int, size: int, radius: int, similarity: float, text: str = "text", bucket_rows: int = BUCKET_ROWS,
    group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """One row (node, component) per id that is linked with another: ids are linked if the distinct shingles of their texts have
    the Jaccard similarity; a component is named by its smallest id. Rows without doc_id are left out, as are ids that name
    several texts of different shingles.

    Rows whose fingerprints are within the radius and share a key are candidates. Each component of candidates is one group:
    the shingles of its texts go to one task, and a forest of verified links is grown there, so no pair is listed. Groups
    above ``group_shingles`` are dealt into blocks, every two of which make up a task.
    """
    docs = docs.filter("doc_id IS NOT NULL")
    sketched = cut_lineage(docs.select("doc_id", sketches(whole_text(text), words, size).alias("s")).select("doc_id", "s.*"), "sketches")
    print_ = F.xxhash64("digest")
    several = sketched.groupBy("doc_id").agg(F.min(print_).alias("low"), F.max(print_).alias("high")).filter("low < high")
    rows = sketched.join(several.select("doc_id"), "doc_id", "left_anti")
    first = rows.groupBy("digest").agg(F.min("doc_id").cast("bigint").alias("node"), *[F.min(c).alias(c) for c in ("fp", "margins", "n")])
    reps = cut_lineage(first, "representatives")
    same = rows.join(reps.select("digest", "node"), "digest").filter("doc_id <> node").select(F.col("doc_id").cast("bigint").alias("a"), F.col("node").alias("b"))
    groups = candidate_groups(reps, radius, bucket_rows).join(reps.select("node", "fp", "n"), "node")
    large = groups.groupBy("component").agg(F.sum("n").alias("__n")).filter(F.col("__n") > group_shingles)
    keys = F.when(F.col("__n").isNotNull(), _block_keys(group_shingles)).otherwise(F.array(F.xxhash64(F.lit("group"), "key")))
    dealt = groups.withColumnRenamed("component", "key").join(large.withColumnRenamed("component", "key"), "key", "left")
    dealt = cut_lineage(dealt.select(F.col("node").alias("doc_id"), "fp", keys.alias("keys")), "dealt")
    # Merged at every size, as on tables too large to broadcast: small runs then tell how large ones grow.
    sets = docs.select("doc_id", whole_text(text).alias("text")).join(dealt.hint("merge"), "doc_id").select("doc_id", "fp", "keys", shingle_sets(F.col("text"), words).alias("s"))
    held = sets.select(F.explode("keys").alias("key"), F.col("doc_id").cast("bigint").alias("node"), "fp", "s")
    links = held.repartition("key").sortWithinPartitions("key").mapInPandas(_group_links(radius, similarity), "a bigint, b bigint")
    out = cut_lineage(components(links.union(same)), "components")
    for table in (dealt, reps, sketched):
        discard(table)
    return out


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The documents that stay, all columns as they are: the smallest doc_id of each group. Documents without a word,
    rows without doc_id and rows whose id names several different texts say nothing about likeness and stay."""
    groups = similar_documents(docs.filter(F.trim(F.regexp_replace(whole_text(), r"[\x09-\x0D]", " ")) != ""), **{**STAGE, **settings})
    gone = groups.filter("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")
