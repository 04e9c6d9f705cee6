"""Nearest neighbours by cosine: a block matrix join over int8 codes."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.session import cut_lineage, discard

#: Vectors of a block hold so many bytes; blocks are the rows that are shuffled.
BLOCK_BYTES = 1 << 20
#: A tile of the join: all blocks of one group of queries with all blocks of one group of candidates.
QUERY_GROUP_BYTES, CANDIDATE_GROUP_BYTES = 32 << 20, 16 << 20
#: Products are formed for so many pairs at once.
PAIRS = 1 << 21
#: Place of a row without id among rows of one score: behind all ids, of which the smaller is better.
LAST = -(1 << 63) - 1

BLOCK = "grp int, dim int, n int, ids binary, known binary, rows binary, vectors binary"
FOUND = "query_row long, query_id long, vec_id long, known boolean, score double"
NEAREST = "query_id long, rank int, vec_id long, known boolean, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: there, not empty, all components there and finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _in_blocks(kind: str, keep: int | None):
    """Collects the rows (grp, vec_id, known, row, vector) of a task into rows of ``BLOCK``, each of one group and one length.

    With ``keep`` only so many rows of equal vectors stay in a block, those with the smallest ids: the others have the same
    score as these and come after them, so they are among the nearest of no query.
    """
    def packed(group: int, dim: int, held: list[tuple]) -> pd.DataFrame:
        ids, known, rows, vectors = (np.array(x, t) for x, t in zip(zip(*held), (np.int64, bool, np.int64, kind)))
        if keep:
            order = np.lexsort((rows, ids, ~known))
            same = pd.Series([v.tobytes() for v in vectors[order] + 0.0])
            order = order[(same.groupby(same).cumcount() < keep).to_numpy()]
            ids, known, rows, vectors = ids[order], known[order], rows[order], vectors[order]
        return pd.DataFrame([(group, dim, len(ids), ids.tobytes(), known.tobytes(), rows.tobytes(), vectors.tobytes())],
                            columns=["grp", "dim", "n", "ids", "known", "rows", "vectors"])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for group, *row in zip(batch["grp"], batch["vec_id"], batch["known"], batch["row"], batch["vector"]):
                key = (int(group), len(row[-1]))
                held = open_.setdefault(key, [])
                held.append(row)
                if len(held) * key[1] * np.dtype(kind).itemsize >= BLOCK_BYTES:
                    yield packed(*key, open_.pop(key))
        for key, held in open_.items():
            yield packed(*key, held)

    return of


class _Block:
    """Vectors with their int8 codes. A vector of length one is ``scale * code`` up to an error of length ``error``."""

    def __init__(self, row, kind: str):
        self.n, self.dim = int(row.n), int(row.dim)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.known = np.frombuffer(row.known, bool)
        self.rows = np.frombuffer(row.rows, np.int64)
        self.vectors = np.frombuffer(row.vectors, kind).reshape(self.n, self.dim).astype(np.float64)
        # A power of two that keeps the squares of any finite number finite; the cosine does not change by it.
        self.vectors = np.ldexp(self.vectors, -np.frexp(np.abs(self.vectors).max(axis=1))[1][:, None])
        self.norms = np.sqrt(in_order(self.vectors, self.vectors))
        unit = self.vectors / self.norms[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None])
        self.error = np.sqrt(((unit - codes * self.scale[:, None]) ** 2).sum(axis=1))
        self.length = np.sqrt((codes ** 2).sum(axis=1)) * self.scale
        self.codes = codes.astype(np.int8)

    def multipliable(self) -> np.ndarray:
        """The codes in a type in which sums of their products are exact."""
        return self.codes.astype(np.float32 if self.dim * 127 * 127 < 1 << 24 else np.float64)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last, so that equal rows have equal sums wherever they lie."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _offer(heap: list[tuple[float, int]], k: int, entry: tuple[float, int]) -> None:
    if len(heap) < k:
        heappush(heap, entry)
    elif entry > heap[0]:
        heappushpop(heap, entry)


class _Queries:
    """A block of queries with a heap of the nearest candidates of each, the worst on top."""

    def __init__(self, block: _Block, k: int):
        self.block, self.k = block, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(block.n)]
        self.worst = np.full(block.n, -np.inf)
        self.codes = block.multipliable()

    def meet(self, other: _Block, codes: np.ndarray) -> None:
        """One tile of products; pairs whose upper bound reaches the k-th best lower bound or heap entry are computed exactly."""
        mine = self.block
        height = max(1, PAIRS // max(1, other.n))
        for top in range(0, mine.n, height):
            part = slice(top, top + height)
            near = (self.codes[part] @ codes.T).astype(np.float64) * mine.scale[part, None] * other.scale[None, :]
            # |u.w - near| for u = scale * code + e is at most |e| |scale' * code'| + |u| |e'|; the last term is for rounding.
            error = mine.error[part, None] * other.length[None, :] + other.error[None, :] + 1e-9
            own = mine.rows[part, None] == other.rows[None, :]
            low = np.where(own, -np.inf, near - error)
            limit = self.worst[part]
            if other.n > self.k:
                limit = np.maximum(limit, np.partition(low, other.n - self.k, axis=1)[:, other.n - self.k])
            q, c = np.nonzero((near + error >= limit[:, None]) & ~own)
            q += top
            for at in range(0, len(q), 1 << 16):
                i, j = q[at:at + (1 << 16)], c[at:at + (1 << 16)]
                scores = in_order(mine.vectors[i], other.vectors[j]) / (mine.norms[i] * other.norms[j])
                for query, score, vec_id, known in zip(i.tolist(), scores.tolist(), other.ids[j].tolist(), other.known[j].tolist()):
                    heap = self.heaps[query]
                    _offer(heap, self.k, (score, -vec_id if known else LAST))
                    if len(heap) == self.k:
                        self.worst[query] = heap[0][0]

    def rows(self) -> pd.DataFrame:
        b = self.block
        out = [(int(b.rows[i]), int(b.ids[i]), -tie if tie > LAST else 0, tie > LAST, score) for i, heap in enumerate(self.heaps) for score, tie in heap]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "known", "score"])


def _tiles(k: int, kind: str):
    """Rows come sorted by tile, queries first: the queries of a tile stay in memory, its candidates pass by block for block."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, queries = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.grp, row.other, row.dim) != tile:
                    yield from (q.rows() for q in queries)
                    tile, queries = (row.grp, row.other, row.dim), []
                if row.side == 0:
                    queries.append(_Queries(_Block(row, kind), k))
                elif queries:
                    block = _Block(row, kind)
                    codes = block.multipliable()
                    for q in queries:
                        q.meet(block, codes)
        yield from (q.rows() for q in queries)

    return of


def _merged(k: int):
    """Rows come sorted by query: the heaps of its tiles become one, handed on with the best first."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, query_id, heap, out = None, None, [], []

        def close() -> None:
            for rank, (score, tie) in enumerate(sorted(heap, reverse=True), 1):
                out.append((query_id, rank, -tie if tie > LAST else 0, tie > LAST, score))

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "known", "score"])

        for batch in batches:
            for row, query, vec_id, known, score in zip(*(batch[c].tolist() for c in ("query_row", "query_id", "vec_id", "known", "score"))):
                if row != at:
                    close()
                    at, query_id, heap = row, query, []
                _offer(heap, k, (score, -vec_id if known else LAST))
            if out:
                yield frame()
                out = []
        close()
        yield frame()

    return of


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of each query row by cosine: query_id, rank from 1, vec_id, score; ties to the smaller id.

    Queries and candidates are packed into blocks of about 1 MB, blocks are dealt into groups by the bytes of the whole table, and each group
    of queries meets each group of candidates in one tile, so a task holds one group of queries and one block of candidates.
    Codes of 8 bits give every cosine with a bound on its error; what the bounds leave open is computed in double precision, and heaps
    of ``k`` rows are merged over the tiles. The result is exact.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of different lengths are no
    candidates of each other. A row is not its own candidate, but other rows of its id are; repeated query rows are answered one by one. A row
    without id is a candidate that comes last among equals and has a null vec_id. Other columns are ignored.
    """
    single = vectors.schema[vector].dataType.elementType == T.FloatType()
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    rows = vectors.select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(0)).alias("vec_id"), F.col(vec_id).isNotNull().alias("known"),
        F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"),
        F.coalesce(is_query & F.col(vec_id).isNotNull(), F.lit(False)).alias("query"),
    ).filter(usable(F.col("vector")))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    volume = F.size("vector").cast("long") * width
    asked, there = rows.agg(F.coalesce(F.sum(F.when(F.col("query"), volume)), F.lit(0)), F.coalesce(F.sum(volume), F.lit(0))).first()
    query_groups = max(1, -(-asked // QUERY_GROUP_BYTES))
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    candidate_groups = max(1, -(-there // CANDIDATE_GROUP_BYTES), min(2 * tasks // query_groups, there // BLOCK_BYTES))

    narrow = ["vec_id", "known", "row", "vector"]
    queries = rows.filter("query").select(F.pmod(F.xxhash64("row"), F.lit(query_groups)).cast("int").alias("grp"), *narrow)
    queries = queries.repartition(query_groups, "grp").mapInPandas(_in_blocks(kind, None), BLOCK)
    # Candidates are packed where they lie; a block is dealt out as a whole, to every group of queries.
    candidates = rows.select(F.lit(0).alias("grp"), *narrow).mapInPandas(_in_blocks(kind, k + 1), BLOCK).drop("grp")
    dealt = F.pmod(F.xxhash64("rows"), F.lit(candidate_groups)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    values = ["dim", "n", "ids", "known", "rows", "vectors"]
    left = queries.select("grp", each(candidate_groups).alias("other"), F.lit(0).alias("side"), *values)
    right = candidates.select(each(query_groups).alias("grp"), dealt.alias("other"), F.lit(1).alias("side"), *values)
    tile = ["grp", "other", "dim"]
    tiles = left.unionByName(right).repartition(query_groups * candidate_groups, *tile).sortWithinPartitions(*tile, "side")
    found = cut_lineage(tiles.mapInPandas(_tiles(k, kind), FOUND), "tiles")
    discard(rows)
    merged = found.repartition("query_row").sortWithinPartitions("query_row").mapInPandas(_merged(k), NEAREST)
    return merged.select("query_id", "rank", F.when(F.col("known"), F.col("vec_id")).alias("vec_id"), "score")
