"""Periodic runs of words, found as maximal pairs of an LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, count
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import whole_text

#: A run has at least this many words and this many periods.
LENGTH, PERIODS = 24, 3
#: Words looked at together by the quick test; only memory depends on it.
BATCH_WORDS = 1 << 18
_ODD = 0x9E3779B97F4A7C15

SCHEMA = """n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string,
    runs array<struct<start:long,length:long,period:long>>"""


def least_match(length: int, periods: int) -> int:
    """Words that the two ends of a run's maximal pair share at least: the run is that match and one period more."""
    return min(max(length, periods * q) - q for q in range(1, length + 1))


def rewritten(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words; of every tenth id with a periodic tail in place of the last ones."""
    n, h = len(words), crc32(doc_id.encode())
    if h % 10 or not n:
        return words
    g = h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    tail = words[at:at + period]
    return words[:at] + (tail * ((n - at) // period + 1))[:n - at]


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(values)
    out[:max(0, len(values) - by)] = values[by:]
    return out


def _may_repeat(documents: list[list[bytes]], match: int) -> np.ndarray:
    """Which documents may hold some ``match`` words in a row twice. Equal words have equal hashes, so none is missed."""
    sizes = np.array([len(d) for d in documents])
    out = np.zeros(len(documents), bool)
    if sizes.sum() < match:
        return out
    grams = np.fromiter(map(hash, chain.from_iterable(documents)), np.int64, int(sizes.sum())).view(np.uint64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    factor, width, rest = _ODD, 1, match
    parts = np.zeros(len(grams), np.uint64)  # of the lower binary digits of ``match``
    while rest:
        if rest & 1:
            parts = grams + np.uint64(factor) * _ahead(parts, width)
        rest >>= 1
        if rest:
            grams = grams + np.uint64(factor) * _ahead(grams, width)
            factor, width = factor * factor % (1 << 64), 2 * width
    last = len(parts) - match + 1
    inside = np.flatnonzero(owner[:last] == owner[match - 1:])
    keys = parts[inside] * np.uint64(_ODD) ^ (owner[inside].astype(np.uint64) << np.uint64(40))
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    out[owner[inside[order[same]]]] = True
    return out


def _ranks(words: np.ndarray) -> list[np.ndarray]:
    """Rank of the next 1, 2, 4, ... words of each position, until all differ. A text's end is less than any word."""
    n = len(words)
    levels, width = [np.unique(words, return_inverse=True)[1].astype(np.int32)], 1
    while width < n and int(levels[-1].max()) < n - 1:
        low = np.full(n, -1, np.int64)
        low[:n - width] = levels[-1][width:]
        levels.append(np.unique(levels[-1].astype(np.int64) * (n + 1) + low, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return levels


def _matches(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes at ``a`` and ``b`` have in common."""
    n, a, b = len(levels[0]), a.copy(), b.copy()
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        length[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return length


class _Interval:
    """Positions below a node of the tree: all in order, and in order by the word on their left."""
    __slots__ = ("all", "by_left", "depth")

    def __init__(self, position: int, left: int, depth: int = 0):
        self.all, self.by_left, self.depth = [position], {left: [position]}, depth

    def others(self, x: int, left: list[int], reach: int) -> Iterator[int]:
        """Positions at most ``reach`` away that have another word on their left."""
        low, high = bisect_left(self.all, x - reach), bisect_right(self.all, x + reach)
        if high - low <= len(self.by_left):
            for y in self.all[low:high]:
                if left[y] != left[x]:
                    yield y
        else:
            for word, places in self.by_left.items():
                if word != left[x]:
                    yield from places[bisect_left(places, x - reach):bisect_right(places, x + reach)]

    def take(self, other: _Interval) -> None:
        for x in other.all:
            insort(self.all, x)
        for word, places in other.by_left.items():
            mine = self.by_left.setdefault(word, [])
            for x in places:
                insort(mine, x)


def find_runs(words: list[bytes], length: int = LENGTH, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs by start, then period.

    The suffixes that share at least ``least_match`` words form the lower part of the LCP-interval tree, which is walked from
    the bottom. Where two children of a node of depth m meet, positions x < y of different children share exactly
    m words, so the pair cannot be extended to the right; with different words on the left it is maximal. It is then the stretch
    from x of m + (y - x) words, which has the period y - x and cannot be extended with it. If that is long enough, the smallest
    period q divides it and gives the same stretch, so the least distance of a stretch is its period. A node only looks at distances of
    at most m / (periods - 1), and of its two sides at the smaller one.
    """
    least = least_match(length, periods)
    n = len(words)
    if n < length:
        return []
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    levels = _ranks(ids)
    suffixes = np.argsort(levels[-1], kind="stable")
    common = _matches(levels, suffixes[:-1], suffixes[1:])
    del levels
    left = np.r_[-1, ids[:-1]].tolist()
    found: dict[tuple[int, int], int] = {}

    def meet(big: _Interval, small: _Interval, depth: int) -> _Interval:
        if len(big.all) < len(small.all):
            big, small = small, big
        reach = depth // (periods - 1)
        for x in small.all:
            for y in big.others(x, left, reach):
                period = abs(y - x)
                if depth + period >= max(length, periods * period):
                    stretch = (min(x, y), depth + period)
                    found[stretch] = min(period, found.get(stretch, period))
        big.take(small)
        return big

    deep = np.flatnonzero(common >= least)
    for part in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        if not len(part):
            continue
        places, depths = suffixes[part[0]:part[-1] + 2].tolist(), common[part].tolist()
        open_ = [_Interval(places[0], left[places[0]])]  # each but the last waits for the next one at its depth
        for depth, place in zip(depths, places[1:]):
            last = open_.pop()
            while open_ and open_[-1].depth > depth:
                before = open_.pop()
                last = meet(before, last, before.depth)
            if open_ and open_[-1].depth == depth:
                before = open_.pop()
                last = meet(before, last, depth)
            last.depth = depth
            open_ += [last, _Interval(place, left[place])]
        last = open_.pop()
        while open_:
            before = open_.pop()
            last = meet(before, last, before.depth)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = (None,) * 4
    if runs:
        start, length, period = runs[0]
        for s, m, q in runs:  # by start and period, so the first of equal exponents stays
            if m * period > length * q:
                start, length, period = s, m, q
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = sha256(b" ".join(collapsed(words, runs))).hexdigest()
    return len(runs), *best, sha256(listed.encode()).hexdigest(), kept, runs


def _blocks(texts: pd.Series, ids: pd.Series) -> Iterator[list[list[bytes]]]:
    block, size = [], 0
    for text, doc_id in zip(texts, ids):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        words = words if pd.isna(doc_id) else rewritten(words, doc_id)
        block.append(words)
        size += len(words)
        if size >= BATCH_WORDS:
            yield block
            block, size = [], 0
    yield block


def runs_of(text: Column, rewrite_by: Column | None = None, length: int = LENGTH, periods: int = PERIODS) -> Column:
    """Struct of ``SCHEMA`` for each text, :func:`rewritten` first if there is an id to do it by (a null one asks for nothing)."""
    @F.pandas_udf(SCHEMA)
    def of(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows = []
        for block in _blocks(texts, ids):
            may = _may_repeat(block, least_match(length, periods))
            rows += [describe(words, find_runs(words, length, periods) if hit else []) for words, hit in zip(block, may)]
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
        out = pd.DataFrame(rows, columns=names)
        out["runs"] = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in out["runs"]]
        return out.astype({c: "Int64" for c in names[1:5]})

    # Ids travel as text: pandas would turn integers among nulls into floats.
    return of(text, F.lit(None).cast("string") if rewrite_by is None else rewrite_by.cast("string"))


def periodic_runs(docs: DataFrame, text: str = "text", rewrite: bool = False, length: int = LENGTH, periods: int = PERIODS) -> DataFrame:
    """One row per document: doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli; nulls without
    a run), runs_sha256, collapsed_sha256 and ``runs`` themselves.

    Words are what lies between ASCII blanks. A null or empty text has no words and no runs. Rows stand for themselves, so
    repeated ids, further columns and empty tables change nothing. ``rewrite`` plants periodic tails by id, see :func:`rewritten`;
    a row without id gets none. A text is one task's work; memory is some hundred bytes for each of its words.
    """
    found = runs_of(whole_text(text), F.col("doc_id") if rewrite else None, length, periods)
    return docs.select("doc_id", found.alias("__r")).select("doc_id", "__r.*")
