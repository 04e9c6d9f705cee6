"""Benchmark passages in documents by pigeonhole edit matching over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import whole_text

#: Edits allowed per word of an item: insertions, deletions and replacements of words.
ERROR_RATE = 0.2
#: Words of a piece that the look-up compares at once.
KEY_WORDS = 4
#: Text of the items that is matched in one pass over the documents. Larger benchmarks take several passes.
BLOCK_CHARS = 16 << 20
WORD = re.compile(r"\w+")
OUTPUT = "distance int, budget int, n_words int, start bigint, end bigint"


def myers(pattern: list[int], text: list[int], budget: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and where the first best stretch ends (exclusive);
    (budget + 1, -1) when it is above the budget.

    Myers' bit-parallel recurrence with one bit per word of the pattern.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    plus, minus, now = full, 0, m
    best, end = budget + 1, -1
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & full
        up = (minus | ~(xh | plus)) & full
        down = plus & xh
        now += bool(up & top) - bool(down & top)
        up = (up << 1) & full  # a stretch may start anywhere: the row above stays zero
        down = (down << 1) & full
        plus = (down | ~(xv | up)) & full
        minus = up & xv
        if now < best:
            best, end = now, j + 1
    return best, end


class Items:
    """Pieces of a block of items, by their first words."""

    def __init__(self, rows: list[tuple], error_rate: float = ERROR_RATE):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple] = []
        self.keys: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        known: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in rows:
            words = WORD.findall((text or "").lower())
            if words:
                ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
                known.setdefault(ids, []).append(item_id)
        for n, (ids, item_ids) in enumerate(known.items()):
            budget = int(len(ids) * error_rate)
            self.items.append((item_ids, ids, budget))
            cuts = [i * len(ids) // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                width = min(b - a, KEY_WORDS)
                key = self.mix(np.array(ids[a:a + width], np.uint64)[None, :])[0]
                self.keys.setdefault(width, {}).setdefault(int(key), []).append((n, a, b))
        self.sorted = {w: np.array(sorted(k), np.uint64) for w, k in self.keys.items()}

    @staticmethod
    def mix(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            out = (out + rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def matches(self, text: str) -> list[tuple]:
        """(item_id, distance, budget, words, start, end) for each item in the text: its best stretch, the first of equals,
        in code points of the text."""
        lowered = text.lower()
        words = WORD.findall(lowered)
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.uint64, len(words))
        hits: dict[int, set[int]] = {}
        for width, keys in self.sorted.items():
            if len(ids) < width:
                continue
            rows = np.lib.stride_tricks.sliding_window_view(ids, width)
            at = np.flatnonzero(rows.all(axis=1))
            if not len(at):
                continue
            mixed = self.mix(rows[at])
            found = keys[np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)] == mixed
            for i, key in zip(at[found].tolist(), mixed[found].tolist()):
                for n, a, b in self.keys[width][key]:
                    if tuple(ids[i:i + b - a].tolist()) == self.items[n][1][a:b]:
                        hits.setdefault(n, set()).add(i - a)
        out, spans = [], None
        for n, starts in sorted(hits.items()):
            item_ids, pattern, budget = self.items[n]
            best = (budget + 1, 0, 0)
            for s in sorted(starts):
                low = max(0, s - budget)
                window = ids[low:max(0, s + len(pattern) + budget)].tolist()
                distance, end = myers(list(pattern), window, budget)
                if distance < best[0]:
                    _, back = myers(list(pattern)[::-1], window[:end][::-1], budget)
                    best = (distance, low + end - back, low + end)
                    if not distance:
                        break
            if best[0] <= budget:
                if spans is None:
                    spans = [m.span() for m in WORD.finditer(lowered)]
                    if len(lowered) != len(text):  # a few letters grow when lowered: count in the text itself
                        ends = np.cumsum([len(c.lower()) for c in text])
                        spans = [(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1) for a, b in spans]
                a, b = (spans[best[1]][0], spans[best[2] - 1][1]) if best[2] > best[1] else (0, 0)
                out += [(i, best[0], budget, len(pattern), a, b) for i in item_ids]
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, distance, budget, n_words, start, end.

    Words are runs of letters, digits and underscores in lower case. An item of n words is found where a stretch of the document is within
    floor(n * error_rate) word edits; its best stretch is given in code points, end exclusive. The item is cut into one
    piece more than edits are allowed, so one piece at least is there unchanged: every item found by plain comparison is
    found here. Items without words, null or empty documents match nothing; items of equal words are all listed; rows with equal or null ids
    are matched row by row.

    The items of a block are sent to all workers; ``block_chars`` bounds a block, and a larger benchmark takes one pass
    for each block. Documents are neither shuffled nor collected.
    """
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, {OUTPUT}"
    narrow = docs.select("doc_id", whole_text(text).alias("text"))

    def one_pass(block: int) -> DataFrame:
        part = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        items = Items([tuple(r) for r in part.collect()], error_rate)

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch["doc_id"].astype(object), batch["text"]) for m in items.matches(t)]
                if rows:
                    out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "budget", "n_words", "start", "end"], dtype=object)
                    yield out.where(out.notna(), None)

        return narrow.mapInPandas(match, schema)

    return reduce(DataFrame.union, map(one_pass, range(blocks)))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents in which no item is found, all columns as they are. Each row is judged by its own text, whatever its id; documents
    are neither shuffled nor joined."""
    texts = benchmark.select("text").filter("text IS NOT NULL").distinct()
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))

    def clean(block: int) -> Column:
        part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()  # about ``block_chars``, each text once
        items = Items([(i, r["text"]) for i, r in enumerate(part)], error_rate)

        @F.pandas_udf("boolean")
        def none_in(found: pd.Series) -> pd.Series:
            return pd.Series([not items.matches(t) for t in found], dtype=bool)

        return none_in(whole_text(text))

    return reduce(DataFrame.filter, map(clean, range(blocks)), docs)
