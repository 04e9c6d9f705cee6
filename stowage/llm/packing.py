"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import whole_text
from stowage.session import cut_lineage

SEQUENCE = 2048
END = 0
#: Pieces that one task packs together. A group leaves about one underfull sequence, so this also bounds the waste.
GROUP_ROWS = 4000
#: Characters of the words, or parts of words, whose ids a Python worker remembers, beyond those of one block of texts;
#: as many again of those met before them.
REMEMBERED = 2_000_000
#: Characters of text whose distinct words are looked up together; a longer text goes alone.
BLOCK_CHARS = 16_000_000
#: Pieces of a bin that the two-for-one exchange looks at in pairs.
PAIR_ITEMS = 48
#: The search tries to empty this many of the emptiest bins at a time, and stops after so many exchanges in a group.
DONORS, EXCHANGES = 8, 500


#: Words of these characters are cut here just as the tokenizer's own pattern cuts them, so that their parts can be
#: remembered: ASCII and the letters of Latin-1, which lower one by one and are in normal form.
PLAIN = r"\A[!-~À-ÖØ-öø-ÿ]+\z"
PART = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the
    others for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Remembered:
    """Ids by word or part, as little-endian 32-bit numbers, found when first asked for. Those not asked for lately are
    forgotten, so common ones stay however many rare ones come between."""

    def __init__(self, find: Callable[[str], list[int]]):
        self.find, self.now, self.before, self.chars = find, {}, {}, 0

    def of(self, keys: list[str]) -> list[bytes]:
        """The ids of each of the distinct ``keys``."""
        found = list(map(self.now.get, keys))
        late = [i for i, f in enumerate(found) if f is None]
        new, ids, ends = [], [], [0]
        for i in late:
            found[i] = self.before.get(keys[i])
            if found[i] is None:
                new.append(i)
                ids += self.find(keys[i])
                ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        for i, start, end in zip(new, ends, ends[1:]):
            found[i] = data[start:end]
        for i in late:
            self.now[keys[i]] = found[i]
            self.chars += len(keys[i])
        if self.chars >= REMEMBERED:
            self.now, self.before, self.chars = {}, self.now, 0
        return found


@lru_cache(maxsize=2)
def _known(path: str) -> tuple[Remembered, Remembered]:
    """Ids of lower-case parts of plain words, and of other words through the whole tokenizer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()

    def part(text: str) -> list[int]:
        return [t.id for t in model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(letters))]

    return Remembered(part), Remembered(lambda word: tokenizer.encode(word, add_special_tokens=False).ids)


def _joined(ids: pa.Array, bounds: np.ndarray) -> pa.Array:
    """One value for each stretch of ``ids`` from one bound to the next."""
    _, offsets, data = ids.buffers()
    ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[bounds]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), data])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct parts between spaces, the number of each part in order, the bounds of each text in these)."""
    lists = pc.split_pattern(texts, " ")
    parts = lists.values.dictionary_encode()
    return parts.dictionary, parts.indices.to_numpy(), lists.offsets.to_numpy()


def _block_ids(texts: list[str], path: str) -> pa.Array:
    parts, wholes = _known(path)
    binary = pa.large_binary()
    blank = pa.array([t.replace("\n", " ").replace("\t", " ") for t in texts], pa.large_string())
    words, order, bounds = _split(blank)
    plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
    cut, part_order, part_bounds = _split(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), PART, r"\0 "))
    part_ids = pa.array(parts.of(cut.to_numpy(zero_copy_only=False).tolist()), binary)
    other_ids = pa.array(wholes.of(words.filter(pc.invert(plain)).to_pylist()), binary)
    ids = pa.concat_arrays([_joined(part_ids.take(pa.array(part_order)), part_bounds), other_ids])
    place = np.empty(len(words), np.int64)  # plain words come first in ids
    place[np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(words))
    return _joined(ids.take(pa.array(place[order])), bounds)


def token_ids(texts: Iterable[str], path: str) -> Iterator[memoryview]:
    """Ids of each text for the word-wise tokenizer in ``path``, as little-endian 32-bit numbers.

    The tokenizer lowers the text, drops white space and never joins across it, so each distinct word of a block of
    texts is looked up once, and of these each distinct part. Only spaces, tabs and line feeds are cut at: every one of
    these ends a word for it.
    """
    block, chars = [], 0
    for text in texts:
        if block and chars + len(text) > BLOCK_CHARS:
            yield from _views(_block_ids(block, path))
            block, chars = [], 0
        block.append(text)
        chars += len(text)
    if block:
        yield from _views(_block_ids(block, path))


def _views(ids: pa.Array) -> Iterator[memoryview]:
    return (memoryview(i.as_buffer()) for i in ids)


def word_token_ids(text: str, path: str) -> bytes:
    """Ids of one text, see ``token_ids``."""
    return bytes(next(token_ids([text], path)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, text: str = "text", size: int = SEQUENCE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and an end mark, cut every ``size`` ids.

    ``tokenizer`` is the path of a word-wise tokenizer's file on every worker; by default each finds its own installed
    copy. A null or empty text is the end mark alone.
    """
    @F.pandas_udf("array<struct<piece int, start long, length long, ids_crc32 long>>")
    def cut(texts: pd.Series) -> pd.Series:
        path = tokenizer or default_tokenizer()
        out = []
        for found in token_ids((t or "" for t in texts), path):
            ids = memoryview(bytes(found) + END.to_bytes(4, "little"))
            out.append([
                {"piece": i, "start": at // 4, "length": min(4 * size, len(ids) - at) // 4, "ids_crc32": zlib.crc32(ids[at:at + 4 * size])}
                for i, at in enumerate(range(0, len(ids), 4 * size))
            ])
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", F.explode(cut(whole_text(text))).alias("p")).select("doc_id", "p.*")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of piece numbers: the longest first, each into the open bin with the least room that suffices."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(int(i))
        else:
            left, b = size, len(bins)
            bins.append([int(i)])
        if left > n:
            insort(room, (left - n, b))
    return bins


def _step(poor: int, others: np.ndarray, bins: list[list[int]], lengths: np.ndarray, room: np.ndarray):
    """(bin, pieces it gets, pieces it gives) that shifts tokens from ``poor`` to one of ``others``; None without one."""
    mine = sorted(bins[poor], key=lambda i: -lengths[i])
    for i in mine:  # move
        fits = others[room[others] >= lengths[i]]
        if len(fits):
            return int(fits[np.argmin(room[fits])]), [i], []
    owner = np.repeat(others, [len(bins[b]) for b in others])
    items = np.array([i for b in others for i in bins[b]])
    have, gap = lengths[items], room[owner]
    # One of this bin, then two of it, for one of another.
    for out in (*((i,) for i in mine), *combinations(mine[:PAIR_ITEMS], 2)):
        size = sum(int(lengths[i]) for i in out)
        ok = np.flatnonzero((have < size) & (have + gap >= size))
        if len(ok):
            k = ok[np.argmax(size - have[ok])]
            return int(owner[k]), list(out), [int(items[k])]
    longest = int(lengths[mine[0]])
    for b in others:  # one for two of another
        part = sorted((i for i in bins[b] if lengths[i] < longest), key=lambda i: lengths[i])[:PAIR_ITEMS]
        for p, q in combinations(part, 2):
            both = lengths[p] + lengths[q]
            for i in mine:
                if both < lengths[i] <= both + room[b]:
                    return int(b), [i], [p, q]
    return None


def local_search(lengths: np.ndarray, bins: list[list[int]], size: int) -> list[list[int]]:
    """Empty bins by moves and exchanges between underfull ones; each makes the sum of squared fills larger.

    Starting from the emptiest bin, a piece moves to a bin as full or fuller, or changes places with one shorter piece there,
    or with two of them, or two pieces with one. The search ends when there is nothing left to shift, the bins are as
    few as the tokens allow, or after ``EXCHANGES`` steps.
    """
    bins = [list(b) for b in bins]
    room = np.array([size - int(lengths[b].sum()) for b in bins])
    least = -(-int(lengths.sum()) // size)
    used = len(bins)
    for _ in range(EXCHANGES):
        open_bins = np.flatnonzero((room > 0) & (room < size))
        if used <= least or len(open_bins) < 2:
            break
        by_room = open_bins[np.argsort(-room[open_bins], kind="stable")]
        step = None
        for n, poor in enumerate(by_room[:DONORS]):
            others = by_room[n + 1:]
            step = _step(int(poor), others, bins, lengths, room) if len(others) else None
            if step:
                break
        if step is None:
            break
        b, out, back = step
        shift = sum(int(lengths[i]) for i in out) - sum(int(lengths[i]) for i in back)
        bins[poor] = [i for i in bins[poor] if i not in out] + back
        bins[b] = [i for i in bins[b] if i not in back] + out
        room[poor] += shift
        room[b] -= shift
        used -= not bins[poor]
    return [b for b in bins if b]


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", size: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole sequences are full pieces; the others are dealt at random into groups of about ``group_rows``, each packed by
    best fit and local search in one task, so no task grows with the input and texts are not shuffled. Repeated rows
    are packed like any other.
    """
    cut = cut_lineage(pieces(docs, tokenizer, text, size).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = cut.filter(F.col("length") < size)
    groups = -(-short.count() // group_rows) or 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins = local_search(lengths, best_fit(lengths, size), size)
        order = np.array([i for b in bins for i in b])
        sequence = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        first = np.searchsorted(sequence, np.arange(len(bins)))
        out = group.iloc[order].reset_index(drop=True)
        out["sequence_id"] = group["g"].iloc[0] * (1 << 32) + sequence
        out["offset"] = starts - starts[first][sequence]
        return out[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in columns) + ", sequence_id bigint, offset bigint"
    packed = short.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("g").applyInPandas(fill, schema)
    whole = cut.filter(F.col("length") >= size).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.union(whole)
