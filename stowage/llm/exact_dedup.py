"""Exact duplicates through a cuckoo-filter index of live digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import BLANKS, free_name, whole_text
from stowage.session import cut_lineage

SLOTS = 4
KICKS = 200
FIRST_BUCKETS = 1024


class CuckooIndex:
    """Cuckoo filter over digests whose slots point at the stored keys.

    A slot holds a 16-bit tag and the number of a stored key. A digest can lie in two buckets; a tag that agrees is
    only a hit once the stored digest agrees too. When an insertion finds no place after ``KICKS`` moves, the
    table doubles and is filled again from the stored keys, so nothing is ever lost. Deleting frees the slot.
    """

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.keys: list[bytes | None] = []
        self.least: list = []
        self.count: list[int] = []
        self.free: list[int] = []
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = array("H", bytes(2 * SLOTS * buckets))
        self.refs = array("q", bytes(8 * SLOTS * buckets))

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995) & self.mask)

    def find(self, digest: bytes) -> int:
        """Slot of the digest, -1 without one."""
        tag, first, second = self._place(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.keys[self.refs[slot]] == digest:
                    return slot
        return -1

    def _settle(self, digest: bytes, ref: int) -> bool:
        tag, first, second = self._place(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.refs[slot] = tag, ref
                    return True
        bucket = second
        for kick in range(KICKS):
            slot = bucket * SLOTS + (kick + ref) % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            ref, self.refs[slot] = self.refs[slot], ref
            bucket = self._other(bucket, tag)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.refs[slot] = tag, ref
                    return True
        return False

    def _grow(self) -> None:
        buckets = self.mask + 1
        settled = False
        while not settled:
            buckets *= 2
            self._clear(buckets)
            settled = all(self._settle(k, i) for i, k in enumerate(self.keys) if k is not None)
        self.resizes += 1

    def insert(self, digest: bytes, least, count: int = 1) -> bool:
        """Add ``count`` copies whose smallest id is ``least``; True when the digest is new."""
        slot = self.find(digest)
        if slot >= 0:
            ref = self.refs[slot]
            self.count[ref] += count
            if least is not None and (self.least[ref] is None or least < self.least[ref]):
                self.least[ref] = least
            return False
        if self.free:
            ref = self.free.pop()
            self.keys[ref], self.least[ref], self.count[ref] = digest, least, count
        else:
            ref = len(self.keys)
            self.keys.append(digest), self.least.append(least), self.count.append(count)
        if not self._settle(digest, ref):
            self._grow()
        return True

    def delete(self, digest: bytes, count: int = 1) -> bool:
        """Take ``count`` copies away; the digest leaves with its last copy. False when it is not there."""
        slot = self.find(digest)
        if slot < 0:
            return False
        ref = self.refs[slot]
        self.count[ref] -= count
        if self.count[ref] <= 0:
            self.tags[slot] = 0
            self.keys[ref] = None
            self.free.append(ref)
        return True

    def rows(self) -> pd.DataFrame:
        live = [i for i, k in enumerate(self.keys) if k is not None]
        return pd.DataFrame({
            "digest": [self.keys[i] for i in live],
            "keep_id": pd.array([self.least[i] for i in live], dtype="Int64"),
            "group_size": [self.count[i] for i in live],
        })


def text_digest(column: str = "text") -> Column:
    """SHA-256 of the text with each run of blanks replaced by one space, 64 lowercase hex digits."""
    return F.sha2(F.regexp_replace(whole_text(column), BLANKS, " "), 256)


GROUPS = "digest binary, keep_id bigint, group_size bigint"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = CuckooIndex()
    for batch in batches:
        ids = batch["keep_id"].astype("Int64")
        for digest, least, known, count in zip(batch["digest"], ids.fillna(0), ids.notna(), batch["group_size"]):
            index.insert(bytes(digest), int(least) if known else None, int(count))
    if index.keys:
        yield index.rows()


def digest_groups(digests: DataFrame) -> DataFrame:
    """(digest binary, keep_id, group_size) of rows (doc_id, digest): the index of all live digests.

    Each input partition first folds its own copies through an index, so a digest with a third of all rows
    reaches the shuffle once per task; the partitions of the shuffle then hold one index each. An index is
    as large as the distinct digests of its partition, about 100 bytes each.
    """
    ones = digests.select("digest", F.col("doc_id").cast("bigint").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    return ones.mapInPandas(_fold, GROUPS).repartition("digest").mapInPandas(_fold, GROUPS)


def update_groups(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """Live digests after changes (digest, doc_id, copies): positive copies are inserted, negative ones deleted.

    ``groups`` is a result of :func:`digest_groups` or of this function. Insertions come before deletions;
    deleting a digest that is not live does nothing. ``keep_id`` stays the smallest id ever inserted while its
    digest is live.
    """
    rows = groups.select("digest", "keep_id", "group_size", F.lit(0).alias("step")).union(
        changes.select("digest", F.col("doc_id").cast("bigint"), F.col("copies").cast("bigint"), F.when(F.col("copies") > 0, 1).otherwise(2))
    )

    def apply(batches):
        index = CuckooIndex()
        for batch in batches:
            ids = batch["keep_id"].astype("Int64")
            for digest, least, known, count in zip(batch["digest"], ids.fillna(0), ids.notna(), batch["group_size"]):
                if count > 0:
                    index.insert(bytes(digest), int(least) if known else None, int(count))
                elif count < 0:
                    index.delete(bytes(digest), -int(count))
        if index.keys:
            yield index.rows()

    return rows.repartition("digest").sortWithinPartitions("step").drop("step").mapInPandas(apply, GROUPS)


def exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after replacing runs of blanks by one space; null counts as empty. The smallest
    doc_id stays; a repeated row with that id stays too, and a null id stays only in a group without any other.
    Only ids and digests are shuffled; a digest with very many rows is split by adaptive execution.
    """
    rows = cut_lineage(docs.select(F.col("doc_id"), text_digest(text).alias("text_sha256")), "digests")
    groups = digest_groups(rows.select("doc_id", F.unhex("text_sha256").alias("digest")))
    found = groups.select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size")
    return rows.join(found, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they are. Repeated rows of the id that stays are kept."""
    gone = exact_duplicates(docs).filter("NOT kept").select("doc_id", "text_sha256").distinct()
    id_, sha = (free_name(docs, n) for n in ("id", "sha"))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (text_digest() == F.col(sha))
    return docs.join(gone, same, "left_anti")
