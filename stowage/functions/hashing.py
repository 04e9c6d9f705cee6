"""Content hashes of table columns and derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk of the partial hash, and the text hashed for an empty file.
PARTIAL_CHUNK = 65536
EMPTY_TEXT = "empty"
ACTION_ID_LENGTH = 8


def full_hash(content: Column | str) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    return F.sha2(content.cast("binary"), 256)


def partial_hash(content: Column | str) -> Column:
    """Hash of the first chunk, the last chunk of long content, and the length.

    Only a pre-filter: equal content gives equal values, not the other way round.
    """
    content = (F.col(content) if isinstance(content, str) else content).cast("binary")
    size = F.octet_length(content)
    chunk = F.least(F.lit(PARTIAL_CHUNK), F.floor(size / 2).cast("int"))
    head = F.substring(content, F.lit(1), chunk)
    tail = F.when(size > chunk * 2, F.substring(content, size - chunk + 1, chunk)).otherwise(F.lit(b""))
    mixed = F.concat(head, tail, size.cast("string").cast("binary"))
    return F.sha2(F.when(size == 0, F.lit(EMPTY_TEXT).cast("binary")).otherwise(mixed), 256)


def action_id(transaction: Column | str, path: Column | str) -> Column:
    """Short repeatable id for display; (transaction, path) is the real key."""
    return F.substring(F.sha2(F.concat_ws("\0", transaction, path), 256), 1, ACTION_ID_LENGTH)
