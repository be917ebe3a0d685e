"""Content hashes and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUICK_BYTES = 1_048_576


def quick_hash(content: Column, chunk: int = QUICK_BYTES) -> Column:
    """SHA-256 of the first ``chunk`` bytes (a pre-filter, never the verdict)."""
    return F.sha2(F.substring(content, 1, chunk), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def adaptive_hashes(content: Column, size: Column, chunk: int = QUICK_BYTES) -> Column:
    """struct(quick, full): equal up to one chunk, full left null (lazy) above it."""
    quick = quick_hash(content, chunk)
    return F.struct(quick.alias("hash_quick"), F.when(size <= chunk, quick).alias("hash_full"))


def stable_id(*parts: Column | str) -> Column:
    """Repeatable id: sha2 of the parts joined by ``|`` (nulls become empty)."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)
