"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import shared_folder, ship_package

# Text bytes a Python task works on at a time; longer texts form a slice of their own.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    """Fold 0 to 4 of a row by the crc32 of its id as text; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)), F.lit(0)).cast("int")


def sample_key(*cols: str) -> Column:
    """A repeatable number in [0, 1) for each row, for samples whose size is a parameter."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column``."""
    at = batch.schema.get_field_index(column)
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


# ---- hashes of all words of a slice at once ------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", int(_STEP)), ("down", pow(int(_STEP), -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
# a second set, for hashes independent of the first
OTHER_CODES = mix(np.arange(257, 513, dtype=np.uint64) * _STEP)


class Spans:
    """Polynomial hashes of any spans of one byte string, from prefix sums."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = _BYTE_CODES):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def word_bounds(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]
