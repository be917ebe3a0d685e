"""Token ids in Re-Pair compressed shards.

A shard holds whole documents in ascending id order.  Frequent neighbouring pairs of
symbols are replaced by new symbols, many pairs a round, until no pair within a document is
as frequent as ``frequent`` asks, in shares of the shard's symbols.  Layout of a shard, all little-endian:

    8 bytes   magic "RPRSHD02"
    6 uint64  documents, ids, symbols, rules, first rule symbol, bits a symbol
    int64     id of each document
    uint64    first id of each document within the shard, and the end
    uint64    first symbol of each document within the shard, and the end
    uint32    left and right symbol of each rule, in order; a rule uses only earlier ones
    uint32    expansion length of each rule
    bytes     the symbols, each in its bits, lowest bit first, one after the other

The document tables and expansion lengths give any document, or any id in it, without
decoding what stands before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import wordbpe
from shelfmark.llm.common import slices

MAGIC = b"RPRSHD02"
# Ids after which a shard ends with its document.
SHARD_IDS = 1 << 21
# A pair is frequent if it stands in so large a share of the shard's symbols, and in four places at least.
FREQUENT = 1 / 65536
_BUCKET_BITS = 18
NO_ID = -(1 << 63)


def _buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of each pair of 32-bit symbols to _BUCKET_BITS bits."""
    h = left * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h += right * np.uint32(0x85EBCA6B)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - _BUCKET_BITS)
    return h.astype(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int, frequent: float = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and the number of symbols up to each end of a document.

    Ends when no pair is left that stands in max(4, ``frequent`` of the symbols) places within documents.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(seq):
        least = max(4, int(len(seq) * frequent))
        bucket = _buckets(seq[:-1], seq[1:])
        bucket[last[:-1]] = 1 << _BUCKET_BITS
        counts = np.bincount(bucket, minlength=(1 << _BUCKET_BITS) + 1)
        counts[-1] = 0
        often = np.flatnonzero((counts >= least)[bucket])
        pair = (seq[often].astype(np.uint64) << np.uint64(32)) | seq[often + 1]
        kinds, n = np.unique(pair, return_counts=True)
        order = np.argsort(n, kind="stable")
        order = order[n[order] >= least]
        if not len(order):
            break
        # of pairs in one bucket the most frequent has its turn now
        owner = np.full((1 << _BUCKET_BITS) + 1, -1, np.int32)
        owner[_buckets((kinds[order] >> np.uint64(32)).astype(np.uint32), kinds[order].astype(np.uint32))] = order
        chosen = np.sort(owner[owner >= 0])
        symbol = np.zeros(len(kinds), np.uint32)
        symbol[chosen] = first_rule + n_rules + np.arange(len(chosen), dtype=np.uint32)
        own = owner[bucket[often]]
        hit = (own >= 0) & (kinds[own] == pair)
        at, new = often[hit], symbol[own[hit]]
        # of pairs that overlap in a run, every other one is replaced
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
        take = (place - first) % 2 == 0
        at, new = at[take], new[take]
        seq[at] = new
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([kinds[chosen] >> np.uint64(32), kinds[chosen] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        n_rules += len(chosen)
    stops = np.cumsum(last)
    symbol_ends = np.zeros(len(ends), np.int64)
    filled = np.diff(ends, prepend=0) > 0
    symbol_ends[filled] = np.flatnonzero(last) + 1
    symbol_ends = np.maximum.accumulate(symbol_ends) if len(ends) else symbol_ends
    assert int(stops[-1] if len(stops) else 0) == int(filled.sum())
    return seq, np.concatenate([np.zeros((0, 2), np.uint32), *rules]), symbol_ends


def layers(rules: np.ndarray, first_rule: int) -> Iterator[tuple[int, int]]:
    """Stretches of rules that use only rules before the stretch."""
    newest = np.maximum.accumulate(rules.max(axis=1, initial=0).astype(np.int64)) - first_rule
    start = 0
    while start < len(rules):
        stop = int(np.searchsorted(newest, start))
        yield start, stop
        start = stop


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    lengths = np.ones(first_rule + len(rules), np.uint32)
    for start, stop in layers(rules, first_rule):
        lengths[first_rule + start : first_rule + stop] = lengths[rules[start:stop]].sum(axis=1)
    return lengths[first_rule:]


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Bytes of ``values`` in ``width`` bits each, and eight more so that any value can be read by a word."""
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    for start in range(0, len(values), 1 << 16):  # whole bytes: the start is a multiple of eight values
        part = values[start : start + (1 << 16)].astype("<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width)
        packed = np.packbits(bits.reshape(-1), bitorder="little")
        out[start * width // 8 : start * width // 8 + len(packed)] = packed
    return out


def unpack_bits(data: np.ndarray, width: int, first: int, stop: int) -> np.ndarray:
    """Values number ``first`` to before ``stop``, found by their bit offsets."""
    at = np.arange(first, stop, dtype=np.int64) * width
    byte = at >> 3
    word = np.zeros(len(at), np.uint64)
    for k in range(5):  # 32 bits that start within a byte lie in five
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, frequent: float = FREQUENT) -> bytes:
    """A shard of the documents' ids."""
    ends = np.cumsum(counts)
    first_rule = int(ids.max(initial=0)) + 1
    seq, rules, symbol_ends = compress(ids, ends, first_rule, frequent)
    width = max(1, (first_rule + len(rules) - 1).bit_length())
    table = lambda e: np.concatenate([[0], e]).astype("<u8").tobytes()
    return b"".join(
        (
            MAGIC,
            struct.pack("<6Q", len(counts), len(ids), len(seq), len(rules), first_rule, width),
            doc_ids.astype("<i8").tobytes(),
            table(ends),
            table(symbol_ends),
            rules.astype("<u4").tobytes(),
            expansion_lengths(rules, first_rule).astype("<u4").tobytes(),
            pack_bits(seq, width).tobytes(),
        )
    )


@dataclass
class Shard:
    """Random access to a packed shard."""

    data: bytes

    def __post_init__(self) -> None:
        if self.data[:8] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        n, self.n_ids, self.n_symbols, n_rules, self.first_rule, self.width = struct.unpack_from("<6Q", self.data, 8)
        at = 56
        parts = []
        for kind, size in (("<i8", n), ("<u8", n + 1), ("<u8", n + 1), ("<u4", 2 * n_rules), ("<u4", n_rules), ("u1", (self.n_symbols * self.width + 7) // 8 + 8)):
            parts.append(np.frombuffer(self.data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        self.doc_ids, self.starts, self.symbol_starts, rules, self.lengths, self._bits = parts
        self.rules = rules.reshape(-1, 2)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def symbols(self, first: int, stop: int) -> np.ndarray:
        return unpack_bits(self._bits, self.width, first, stop)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and rules written out back to back: plain ids first, then each rule."""
        if self._flat is None:
            flat = np.arange(self.first_rule, dtype=np.uint32)
            bounds = np.concatenate([np.arange(self.first_rule + 1), self.first_rule + np.cumsum(self.lengths, dtype=np.int64)])
            for start, stop in layers(self.rules, self.first_rule):
                flat = np.concatenate([flat, wordbpe.spread(flat, bounds, self.rules[start:stop].reshape(-1).astype(np.int64))])
            self._flat = flat, bounds
        return self._flat

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self._decode(self.symbols(int(self.symbol_starts[k]), int(self.symbol_starts[k + 1])))

    def all(self) -> np.ndarray:
        return self._decode(self.symbols(0, self.n_symbols))

    def id_at(self, k: int, place: int) -> int:
        """One id of a document, found by expansion lengths alone."""
        symbols = self.symbols(int(self.symbol_starts[k]), int(self.symbol_starts[k + 1]))
        size = lambda s: 1 if s < self.first_rule else int(self.lengths[s - self.first_rule])
        ends = np.cumsum(np.where(symbols < self.first_rule, 1, self.lengths[np.maximum(symbols - self.first_rule, 0)] if len(self.lengths) else 1))
        if not 0 <= place < (ends[-1] if len(ends) else 0):
            raise IndexError(place)
        i = int(np.searchsorted(ends, place, "right"))
        symbol, place = int(symbols[i]), place - (int(ends[i - 1]) if i else 0)
        while symbol >= self.first_rule:
            left, right = (int(s) for s in self.rules[symbol - self.first_rule])
            symbol, place = (left, place) if place < size(left) else (right, place - size(left))
        return symbol

    def _decode(self, symbols: np.ndarray) -> np.ndarray:
        flat, bounds = self._expansions()
        return wordbpe.spread(flat, bounds, symbols)


def encode_shards(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, frequent: float = FREQUENT) -> DataFrame:
    """``part, seq, n_docs, n_ids, shard binary``: shards in ascending order of (part, seq).

    Rows are dealt in ranges of (id, hash of the text), so repeated ids cannot pile up in
    one task; rows with equal ids stand in the order of that hash.  Null ids come first and
    are stored as NO_ID; a null or empty text is the end id alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = seq = 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = bpe.encode(part.column(1).to_pylist())
                kept.append((np.array([NO_ID if i is None else i for i in part.column(0).to_pylist()], np.int64), counts + 1, np.insert(ids, np.cumsum(counts), end_id)))
                held += len(kept[-1][2])
                if held >= shard_ids:
                    yield _row(seq, kept, frequent)
                    kept, held, seq = [], 0, seq + 1
        if kept:
            yield _row(seq, kept, frequent)

    return ordered.mapInArrow(run, "seq int, n_docs long, n_ids long, shard binary").withColumn("part", F.spark_partition_id())


def _row(seq: int, kept: list, frequent: float) -> pa.RecordBatch:
    doc_ids, counts, ids = (np.concatenate(x) for x in zip(*kept, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([seq], pa.int32()), pa.array([len(counts)]), pa.array([len(ids)]), pa.array([pack(doc_ids, counts, ids, frequent)])], ["seq", "n_docs", "n_ids", "shard"])


def write(docs: DataFrame, folder: str, path: str, end_id: int, **options) -> None:
    """Write the shards of ``docs`` as one table of files."""
    encode_shards(docs, path, end_id, **options).write.parquet(folder)


def read_documents(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document of a written table, in the file's order.

    ``start`` counts the ids of all documents before it.
    """
    shards = spark.read.parquet(folder)
    # two steps: within a part, then over the parts
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.withColumn("part_start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start")).join(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard = Shard(row.column(2)[0].as_py())
                ids = shard.all().astype("<u4")
                bounds = shard.starts.astype(np.int64)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(shard.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NO_ID),
                        pa.array([row.column(0)[0].as_py()] * n, pa.int32()),
                        pa.array([row.column(1)[0].as_py()] * n, pa.int32()),
                        pa.array(bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["id", "part", "seq", "inside", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "shard").mapInArrow(run, "id long, part int, seq int, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select(
        F.col("id").alias(id_col), (F.col("inside") + F.col("shard_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
