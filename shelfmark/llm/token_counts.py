"""Token counts by byte-pair merging with a heap and a linked list, without any ids.

The bytes of a piece are a linked list of symbols.  A heap holds the adjacent pairs that
have a merge, lowest rank first and leftmost among equals; popping one joins two symbols
and may add the pairs with its new neighbours.  Each join takes one symbol away, so a
piece has as many tokens as bytes minus joins.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import wordbpe
from shelfmark.llm.common import slices

# Characters of a text whose pieces are listed at a time.
WINDOW = 1 << 20
# Bytes of a piece from which it is counted in runs that no token can join.
LONG = 4096
RUN = 1 << 18
# Different tokens whose counts a task remembers, and the longest one it does.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
_NONE = 1 << 62
_SPACE = re.compile(r"[ \n]")


class Counter:
    """Token counts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        letters = [wordbpe.byte_letter(b) for b in range(256)]
        if any(x not in vocab or x + suffix not in vocab for x in letters):
            raise ValueError("the vocabulary must hold every byte, inside and at the end of a piece")
        self._inner = [vocab[x] for x in letters]
        self._last = [vocab[x + suffix] for x in letters]
        self._byte = {x: b for b, x in enumerate(letters)}
        # (left, right) -> (rank, joined)
        self._rank: dict[int, int] = {}
        self._joined: list[int] = []
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            self._rank[vocab[a] << 32 | vocab[b]] = rank
            self._joined.append(vocab[a + b])
        pairs = np.array(list(self._rank), np.int64)
        order = np.argsort(pairs)
        self._pairs, self._ranks = pairs[order], np.fromiter(self._rank.values(), np.int64)[order]
        # bytes that stand side by side in some token: no join ever crosses another pair
        self._meet = np.zeros((256, 256), bool)
        for token in vocab:
            held = [self._byte[c] for c in token.removesuffix(suffix) if c in self._byte]
            self._meet[held[:-1], held[1:]] = True
        self._pieces = wordbpe.load(path)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._known: dict[str, int] = {}

    # ---- one piece

    def piece(self, piece: str) -> int:
        """Tokens of one piece, given in the letters that stand for its bytes."""
        held = [self._byte[c] for c in piece]
        if len(held) <= LONG:
            return len(held) - self._joins(held, True)
        return self._long(np.array(held, np.uint8))

    def _long(self, held: np.ndarray) -> int:
        """Tokens of a long piece: runs end where no token has the two bytes side by side.

        A run without such a place stays whole and takes about 60 bytes of memory a byte.
        """
        cuts = np.append(np.flatnonzero(~self._meet[held[:-1], held[1:]]) + 1, len(held))
        joins = start = 0
        while start < len(held):
            at = np.searchsorted(cuts, start + RUN, "right") - 1
            end = int(cuts[at] if at >= 0 and cuts[at] > start else cuts[np.searchsorted(cuts, start, "right")])
            joins += self._joins(held[start:end].tolist(), end == len(held))
            start = end
        return len(held) - joins

    def _joins(self, held: list[int], ends: bool) -> int:
        """Joins of one run of bytes; ``ends`` if the piece ends with it."""
        inner = self._inner
        symbols = [inner[b] for b in held]
        if ends:
            symbols[-1] = self._last[held[-1]]
        if len(symbols) <= LONG:
            rank = self._rank
            found = [rank.get(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
            first: Iterable[int] = sorted(r << 32 | at for at, r in enumerate(found) if r >= 0)
        else:
            line = np.array(symbols, np.int64)
            keys = line[:-1] << 32 | line[1:]
            at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
            hit = np.flatnonzero(self._pairs[at] == keys)
            packed = np.sort(self._ranks[at[hit]] << 32 | hit)
            first = (e for k in range(0, len(packed), 1 << 16) for e in packed[k : k + (1 << 16)].tolist())
        return self._merge(symbols, iter(first))

    def _merge(self, symbols: list[int], first: Iterator[int]) -> int:
        """Joins made on a line of symbols; ``first`` has its pairs as rank and place, in order.

        Pairs that joins make go to a heap; the smaller of its top and the next of ``first``
        is popped.  A pair is void if one of its symbols was joined since.
        """
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, joined = self._rank, self._joined
        heap: list[int] = []
        joins = 0
        head = next(first, _NONE)
        while True:
            if heap and heap[0] < head:
                entry = heapq.heappop(heap)
            elif head != _NONE:
                entry, head = head, next(first, _NONE)
            else:
                return joins
            at = entry & 0xFFFFFFFF
            left = symbols[at]
            if left < 0:
                continue
            nxt = after[at]
            if nxt >= n:
                continue
            new = joined[entry >> 32]
            now = rank.get(left << 32 | symbols[nxt])
            if now is None or joined[now] != new:
                continue
            symbols[at], symbols[nxt] = new, -1
            joins += 1
            nxt = after[at] = after[nxt]
            if nxt < n:
                before[nxt] = at
                found = rank.get(new << 32 | symbols[nxt])
                if found is not None:
                    heapq.heappush(heap, found << 32 | at)
            prev = before[at]
            if prev >= 0:
                found = rank.get(symbols[prev] << 32 | new)
                if found is not None:
                    heapq.heappush(heap, found << 32 | prev)

    # ---- texts

    def _token(self, token: str) -> int:
        n = sum(map(self.piece, self._pieces.pieces(token)))
        if len(token) <= REMEMBERED_CHARS:
            self._known[token] = n
        return n

    def _window(self, window: str) -> int:
        """Tokens of a stretch without special strings."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        known = self._known
        tokens = self._pieces.tokens(window)
        counts = np.fromiter(map(known.get, tokens, repeat(-1)), np.int64, len(tokens))
        new = np.flatnonzero(counts < 0)
        total = int(counts.sum()) + len(new)
        for k in new.tolist():
            token = tokens[k]
            n = known.get(token)
            total += self._token(token) if n is None else n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string is one token and ends the text before it."""
        total = start = 0
        for m in self._special.finditer(text) if self._special else ():
            total += 1 + self._plain(text, start, m.start())
            start = m.end()
        return total + self._plain(text, start, len(text))

    def _plain(self, text: str, start: int, end: int) -> int:
        """Tokens of ``text[start:end]``, window by window; windows begin at blanks, which no piece holds."""
        total = 0
        while start < end:
            stop = end
            if end - start > WINDOW:
                blank = _SPACE.search(text, start + WINDOW, end)
                stop = blank.start() if blank else end
            total += self._window(text[start:stop])
            start = stop
        return total


@functools.lru_cache(2)
def load(path: str) -> Counter:
    """One counter a process and file."""
    return Counter(path)


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes long, n_tokens long`` of every whole text, one row a row of ``docs``.

    Counts are those of the tokenizers library without begin, end or padding; special
    strings inside a text are one token each.  A null or empty text has no tokens; rows
    that share an id stay rows of their own; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1)
                n_tokens = [counter.count(t) for t in texts.to_pylist()]
                sizes = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(counted, out).withColumnRenamed("id", id_col)
