"""Language identification by prediction by partial matching (PPM).

One byte context tree a language, of order 0 to ORDER, with escape method C: a symbol s
seen n(c, s) times after context c costs -log2(n(c, s) / (N + D)) bits, where N symbols of
D kinds followed c; an unseen one costs the escape -log2(D / (N + D)) and then what it
costs after the next shorter context, down to a uniform byte.  The statistics are frozen
after learning, so the code length of a text is a sum of table entries: the trees of a
block of languages share one union of contexts, and the cost of each seen (context,
symbol) pair under every language of the block is worked out once.  Every language is
learnt; blocks keep the tables in proportion to the pairs seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import sample_key, slices

ORDER = 4
# Expected texts a language of the learning sample; a language with fewer is learnt from all of them.
TEXTS_PER_LANGUAGE = 1500
# Languages that share one union of contexts; the number of blocks is not bounded.
LANGUAGES_PER_BLOCK = 8
# Symbols of context from which up a pair met once is left out of the trees, unless told otherwise.
ONCE_FROM = 3
# Text bytes scored or counted at a time: a row of costs for every byte and language is held.
SCORED_BYTES = 1 << 19
UNKNOWN = "und"

_LATIN = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


# Every byte below 128 that is no letter counts as a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of lower-case texts, each after ORDER spaces, runs of spaces as one; and where each text starts."""
    gap = b" " * ORDER
    parts = [gap + t.lower().encode() for t in texts]
    data = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    for k in range(ORDER):
        keep[starts[:-1] + k] = True
    held = [np.count_nonzero(keep[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    return data[keep], np.concatenate([[0], np.cumsum(held, dtype=np.int64)])


def pieces(data: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cut ``symbols`` into stretches of about ``size`` coded symbols, each text or part of one after its ORDER symbols of context.

    Yields data, starts, and the number of the text each part belongs to.
    """
    lengths = np.diff(starts)
    first = 0
    while first < len(lengths):
        if lengths[first] > size + ORDER:
            for at in range(int(starts[first]) + ORDER, int(starts[first + 1]), size):
                part = data[at - ORDER : min(at + size, int(starts[first + 1]))]
                yield part, np.array([0, len(part)]), np.array([first])
            first += 1
            continue
        stop = max(first + 1, int(np.searchsorted(starts, starts[first] + size, "right")) - 1)
        long = np.flatnonzero(lengths[first:stop] > size + ORDER)
        stop = first + int(long[0]) if len(long) else stop
        yield data[starts[first] : starts[stop]], starts[first : stop + 1] - starts[first], np.arange(first, stop)
        first = stop


@dataclass
class Trees:
    """Frozen union of the context trees: ``step[m]`` leads from a gram of m symbols and one more to the longer gram."""

    languages: list[str]
    code: np.ndarray
    step: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each text under each language, and the number of coded symbols."""
        return Forest([self]).lengths(texts)

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n_lang = len(self.languages)
        if len(starts) < 2:
            return np.zeros((0, n_lang))
        coded = self.code[data]
        width = int(self.code.max()) + 1
        grams = [np.zeros(len(data), np.int32)]
        for table in self.step:
            before = np.concatenate([[0], grams[-1][:-1]])
            grams.append(table[before * width + coded])
        bits = self.cost[-1][grams[-1]]
        rest = np.flatnonzero(grams[-1] == 0)
        if len(rest):
            bits[rest] = self._escaped(grams, rest)
        for k in range(ORDER):  # the spaces in front are context only
            bits[starts[:-1] + k] = 0
        return np.add.reduceat(np.vstack([bits, np.zeros((1, n_lang), bits.dtype)]).astype(np.float64), starts[:-1], axis=0)

    def _escaped(self, grams: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rest), len(self.languages)), np.float32)
        left = np.arange(len(rest))
        for order in range(len(self.step) - 1, -1, -1):
            at = rest[left]
            if order < len(self.step) - 1:
                found = grams[order + 1][at]
                hit = found > 0
                out[left[hit]] += self.cost[order][found[hit]]
                left, at = left[~hit], at[~hit]
            context = grams[order][np.maximum(at - 1, 0)] if order else np.ones(len(at), np.int32)
            out[left] += self.escape[order][context]
        out[left] += 8
        return out


@dataclass
class Forest:
    """The trees of all languages, block by block."""

    blocks: list[Trees]

    @property
    def languages(self) -> list[str]:
        return [x for block in self.blocks for x in block.languages]

    def lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each text under each language, and the number of coded symbols."""
        data, starts = symbols(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for part, bounds, own in pieces(data, starts, SCORED_BYTES):
            left = 0
            for block in self.blocks:
                total[own, left : left + len(block.languages)] += block.bits(part, bounds)
                left += len(block.languages)
        return total, np.diff(starts) - ORDER


def compile_forest(pairs: pd.DataFrame, per_block: int = LANGUAGES_PER_BLOCK) -> Forest:
    """``compile_trees`` for each block of languages; a language costs the same bits in any block."""
    block = pairs["lang"].map({x: i // per_block for i, x in enumerate(sorted(pairs["lang"].unique()))})
    return Forest([compile_trees(part) for _, part in pairs.groupby(block)])


def compile_trees(pairs: pd.DataFrame) -> Trees:
    """Trees from rows ``lang, size, gram, n``: n times the last of ``size`` packed bytes followed the others."""
    languages = sorted(pairs["lang"].unique())
    lang = pairs["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    size, gram, n = (pairs[c].to_numpy(np.int64) for c in ("size", "gram", "n"))
    used = np.union1d(gram & 255, [32])
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    step, cost, escape = [], [], []
    shorter = np.zeros(1, np.int64)  # the empty gram
    for m in range(1, ORDER + 2):
        own = size == m
        # the spaces in front of a text are a context even where no pair ends in them
        front = [int.from_bytes(b" " * m, "big")] if m <= ORDER and len(languages) else []
        keys, at = np.unique(np.concatenate([gram[own], np.array(front, np.int64)]), return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        np.add.at(counts, (at[: own.sum()], lang[own]), n[own])
        # pairs whose context was left out cannot be reached; their context then escapes nowhere
        place = np.searchsorted(shorter, keys >> 8)
        reached = (place < len(shorter)) & (shorter[np.minimum(place, len(shorter) - 1)] == keys >> 8)
        keys, counts, place = keys[reached], counts[reached], place[reached]
        ids = np.arange(1, len(keys) + 1, dtype=np.int32)
        table = np.zeros((len(shorter) + 1) * width, np.int32)
        from_id = place + 1 if m > 1 else np.zeros(len(keys), np.int64)
        table[from_id * width + code[keys & 255]] = ids
        total = np.zeros((len(shorter) + 1, len(languages)))
        kinds = total.copy()
        np.add.at(total, place + 1, counts)
        np.add.at(kinds, place + 1, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            seen = -np.log2(counts / (total + kinds)[place + 1])
        if m == 1:
            fallback = np.full((len(keys), len(languages)), 8.0)
        else:
            # the same symbol after the context without its first byte
            tail = keys & ((1 << 8 * (m - 1)) - 1)
            where = np.minimum(np.searchsorted(previous, tail), len(previous) - 1)
            fallback = np.where((previous[where] == tail)[:, None], cost[-1][where + 1], 8.0)
        full = np.where(counts > 0, seen, leave[place + 1] + fallback)
        step.append(table)
        cost.append(np.vstack([np.zeros((1, len(languages))), full]).astype(np.float32))
        escape.append(leave.astype(np.float32))
        shorter = previous = keys
    return Trees(languages, code, step, cost, escape)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = pd.DataFrame({"lang": part.column(0).to_pylist(), "text": part.column(1).to_pylist()})
            for lang, group in rows.groupby("lang"):
                for data, starts, _ in pieces(*symbols(list(group["text"])), 4 * SCORED_BYTES):
                    wide = data.astype(np.int64)
                    packed = np.zeros(len(data), np.int64)
                    for k in range(ORDER + 1):
                        packed[ORDER:] |= wide[ORDER - k : len(data) - k] << (8 * k)
                    real = np.ones(len(data), bool)
                    for k in range(ORDER):
                        real[starts[:-1] + k] = False
                    grams, n = np.unique(packed[real], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_cols: tuple[str, ...] = ("doc_id",), per_language: int = TEXTS_PER_LANGUAGE, once_from: int = ONCE_FROM) -> Forest:
    """Trees of every language from rows with a text and a language: a random sample of about ``per_language`` texts each, counted by Spark.

    After ``once_from`` or more symbols of context, what was met once is left out; ORDER + 1
    leaves nothing out.  Rows that share key columns are in the sample together.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), sample_key(*key_cols).alias("key")
    )
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    chosen = rows.join(F.broadcast(share), "lang").where("key < share").select("lang", "text")
    full = chosen.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1)))
    pairs = (
        full.withColumn("size", sizes)
        .withColumn("gram", F.expr("gram & (shiftleft(1L, 8 * size) - 1)"))
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
        .where((F.col("size") <= once_from) | (F.col("n") > 1))
    )
    return compile_forest(pairs.toArrow().to_pandas())


def predict(docs: DataFrame, trees: Forest, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``id_col, keep..., lang_pred, score, bits_per_symbol`` for every row; ``prefix`` goes before the three new names.

    ``score`` is the share of the best language in the sum of all 2^-bits.  Text that is
    null or has no letter, and any text when no language was learnt, is ``und`` with score 0.
    Repeated rows are rows of their own; a long text is coded in stretches whose bits add up.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate((id_col, *keep))]
    rows = docs.select(*kept, F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = [f"k{i}" for i in range(len(kept))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for part in slices(batch, "text", SCORED_BYTES):
                texts = [x if x is not None and has_letter(x) else "" for x in part.column(len(names)).to_pylist()]
                pred, score, rate = _choose(t, texts)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pred, score, rate], [*names, "lang_pred", "score", "bits"])

    out = rows.mapInArrow(run, f"{schema}, lang_pred string, score double, bits double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate((id_col, *keep))], *[F.col(c).alias(f"{prefix}{name}") for c, name in (("lang_pred", "lang_pred"), ("score", "score"), ("bits", "bits_per_symbol"))])


def _choose(trees: Forest, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    blank = np.array([not x for x in texts])
    languages = trees.languages
    if not languages:
        n = len(texts)
        return pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64())
    bits, n = trees.lengths(texts)
    best = bits.argmin(axis=1)
    low = bits[np.arange(len(texts)), best]
    score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
    pred = [UNKNOWN if b else languages[k] for b, k in zip(blank, best, strict=True)]
    rate = low / np.maximum(n, 1)
    return pa.array(pred, pa.string()), pa.array(np.where(blank, 0.0, score)), pa.array(rate, pa.float64(), mask=blank)


def worth_keeping(prefix: str = "", max_bits: float = 12.0) -> Column:
    """Of predicted rows: not ``und``, and coded in fewer than ``max_bits`` a symbol.

    A uniform byte after an escape from every order costs over eight bits; only text whose
    script no learnt language uses comes near twelve.
    """
    return (F.col(f"{prefix}lang_pred") != UNKNOWN) & (F.col(f"{prefix}bits_per_symbol") < max_bits)
