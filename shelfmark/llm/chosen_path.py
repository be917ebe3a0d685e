"""Jaccard join of word n-gram sets by chosen paths.

Texts with equal sets are one class first; one of them stands for all.  In each of RUNS
independent runs a set is split by sampled members: below a path, a member x is chosen if
a hash of (path, x) falls below 1 / (threshold * set size), and the set goes on to the
path with x added.  Two sets that share at least the threshold share a chosen member with
probability of 1 - 1/e or more on each level, whatever their sizes.  A path met by a
bucket of at most BUCKET sets is compared pair by pair there; larger buckets are split
again, up to DEPTH members, and what is still large (true near copies, in the main) is cut
into blocks that meet in cells, so no bucket is dropped, capped or gathered.

Buckets compare SKETCH one-byte minimum hashes and only link sets that may be similar.
The components of those links are then verified with the full sets: every pair inside a
component is measured exactly and counted, in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.components import connected
from shelfmark.llm.common import Spans, mix, slices, word_bounds, written

WORDS = 5
THRESHOLD = 0.8
RUNS = 10
DEPTH = 3
BUCKET = 128
SKETCH = 64
# A pair is a candidate if its sketches agree in the threshold less SLACK of the places.  The sketch is the same in every
# run, so what it misses stays missed: at 0.8 that is 4e-6 of the pairs (36 of 64 places), against 0.0021 at a slack of 0.15.
SLACK = 0.25
# Bounds of a block of a large bucket or component: sets, and members of them.
BLOCK_SETS = 1024
BLOCK_MEMBERS = 1 << 20

# Odd multipliers and path seeds; SKETCH is at most their number.
_PARTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``words`` lower-case words of each text; a shorter text is one run."""
    parts = [t.lower().encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts, ends = word_bounds(_IS_WORD[data])
    codes = Spans(data).hash(starts, ends)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    runs = np.zeros(max(0, len(codes) - words + 1), np.uint64)
    for k in range(words):
        runs += codes[k : k + len(runs)] * _PARTS[k]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            short = (codes[a:b] * _PARTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one, two = mix(s).sum(dtype=np.uint64), mix(s ^ _PARTS[9]).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A byte of each of SKETCH minimum hashes, one row a set."""
    out = np.zeros((len(sets), SKETCH), np.uint8)
    filled = [k for k, s in enumerate(sets) if len(s)]
    if filled:
        members = np.concatenate([sets[k] for k in filled])
        starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in filled])[:-1]])
        for j in range(SKETCH):
            low = np.minimum.reduceat(members * _PARTS[j], starts)
            out[filled, j] = mix(low) >> np.uint64(56)
    return out


def paths(s: np.ndarray, runs: int, threshold: float) -> list[tuple[int | None, ...]]:
    """Leaves of a set's trees: paths of 1 to DEPTH members, filled up with None."""
    share = 1 / (threshold * len(s))
    limit = np.uint64(int(share * 2**64)) if share < 1 else np.uint64(2**64 - 1)
    out: list[tuple[int | None, ...]] = []
    for run in range(runs):
        todo: list[tuple[np.uint64, tuple[int, ...]]] = [(_PARTS[run], ())]
        while todo:
            path, above = todo.pop()
            h = mix(s ^ path)
            chosen = h[h <= limit]
            if not len(chosen) and above:
                out.append(above + (None,) * (DEPTH - len(above)))
            for x in mix(chosen ^ _PARTS[40 + len(above)]):
                below = (*above, int(x.view(np.int64)))
                if len(below) == DEPTH:
                    out.append(below)
                else:
                    todo.append((x, below))
    return out


def _features(runs: int, threshold: float):
    """Per text: name and size of its set, sketch, and leaves of its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(part.column(1).to_pylist())
                keys = [set_key(s) if len(s) else (None, None) for s in sets]
                leaves = [paths(s, runs, threshold) if len(s) else [] for s in sets]
                steps = [pa.array([leaf[d] for own in leaves for leaf in own], pa.int64()) for d in range(DEPTH)]
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).astype(np.int32))
                tree = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(steps, [f"p{d + 1}" for d in range(DEPTH)]))
                cols = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
                cols += [pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in sketches(sets)], pa.binary()), tree]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "s1", "s2", "n", "sketch", "paths"])

    return run


def _buckets(reps: DataFrame) -> DataFrame:
    """``leaf, id, blocks``: each set beside the paths of its final buckets; paths of one set alone are left out."""
    rows = reps.select("id", F.inline("paths"))
    final = []
    for depth in range(1, DEPTH + 1):
        path = f"p{depth}"
        sizes = rows.where(F.col(path).isNotNull()).groupBy(path).agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(path, "size")
        met = rows.join(sizes, path)
        if depth < DEPTH:
            met = written(met, "paths")
            final.append(met.where(F.col("size") <= BUCKET).select(F.col(path).alias("leaf"), "id", F.lit(1).alias("blocks")))
            rows = met.where(F.col("size") > BUCKET).drop("size")
        else:
            final.append(met.select(F.col(path).alias("leaf"), "id", F.ceil(F.col("size") / BLOCK_SETS).cast("int").alias("blocks")))
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _in_cells(rows: DataFrame, group: str) -> DataFrame:
    """Deal each group over ``blocks`` blocks, and every two blocks into a cell: adds block, first and second."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")


def _similar(a_sketch: np.ndarray, a_n: np.ndarray, b_sketch: np.ndarray, b_n: np.ndarray, threshold: float) -> np.ndarray:
    agree = (a_sketch == b_sketch).mean(axis=1)
    small, large = np.minimum(a_n, b_n), np.maximum(a_n, b_n)
    return (agree >= threshold - SLACK) & (small >= threshold * large)


def _links_of(ids: np.ndarray, n: np.ndarray, sk: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Links that connect what is similar in one bucket: from each found set outwards to those not yet reached."""
    rest = np.arange(len(ids))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            at = front.pop()
            near = _similar(sk[rest], n[rest], sk[at], n[at], threshold)
            for x in rest[near].tolist():
                if ids[x] != ids[root]:
                    yield int(ids[root]), int(ids[x])
                front.append(x)
            rest = rest[~near]


def _candidates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, ids, n, sk in _whole_cells(batches):
            starts = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1 if len(cell) else 0) != 0)
            sizes = np.diff(np.append(starts, len(cell)))
            found: list[tuple[int, int]] = []
            # buckets of two, the most common kind, all at once
            two = starts[sizes == 2]
            hit = two[_similar(sk[two], n[two], sk[two + 1], n[two + 1], threshold) & (ids[two] != ids[two + 1])]
            found += zip(ids[hit].tolist(), ids[hit + 1].tolist(), strict=True)
            for a, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                b = a + size
                found += _links_of(ids[a:b], n[a:b], sk[a:b], threshold)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of sorted rows, cut only between cells."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, ids, n = (batch.column(k).to_numpy() for k in range(3))
        sk = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            held.append((cell[:cut], ids[:cut], n[:cut], sk[:cut]))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append((cell[cut:], ids[cut:], n[cut:], sk[cut:]))
        if len(held) > 1 and held[0][0][0] != cell[-1]:
            yield held.pop(0)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for part in slices(batch, "text"):
            sets = shingles(part.column(names.index("text")).to_pylist())
            keep = [part.column(names.index(c)) for c in ("id", "label", "blocks")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "label", "blocks", "members"])


def _verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Exact similarities inside a cell: each set's number of links, and the smallest id it is connected to here."""
    group = group.drop_duplicates(["id", "members"]).sort_values("id")
    ids, block = group["id"].to_numpy(np.int64), group["block"].to_numpy()
    sets = [np.frombuffer(m, np.uint64) for m in group["members"]]
    sizes = np.array([len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = n[column] > 1
    row, column = row[common], column[common]
    used, column = np.unique(column, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, len(used), 2048):
        a, b = np.searchsorted(column, [start, start + 2048])
        held = np.zeros((len(sets), min(2048, len(used) - start)), np.float32)
        held[row[a:b], column[a:b] - start] = 1
        both += held @ held.T
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if group["first"].iloc[0] != group["second"].iloc[0]:
        linked &= block[:, None] != block[None, :]
    label = ids.copy()
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (lower == label).all():
            break
        label = lower
    return pd.DataFrame({"id": ids, "links": linked.sum(axis=1), "root": label, "whole": group["blocks"].to_numpy() == 1})


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """``id_col, class_id, copy_of, n_links`` for every row.

    ``copy_of`` is the smallest id with an equal set of word runs, ``n_links`` the number of
    other sets within the threshold, ``class_id`` the smallest id that links lead to.  Rows
    without a word, and rows without an id, stand alone with no links.  Repeated rows are
    copies of each other; texts that share an id are joined as separate texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tree = ", ".join(f"p{d + 1}: bigint" for d in range(DEPTH))
    all_sets = written(rows.mapInArrow(_features(runs, threshold), f"id long, s1 long, s2 long, n long, sketch binary, paths array<struct<{tree}>>"), "sets")
    classes = all_sets.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("copy_of"))
    reps = all_sets.join(classes.select("s1", "s2", F.col("copy_of").alias("id")), ["s1", "s2", "id"], "left_semi")
    cells = _in_cells(_buckets(reps), "leaf").select(
        F.when(F.col("blocks") == 1, F.col("leaf")).otherwise(F.xxhash64("leaf", "first", "second")).alias("cell"), "id"
    )
    known = reps.select("id", "n", "sketch").dropDuplicates(["id", "sketch"])
    sorted_cells = cells.distinct().join(known, "id").select("cell", "id", "n", "sketch").repartition("cell").sortWithinPartitions("cell")
    near = connected(sorted_cells.mapInArrow(_candidates(threshold), "a long, b long").distinct(), "a", "b")
    weighed = near.join(reps.select("id", "n"), "id")
    sizes = weighed.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    members = near.join(sizes, "label")
    full = rows.join(members, "id").mapInArrow(_sets, "id long, label long, blocks int, members binary")
    measured = _in_cells(full, "label").groupBy("label", "first", "second").applyInPandas(lambda g: _verify(g, threshold), "id long, links long, root long, whole boolean")
    measured = written(measured, "links")
    across = measured.where("not whole and root < id").select("id", "root")
    label = measured.where("whole").select("id", F.col("root").alias("class_id"))
    if not across.isEmpty():
        label = label.unionByName(connected(across, "id", "root").select("id", F.col("label").alias("class_id")))
    linked = measured.groupBy("id").agg(F.sum("links").alias("n_links"))
    found = classes.join(label.dropDuplicates(["id"]).withColumnRenamed("id", "copy_of"), "copy_of", "left").join(linked.withColumnRenamed("id", "copy_of"), "copy_of", "left")
    out = all_sets.select("id", "s1", "s2").join(found, ["s1", "s2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNotNull(), F.coalesce("class_id", "copy_of", "id")).alias("class_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("copy_of", "id")).alias("copy_of"),
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
    )
