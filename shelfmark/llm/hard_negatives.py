"""Hard negatives with segment summaries.

A vector is cut into segments; of each the mean and the deviation (the length of what is
left after the mean) are stored.  In one segment the inner product of two vectors is
``size * mean * mean`` plus a rest of at most ``deviation * deviation``, so sums over the
segments bound every score from both sides.  Each level cuts finer and closes the bounds;
what a level proves out of reach is not looked at again, and what no level excludes is
scored exactly in whole numbers.

Two searches share one index: the best rows of the anchor's label, then for each of them
the best rows of other labels inside its band of scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import written

# Rows of an index block and anchors of a query block: what one task holds, whatever the input.
BLOCK = 8192
# Anchors compared with a block at a time.
BATCH = 128
# Segments of the levels, coarse to fine; a level needs two components a segment to say anything.
LEVELS = (2, 8, 32)
LONG_MAX = 2**63 - 1
_EXACT = float(2**53)
_KINDS = {"int16": np.int16, "int32": np.int32, "float64": np.float64}
_PACK = "dim int, block int, nos binary, ids binary, labels binary, kind string, vecs binary"


def usable(df: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``no, id, label, vec, dim`` of the rows that take part; ``no`` tells rows apart, equal ones included.

    The numbers are written once, so that they stay the same when a task runs again.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("no"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    rows = rows.where("id is not null and label is not null and vec is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(float("inf")))))
    return written(rows.withColumn("dim", F.size("vec")), "vectors")


def mine(
    df: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 3,
    band: tuple[int, int] = (50, 95),
    scale: float = 256.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of floor(scale * x).  Anchors are the rows for which
    ``is_anchor`` (a condition on ``id``) holds; their positives are the first other rows
    of their label by score and id, and the negatives of a positive the first rows of other
    labels whose score lies between the two percentages of the positive's.  A positive
    without such rows gives none.  Rows whose id, label, vector or a component is null,
    whose vector is empty or has a component that is not finite take no part; vectors
    meet only others of their length.  Rows that share an id are rows of their own, equal
    ones included.  Scores are exact and stop at the ends of the 64-bit range.
    """
    rows = usable(df, scale, id_col, vec_col, label_col)
    packed = lambda part, extra="": _packed(part, scale, block, extra)
    index, n_blocks = packed(rows)
    index = written(index, "segments")
    anchors = rows.where(is_anchor)
    found = _cells(index, n_blocks, *packed(anchors), lambda cell: _positives(cell, positives), "no long, anchor_id long, positive_id long, score long")
    first = Window.partitionBy("no").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= positives)
    found = written(found.select("no", "anchor_id", "turn", "positive_id", F.col("score").alias("positive_score")), "positives")
    goals = found.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_score"))).alias("goals"))
    goals = goals.select("no", F.transform("goals", lambda g: g["positive_score"]).alias("goals"))
    near = _cells(
        index, n_blocks, *packed(anchors.join(goals, "no"), "goals"), lambda cell: _negatives(cell, positives, negatives, band), "no long, turn int, negative_id long, negative_score long"
    )
    first = Window.partitionBy("no", "turn").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return near.join(found, ["no", "turn"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _packed(rows: DataFrame, scale: float, block: int, extra: str) -> tuple[DataFrame, int]:
    """One row a block of up to about ``block`` rows, and the number of blocks."""
    n = max(1, -(-rows.count() // block))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        vecs = np.floor(np.stack(group["vec"].to_list()) * scale)
        most = np.abs(vecs).max()
        kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "float64"
        out = {"dim": vecs.shape[1], "block": group["block"].iloc[0], "kind": kind, "vecs": vecs.astype(_KINDS[kind]).tobytes()}
        out |= {f"{c}s": group[c].to_numpy(np.int64).tobytes() for c in ("no", "id", "label")}
        if extra:
            goals = group[extra].to_list()
            out |= {"goals": np.concatenate(goals).astype(np.int64).tobytes(), "n_goals": np.array([len(g) for g in goals], np.int64).tobytes()}
        return pd.DataFrame([out])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "block").applyInPandas(pack, _PACK + (", goals binary, n_goals binary" if extra else "")), n


def _cells(index: DataFrame, n_blocks: int, queries: DataFrame, n_queries: int, search, schema: str) -> DataFrame:
    """``search`` on each query block beside each index block of its dimension: an equi-join on the cell."""
    left = index.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.select("dim", F.col("block").alias("cell"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("dim", "block")])
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    both = left.hint("shuffle_hash").join(right, ["dim", "block", "cell"])
    return both.groupBy("dim", "block", "cell").applyInPandas(lambda g: pd.concat([search(c) for c in g.to_dict("records")]), schema)


class Block:
    """Rows of one side of a cell."""

    def __init__(self, cell: dict, side: str):
        take = lambda name: np.frombuffer(cell[f"{side}{name}"], np.int64)
        self.nos, self.ids, self.labels = take("nos"), take("ids"), take("labels")
        self.vecs = np.frombuffer(cell[f"{side}vecs"], _KINDS[cell[f"{side}kind"]]).reshape(len(self.nos), -1).astype(np.float64)
        if f"{side}goals" in cell:
            ends = np.cumsum(take("n_goals"))
            self.goals = np.split(take("goals"), ends[:-1])


def summaries(vecs: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean (times the root of the segment's size) and deviation of each segment."""
    cuts = np.unique(np.linspace(0, vecs.shape[1], min(segments, vecs.shape[1]) + 1).astype(int))
    sizes = np.diff(cuts)
    means = np.add.reduceat(vecs, cuts[:-1], axis=1) / sizes
    rest = np.add.reduceat((vecs - np.repeat(means, sizes, axis=1)) ** 2, cuts[:-1], axis=1)
    return means * np.sqrt(sizes), np.sqrt(rest)


def bounds(q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores between two sets of summaries, widened by what rounding may cost."""
    middle, rest = q[0] @ x[0].T, q[1] @ x[1].T
    norm = [np.sqrt((m**2 + d**2).sum(axis=1)) for m, d in (q, x)]
    rest += 1 + 1e-12 * norm[0][:, None] * norm[1]
    return np.clip(middle - rest, -LONG_MAX, LONG_MAX), np.clip(middle + rest, -LONG_MAX, LONG_MAX)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, cut off at the ends of the 64-bit range."""
    most = np.abs(q).max(axis=1, initial=0)[:, None] * np.abs(x).max(axis=1, initial=0) * q.shape[1]
    plain = most < _EXACT
    out = np.where(plain, q @ x.T, 0).astype(np.int64)
    for a, b in zip(*np.nonzero(~plain), strict=True):
        exact = sum(int(u) * int(v) for u, v in zip(q[a], x[b], strict=True))
        out[a, b] = max(-LONG_MAX - 1, min(LONG_MAX, exact))
    return out


def narrowed(q: np.ndarray, x: np.ndarray, possible: np.ndarray, levels: list, keep) -> tuple[np.ndarray, np.ndarray]:
    """Columns that stay possible for some row of ``q`` after all levels, and the mask of what stays.

    ``keep(low, high, possible)`` tells what may still count, given the bounds of a level.
    """
    at = np.arange(len(x))
    for segments, of_x in levels:
        low, high = bounds(summaries(q, segments), (of_x[0][at], of_x[1][at]))
        possible = keep(low, high, possible)
        alive = possible.any(axis=0)
        at, possible = at[alive], possible[:, alive]
    return at, possible


def _levels(vecs: np.ndarray) -> list:
    return [(n, summaries(vecs, n)) for n in LEVELS if 2 * n <= vecs.shape[1]]


def _kth(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row under the mask, or the least there is where fewer are left."""
    seen = np.where(mask, values, -np.inf)
    return np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.full(len(seen), -np.inf)


def _positives(cell: dict, k: int) -> pd.DataFrame:
    anchors, rows = Block(cell, "q_"), Block(cell, "")
    out = []
    for label in np.intersect1d(anchors.labels, rows.labels):
        mine, own = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        vecs = rows.vecs[own]
        levels = _levels(vecs)
        for start in range(0, len(mine), BATCH):
            a = mine[start : start + BATCH]
            others = anchors.nos[a][:, None] != rows.nos[own]
            keep = lambda low, high, possible: possible & (high >= _kth(low, possible, k)[:, None])
            at, possible = narrowed(anchors.vecs[a], vecs, others, levels, keep)
            found = scores(anchors.vecs[a], vecs[at])
            possible &= found >= _kth(found, possible, k)[:, None]
            for i, row in enumerate(a):
                near = np.flatnonzero(possible[i])
                ids, score = rows.ids[own[at[near]]], found[i, near]
                first = np.lexsort((ids, -score))[:k]
                out.append(pd.DataFrame({"no": anchors.nos[row], "anchor_id": anchors.ids[row], "positive_id": ids[first], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("no", "anchor_id", "positive_id", "score")})


def _negatives(cell: dict, positives: int, k: int, band: tuple[int, int]) -> pd.DataFrame:
    anchors, rows = Block(cell, "q_"), Block(cell, "")
    levels = _levels(rows.vecs)
    parts: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(anchors.nos), BATCH):
        batch = range(start, min(start + BATCH, len(anchors.nos)))
        # a band of whole scores for each positive; an empty one (1, 0) where there is none
        least, most = np.ones((len(batch), positives)), np.zeros((len(batch), positives))
        for i, a in enumerate(batch):
            for t, score in enumerate(anchors.goals[a].tolist()):
                least[i, t], most[i, t] = -(-band[0] * score // 100), band[1] * score // 100
        # doubles next to the bands: the exact test follows
        below, above = np.nextafter(least, -np.inf), np.nextafter(most, np.inf)

        def keep(low, high, possible, least=least, most=most, below=below, above=above):
            kept = np.zeros_like(possible)
            for t in range(positives):
                sure = possible & (low >= least[:, t, None]) & (high <= most[:, t, None])
                reach = np.maximum(below[:, t], _kth(low, sure, k))
                kept |= possible & (high >= reach[:, None]) & (low <= above[:, t, None])
            return kept

        q = anchors.vecs[batch.start : batch.stop]
        others = anchors.labels[batch.start : batch.stop, None] != rows.labels
        at, possible = narrowed(q, rows.vecs, others, levels, keep)
        found = scores(q, rows.vecs[at])
        possible &= (found >= below.min(axis=1)[:, None]) & (found <= above.max(axis=1)[:, None])
        for i, a in enumerate(batch):
            near = np.flatnonzero(possible[i])
            order = near[np.lexsort((rows.ids[at[near]], -found[i, near]))]
            ids, score = rows.ids[at[order]], found[i, order]
            for t, goal in enumerate(anchors.goals[a].tolist()):
                least_t, most_t = -(-band[0] * goal // 100), band[1] * goal // 100
                begin = int(np.searchsorted(-score, -most_t, "left"))
                inside = slice(begin, begin + int(np.count_nonzero(score[begin : begin + k] >= least_t)))
                n = inside.stop - inside.start
                parts.append((np.full(n, anchors.nos[a]), np.full(n, t + 1), ids[inside], score[inside]))
    columns = ("no", "turn", "negative_id", "negative_score")
    joined = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(columns, joined, strict=True)))
