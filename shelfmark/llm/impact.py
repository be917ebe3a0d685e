"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

A posting is a row, a component and its value; its impact is the value's size.  A block
keeps its postings in segments of equal quantised impact, largest first, and for each
row the length of what lies in the segments not yet read.  All queries of a batch read
a segment together, in that order.  What a row has gained, and at most the length of its
unread rest times the query's length (or the segment's largest impact times the sum of
the query's sizes, if that is less), bound its score from above.  A query stops when the
bound proves that only few rows can still reach the k-th best score known; those that
can are rescored exactly, and of a query that never stops all rows have been read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import vectors
from shelfmark.llm.hard_negatives import scores

# Quantised impacts: upper ends of the segments as shares of a block's largest, largest first.
LEVELS = (1.0, 0.4, 0.25, 0.15, 0.1)
# Queries that read a segment together.
BATCH = 128
# Rows that may be left for rescoring when reading stops early, as a share of the block.
FEW = 0.04


def build_index(rows: DataFrame, scale: float, per_block: int = vectors.CANDIDATES) -> tuple[DataFrame, int]:
    """One row a block: numbers, ids, whole-number vectors and the segments of their postings; and the number of blocks."""
    dealt, n = vectors.dealt(rows, per_block, "block", 0)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        nos, ids, vecs = vectors.matrix(group)
        vecs = np.floor(vecs * scale)
        ends, places, tops, rest = segments_of(vecs)
        out = {"dim": vecs.shape[1], "block": group["block"].iloc[0], "nos": nos, "ids": ids, "vecs": vecs, "ends": ends, "places": places, "tops": tops, "rest": rest}
        return pd.DataFrame([{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in out.items()}])

    schema = "dim int, block int, " + ", ".join(f"{c} binary" for c in ("nos", "ids", "vecs", "ends", "places", "tops", "rest"))
    return dealt.groupBy("dim", "block").applyInPandas(pack, schema), n


def segments_of(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a block's postings, largest impacts first.

    Where each segment ends in the list of places (row times dimension plus component),
    the places, the largest impact of each segment, and for each segment and row the
    length of what is unread after it.
    """
    size = np.abs(vecs)
    most = size.max(initial=0)
    cuts = np.array([*LEVELS[1:], 0.0]) * most
    level = np.searchsorted(-cuts, -size.ravel(), "left")  # the first segment whose lower end the impact exceeds or meets
    level = np.minimum(level, len(LEVELS) - 1)
    level[size.ravel() == 0] = len(LEVELS)  # no posting
    order = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[order], np.arange(len(LEVELS)), "right")
    places = order[: ends[-1]]
    tops = np.array([size.ravel()[level == k].max(initial=0) for k in range(len(LEVELS))])
    level = level.reshape(vecs.shape)
    rest = np.stack([np.sqrt((np.where((level > k) & (level < len(LEVELS)), vecs, 0.0) ** 2).sum(axis=1)) for k in range(len(LEVELS))])
    return ends.astype(np.int64), places.astype(np.int32), tops, rest


def top_k(df: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of floor(scale * x) vectors, exactly.

    ``is_query`` is a condition on ``id``; a query's own row is no candidate of its own,
    while rows that share an id are rows of their own.  Vectors that are null or hold a
    null or non-finite component take no part; vectors meet only others of their
    dimension; equal scores go to the smaller id.  Scores are exact and stop at the ends
    of the 64-bit range.
    """
    rows = vectors.usable(df, id_col, vec_col, zero=True)
    rows = rows.where(F.forall("vec", lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float("inf"))))
    index, n_blocks = build_index(rows, scale)
    queries, n_query_blocks = vectors.pack_queries(rows.where(is_query), vectors.QUERIES)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_search(r, k, scale) for r in group.to_dict("records")])

    found = vectors.cells(index, n_blocks, queries, n_query_blocks).groupBy("dim", "block", "qblock").applyInPandas(
        search, "no long, query_id long, vec_id long, score long"
    )
    return vectors.best(found, k, F.desc("score"))


def _search(cell: dict, k: int, scale: float) -> pd.DataFrame:
    dim = cell["dim"]
    take = lambda name, kind=np.int64: np.frombuffer(cell[name], kind)
    nos, ids, vecs = take("nos"), take("ids"), take("vecs", np.float64).reshape(-1, dim)
    q_nos, q_ids = take("q_nos"), take("q_ids")
    q_vecs = np.floor(take("q_vecs", np.float64).reshape(-1, dim) * scale)
    index = Segments(vecs, take("ends"), take("places", np.int32), take("tops", np.float64), take("rest", np.float64).reshape(-1, len(nos)))
    out = []
    for start in range(0, len(q_ids), BATCH):
        part = slice(start, start + BATCH)
        for at, possible in index.possible(q_vecs[part], q_nos[part, None] != nos, k):
            q = start + at
            exact = scores(q_vecs[q : q + 1], vecs[possible])[0]
            first = np.lexsort((ids[possible], -exact))[:k]
            out.append(pd.DataFrame({"no": q_nos[q], "query_id": q_ids[q], "vec_id": ids[possible][first], "score": exact[first]}))
    return pd.concat(out)


class Segments:
    """The postings of a block, ready to be read segment by segment."""

    def __init__(self, vecs: np.ndarray, ends: np.ndarray, places: np.ndarray, tops: np.ndarray, rest: np.ndarray):
        self._vecs, self._tops, self._rest = vecs, tops, rest
        self._bounds, self._places = [0, *ends.tolist()], places
        self.read = 0  # postings read for a query, added up

    def _segment(self, k: int) -> np.ndarray:
        """The postings of one segment where they belong, zero elsewhere."""
        held = np.zeros(self._vecs.size)
        places = self._places[self._bounds[k] : self._bounds[k + 1]]
        held[places] = self._vecs.ravel()[places]
        return held.reshape(self._vecs.shape)

    def possible(self, queries: np.ndarray, allowed: np.ndarray, k: int):
        """For each query its number and the rows that may be among its k best; every other row is proved not to be."""
        open_ = np.arange(len(queries))
        gained = np.zeros(allowed.shape)
        length, total = np.sqrt((queries**2).sum(axis=1)), np.abs(queries).sum(axis=1)
        row_length = np.sqrt((self._vecs**2).sum(axis=1))
        last = len(self._tops) - 1
        for level in range(last + 1):
            held = self._segment(level)
            self.read += len(open_) * (self._bounds[level + 1] - self._bounds[level])
            gained = gained + queries[open_] @ held.T
            unread = length[open_, None] * self._rest[level]
            if level < last:
                unread = np.minimum(unread, total[open_, None] * self._tops[level + 1])
            # what rounding may cost, and the ends of the range scores are cut at
            unread = unread + 1 + 1e-12 * length[open_, None] * row_length
            may = allowed[open_]
            known = self._known(queries[open_], np.where(may, gained, -np.inf), k) - 1e-12 * length[open_] * row_length.max(initial=0)
            may = may & (np.clip(gained + unread, -(2.0**63), 2.0**63) >= np.clip(known, -(2.0**63), 2.0**63)[:, None])
            done = (may.sum(axis=1) <= max(4 * k, FEW * may.shape[1])) | (level == last)
            for at in np.flatnonzero(done):
                yield int(open_[at]), np.flatnonzero(may[at])
            open_, gained = open_[~done], gained[~done]
            if not len(open_):
                return

    def _known(self, queries: np.ndarray, gained: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query among the k rows that gained most."""
        if gained.shape[1] < k:
            return np.full(len(queries), -np.inf)
        first = np.argpartition(-gained, k - 1, axis=1)[:, :k]
        there = np.isfinite(np.take_along_axis(gained, first, axis=1)).all(axis=1)
        return np.where(there, np.einsum("qkd,qd->qk", self._vecs[first], queries).min(axis=1), -np.inf)
