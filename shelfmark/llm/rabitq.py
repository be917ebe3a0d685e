"""Nearest neighbours with randomly rotated one-bit codes.

Residuals from the mean are rotated by one random orthogonal matrix; a code keeps the sign
of each coordinate, and two scalars per vector: the residual's norm and the inner product
of the unit residual with its own code.  A query is rotated likewise and cut to QUERY_BITS
bit planes, so that its inner product with a code is a few popcounts.  Dividing by the
second scalar gives an unbiased estimate whose error is below
EPSILON * sqrt((1 - a^2) / (a^2 (dim - 1))) with overwhelming probability; vectors whose
lower bound is not above the k-th smallest upper bound are reranked on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import vectors

QUERY_BITS = 6
EPSILON = 3.0


def rotation(dim: int) -> np.ndarray:
    """The same random orthogonal matrix for a dimension everywhere."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def encode(vecs: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes as 64-bit words, residual norms, and inner products of unit residuals with their codes."""
    dim = vecs.shape[1]
    residual = (vecs - center) @ rotation(dim)
    norm = np.linalg.norm(residual, axis=1)
    unit = residual / np.where(norm > 0, norm, 1)[:, None]
    bits = np.zeros((len(vecs), -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = unit > 0
    own = np.where(norm > 0, np.abs(unit).sum(axis=1) / np.sqrt(dim), 1)
    return np.packbits(bits, axis=1).view(np.uint64), norm, own


def estimate(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, query: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances to one query, and the bound of their errors."""
    dim = len(center)
    q = (query - center) @ rotation(dim)
    q_norm = np.linalg.norm(q)
    low = q.min()
    step = (q.max() - low) / (2**QUERY_BITS - 1) or 1.0
    level = np.rint((q - low) / step).astype(np.int64)
    padded = np.zeros(codes.shape[1] * 64, np.int64)
    padded[:dim] = level
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    dot = np.zeros(len(codes))
    for j in range(QUERY_BITS):
        plane = np.packbits(((padded >> j) & 1).astype(np.uint8)).view(np.uint64)
        dot += 2.0**j * np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64)
    along = (2 * (low * ones + step * dot) - q.sum()) / np.sqrt(dim)
    inner = norm * along / own
    error = norm * q_norm * np.sqrt(np.maximum(0, 1 - own**2)) / own * EPSILON / np.sqrt(max(dim - 1, 1))
    error += norm * step / 2 * np.sqrt(dim) / own  # of the query's own rounding, at worst
    return norm**2 + q_norm**2 - 2 * inner, 2 * error


def build_index(rows: DataFrame, per_block: int = vectors.CANDIDATES) -> tuple[DataFrame, int]:
    """One row a block of vectors: ids, codes, scalars and the original vectors, packed; and the number of blocks."""
    at = F.posexplode("vec").alias("at", "x")
    mean = rows.select("dim", at).groupBy("dim", "at").agg(F.avg("x").alias("x")).groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("c"))
    center = {r.dim: np.array([p.x for p in r.c]) for r in mean.collect()}  # one vector for each dimension
    dealt, n = vectors.dealt(rows, per_block, "block", 0)
    shared = rows.sparkSession.sparkContext.broadcast(center)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        nos, ids, vecs = vectors.matrix(group)
        c = shared.value[vecs.shape[1]]
        codes, norm, own = encode(vecs, c)
        return pd.DataFrame(
            [{"dim": vecs.shape[1], "block": group["block"].iloc[0], "nos": nos.tobytes(), "ids": ids.tobytes(), "codes": codes.tobytes(), "scalars": np.stack([norm, own]).tobytes(), "vecs": vecs.tobytes(), "center": c.tobytes()}]
        )

    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, nos binary, ids binary, codes binary, scalars binary, vecs binary, center binary"), n


def nearest(df: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found of each query, itself left out.

    ``is_query`` is a condition on ``id``.  Vectors that are null, zero or hold a null or
    non-finite component take no part; vectors meet only others of their dimension; equal
    distances go to the smaller id.  Rows that share an id are rows of their own.
    """
    rows = vectors.usable(df, id_col, vec_col, zero=False)
    index, n_blocks = build_index(rows)
    queries, n_query_blocks = vectors.pack_queries(rows.where(is_query), vectors.QUERIES)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_search(r, k) for r in group.to_dict("records")])

    found = vectors.cells(index, n_blocks, queries, n_query_blocks).groupBy("dim", "block", "qblock").applyInPandas(
        search, "no long, query_id long, vec_id long, score double"
    )
    return vectors.best(found, k, F.col("score"))


def _search(cell: dict, k: int) -> pd.DataFrame:
    dim = cell["dim"]
    take = lambda name, kind=np.float64: np.frombuffer(cell[name], kind)
    nos, ids = take("nos", np.int64), take("ids", np.int64)
    q_nos, q_ids = take("q_nos", np.int64), take("q_ids", np.int64)
    vecs, q_vecs = take("vecs").reshape(-1, dim), take("q_vecs").reshape(-1, dim)
    codes = take("codes", np.uint64).reshape(len(ids), -1)
    (norm, own), center = take("scalars").reshape(2, -1), take("center")
    out = []
    for q_no, q_id, q in zip(q_nos, q_ids, q_vecs, strict=True):
        guess, error = estimate(codes, norm, own, q, center)
        others = np.flatnonzero(nos != q_no)
        upper, lower = (guess + error)[others], (guess - error)[others]
        reach = np.partition(upper, k - 1)[k - 1] if len(others) > k else np.inf
        near = others[lower <= reach]
        exact = np.sqrt(((vecs[near] - q) ** 2).sum(axis=1))
        first = np.lexsort((ids[near], exact))[:k]
        out.append(pd.DataFrame({"no": q_no, "query_id": q_id, "vec_id": ids[near][first], "score": exact[first]}))
    return pd.concat(out)
