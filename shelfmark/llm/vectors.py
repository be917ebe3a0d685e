"""Vectors in blocks: a query set against all rows without gathering either side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import written

# Rows of a candidate block and of a query block: what one task holds, whatever the input.
CANDIDATES = 8192
QUERIES = 1024


def usable(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """``no, id long, vec array<double>, dim``: rows with an id and only finite components; all-zero ones if ``zero``.

    ``no`` tells rows apart, also those that share an id or are equal; it is written
    once, so that it stays the same when a task runs again.
    """
    rows = df.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where("id is not null and vec is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    if not zero:
        rows = rows.where(F.exists("vec", lambda v: v != 0))
    return written(rows.withColumn("dim", F.size("vec")), "vectors")


def dealt(rows: DataFrame, per_block: int, out: str, salt: int) -> tuple[DataFrame, int]:
    """Add block number ``out`` by a hash of the row's number, and return how many blocks there are."""
    n = max(1, -(-rows.count() // per_block))
    return rows.withColumn(out, F.pmod(F.xxhash64("no", F.lit(salt)), F.lit(n)).cast("int")), n


def matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, ids and vectors of a group in ascending id order."""
    group = group.sort_values(["id", "no"])
    return group["no"].to_numpy(np.int64), group["id"].to_numpy(np.int64), np.stack(group["vec"].to_list()).astype(np.float64)


def pack_queries(rows: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """One row a query block: ``dim, qblock, q_nos, q_ids, q_vecs``, the last three binary."""
    rows, n = dealt(rows, per_block, "qblock", 1)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        nos, ids, vecs = matrix(group)
        return pd.DataFrame([{"dim": vecs.shape[1], "qblock": group["qblock"].iloc[0], "q_nos": nos.tobytes(), "q_ids": ids.tobytes(), "q_vecs": vecs.tobytes()}])

    return rows.groupBy("dim", "qblock").applyInPandas(pack, "dim int, qblock int, q_nos binary, q_ids binary, q_vecs binary"), n


def cells(index: DataFrame, n_blocks: int, queries: DataFrame, n_query_blocks: int) -> DataFrame:
    """Each query block beside each index block of its dimension: an equi-join on the cell."""
    left = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return left.hint("shuffle_hash").join(right, ["dim", "block", "qblock"])


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """``query_id, rank, vec_id, score``: the first k of each query row ``no`` by ``score`` and vec_id."""
    w = Window.partitionBy("no").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
