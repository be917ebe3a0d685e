"""Building blocks that keep group-shaped work safe when a few keys are hot.

The HOT_KEYS_MAX largest keys are *hot*, whatever the size of the input.  Their number is
bounded by construction, which is what makes them safe to broadcast, and any other key
holds at most 1/HOT_KEYS_MAX of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS_MAX = 1000
# Rows a hot key must have; callers may raise it where splitting small keys is not worth a row range.
HOT_ROWS_MIN = 0
# Two hex digits of an md5: 256 ordered sub-ranges of a hot key.
RANK_PREFIX = 2


def spread(df: DataFrame) -> DataFrame:
    """Spread an input with fewer splits than cores; larger inputs stay as they are.

    For processor-heavy expressions over a small file: one row group would otherwise
    keep one core busy.  On inputs with enough splits this adds nothing to the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def largest_groups(groups: DataFrame, n_col: str, floor: int = HOT_ROWS_MIN, keys: Sequence[str] = ()) -> DataFrame:
    """The HOT_KEYS_MAX largest groups above ``floor`` rows.

    Never more than HOT_KEYS_MAX rows, and a key left out holds at most
    1/HOT_KEYS_MAX of the rows.  Groups of equal size go by their keys (else all other
    columns): callers use the result in two branches that Spark may compute apart, and
    both must see the same keys.
    """
    ties = keys or [c for c in groups.columns if c != n_col]
    return groups.where(F.col(n_col) > floor).orderBy(F.desc(n_col), *ties).limit(HOT_KEYS_MAX)


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    n_col: str,
    row_id: str,
    how: str = "inner",
    floor: int = HOT_ROWS_MIN,
) -> DataFrame:
    """Join each row to its one-row-per-key group, without gathering a hot group.

    ``groups`` carries the member count in ``n_col``.  Rows of the largest groups get
    their group from a broadcast of at most HOT_KEYS_MAX rows and are not shuffled at
    all; the other rows meet theirs in an ordinary shuffle join.  Callers keep texts out
    of ``rows``.  ``row_id`` names the rows and is kept for callers that number them.
    """
    values = [c for c in groups.columns if c not in keys]
    # stated once here, the null check sits below both uses of the aggregation alike
    groups = groups.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, n_col]]))
    kept = [F.col(c) for c in rows.columns]
    hot = largest_groups(groups, n_col, floor, keys).select(*keys, F.struct(*values).alias("_group"))
    marked = rows.join(F.broadcast(hot), list(keys), "left")
    few = marked.where(F.col("_group").isNotNull()).select(*kept, *[F.col(f"_group.{v}").alias(v) for v in values])
    rest = marked.where(F.col("_group").isNull()).select(*kept)
    return few.unionByName(rest.join(groups.select(*keys, *values), list(keys), how).select(*kept, *values))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    out: str = "ordinal",
    floor: int = HOT_ROWS_MIN,
) -> DataFrame:
    """1-based position of each row within its key, ordered by md5(row_id), row_id.

    The md5 order is arbitrary but total and repeatable, and its leading hex digits
    cut a hot key into 256 ordered ranges that are numbered in parallel; each range
    then starts after the rows of the ranges before it.
    """
    marked = df.withColumn("_order", F.md5(F.col(row_id).cast("string").cast("binary")))
    counts = marked.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = F.broadcast(largest_groups(counts, "_n", floor, keys).select(*keys, F.lit(True).alias("_hot")))
    ranged = marked.join(hot, list(keys), "left").withColumn(
        "_range",
        F.when(F.col("_hot"), F.substring("_order", 1, RANK_PREFIX)).otherwise(F.lit("")),
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.where(F.col("_hot"))
        .groupBy(*keys, "_range")
        .agg(F.count("*").alias("_in_range"))
        # at most HOT_KEYS_MAX keys x 256 ranges, whatever the input size
        .withColumn("_start", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
        .drop("_in_range")
    )
    within = Window.partitionBy(*keys, "_range").orderBy("_order", row_id)
    return (
        ranged.withColumn("_pos", F.row_number().over(within))
        .join(F.broadcast(starts), [*keys, "_range"], "left")
        .withColumn(out, (F.col("_pos") + F.coalesce(F.col("_start"), F.lit(0))).cast("long"))
        .drop("_order", "_hot", "_range", "_pos", "_start")
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  Spark limits each map partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Ordered limit; plans as TakeOrderedAndProject, no global sort."""
    return df.orderBy(*order).limit(n)


def share_of_total(df: DataFrame, value: str, out: str, digits: int = 2) -> DataFrame:
    """100 * value / sum(value) over a frame with a few aggregated rows.

    For groupings bounded by configuration (categories, bands, stages): the total comes
    from a window over those rows, so the input is read once.
    """
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(out, F.round(F.try_divide(F.col(value) * F.lit(100.0), total), digits))
