"""Mixing sources to target weights by hash-random order and exact cuts.

Sources share a total in proportion to their weights, no source beyond ``most`` times its
own size; what a full source cannot take goes to the others by weight.  Within a source
rows stand in the order of a hash of their id, cut into RANGES ordered key ranges that are
sorted in parallel; the sizes before a row are the sums of the ranges before its own plus
the running sum inside it.  A source whose target is e times its size and r more takes
every row e times and the first r units of the order once more, so the cut is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import written

# Hex digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def order_key(*cols: str) -> Column:
    return F.md5(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: weights repeat over the sources in order, null last.

    Sources in the order of (cap / weight) fill up first; the first whose cap lies above its
    share of what is left, and all after it, get their weight's share.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("weight", F.element_at(cycle, (nth % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        # the first level that some source does not reach holds for it and all after it
        .withColumn("open", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")))
        .withColumn("level", F.first("open", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, 0)))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, source, size, source_size, target, taken, keep...`` for every row.

    ``size`` defaults to the words of the text.  ``taken`` is how much of the row the mix
    uses, repeats counted: whole rows, but for the one at the cut.  The target's fraction
    below one unit is dropped.  Null sources form a source of their own; rows of size 0
    take nothing; rows with equal ids stand next to each other in a repeatable order.
    """
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (words(text_col) if size is None else size).cast("long").alias("size"),
        *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)],
    )
    # texts are read once for their sizes
    sized = written(sized.withColumn("key", order_key("id")).withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "mix")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    starts = ranges.alias("r").join(wanted.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source"))).select("r.source", "range", "range_start", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    rows = ordered.join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    goal = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - epochs * F.col("source_size")
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_start") - F.col("inside")))
    return rows.select(
        F.col("d.id").alias(id_col),
        F.col("d.source").alias(source_col),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + once_more).cast("long").alias("taken"),
        *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)],
    )
