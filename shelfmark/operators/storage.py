"""Storage reports over catalog rows, insights and the structure proposal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.lookups import config_table
from shelfmark.functions.scale import share_of_total, top_per_group, top_rows
from shelfmark.operators.flags import clock

# Half-open size ranges (label, lower bound in bytes).
SIZE_RANGES = (("tiny", 0), ("small", 10_240), ("medium", 102_400), ("large", 1_048_576),
               ("very_large", 10_485_760), ("huge", 104_857_600))
SIZE_CLASSES = (("tiny", 0), ("small", 10_240), ("medium", 1_048_576), ("large", 10_485_760),
                ("very_large", 104_857_600))
AGE_BUCKETS = (("0-30 days", 30), ("30-90 days", 90), ("90-180 days", 180), ("180-365 days", 365))

# Proposed target folder per category.
PROPOSED_TARGETS = {
    "documents": "Active/Documents/{subcategory}/{YYYY}",
    "media": "Active/Media/{subcategory}/{YYYY-MM}",
    "code": "Active/Projects/{project_name}/src",
    "archives": "Archive/Compressed/{YYYY}",
}


def overview(files: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals in one row; distinct extensions exact or by sketch, folders distinct."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return files.agg(
        F.count("*").alias("total_files"),
        F.sum("size_bytes").alias("total_size"),
        distinct("extension").alias("unique_extensions"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def folders(files: DataFrame) -> DataFrame:
    """Folder index: every ancestor with depth, direct and nested counts and bytes.

    Files are summed per direct folder before ancestors are exploded, so the explode
    touches folders, not files.
    """
    direct = files.groupBy(paths.parent(F.col("path")).alias("folder")).agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")
    )
    spread = direct.select("folder", "n", "bytes", F.explode(paths.ancestors(F.col("folder"))).alias("path"))
    own = F.col("path") == F.col("folder")
    return (
        spread.groupBy("path")
        .agg(
            F.sum("n").alias("file_count"),
            F.sum("bytes").alias("total_size"),
            F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("direct_files"),
        )
        .withColumn("depth", paths.folder_depth(F.col("path")).cast("long"))
        .withColumn("parent", paths.parent(F.col("path")))
    )


def largest_folders(files: DataFrame, n: int = 20) -> DataFrame:
    """Folders by nested bytes."""
    return top_rows(
        folders(files).select("path", "file_count", "total_size"),
        [F.desc("total_size"), F.asc("path")],
        n,
    )


def by_category(files: DataFrame) -> DataFrame:
    grouped = files.groupBy("file_category").agg(F.count("*").alias("count"), F.sum("size_bytes").alias("total_size"))
    return share_of_total(grouped, "total_size", "pct_of_total")


def by_subcategory(files: DataFrame, totals: bool = False) -> DataFrame:
    """Per (category, subcategory); ``totals`` adds category and grand totals in one pass."""
    keys = ["file_category", "file_subcategory"]
    grouped = files.rollup(*keys) if totals else files.groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("count"),
        F.sum("size_bytes").alias("total_size"),
        F.round(F.avg("size_bytes"), 4).alias("avg_size"),
    )


def by_extension(files: DataFrame, n: int = 20) -> DataFrame:
    grouped = (
        files.where(F.col("extension").isNotNull() & (F.col("extension") != ""))
        .groupBy("extension")
        .agg(
            F.count("*").alias("count"),
            F.sum("size_bytes").alias("total_size"),
            F.round(F.avg("size_bytes"), 4).alias("avg_size"),
        )
    )
    return top_rows(grouped, [F.desc("total_size"), F.asc("extension")], n)


def _range_label(size: Column, ranges) -> Column:
    chain = F
    for label, lower in reversed(ranges):
        chain = chain.when(size >= lower, F.lit(label))
    return chain


def size_histogram(files: DataFrame) -> DataFrame:
    """All six size ranges in one pass; empty ranges are reported as zero."""
    labels = config_table(files.sparkSession, ["range_label", "lower_bytes"], SIZE_RANGES)
    counted = (
        files.groupBy(_range_label(F.col("size_bytes"), SIZE_RANGES).alias("label"))
        .agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    )
    return counted.join(labels, F.col("label") == F.col("range_label"), "right").select(
        "range_label",
        F.coalesce("n", F.lit(0)).alias("count"),
        F.coalesce("bytes", F.lit(0)).alias("total_size"),
    )


def size_classes(files: DataFrame) -> DataFrame:
    return files.groupBy(_range_label(F.col("size_bytes"), SIZE_CLASSES).alias("size_class")).agg(
        F.count("*").alias("count"), F.sum("size_bytes").alias("total_size")
    )


def timeline(files: DataFrame, column: str = "created_at", months: int = 12, with_size: bool = True) -> DataFrame:
    """Latest calendar months of a timestamp column."""
    aggregates = [F.count("*").alias("count")]
    if with_size:
        aggregates.append(F.sum("size_bytes").alias("size"))
    grouped = files.where(F.col(column).isNotNull()).groupBy(paths.month_key(F.col(column)).alias("month")).agg(*aggregates)
    return top_rows(grouped, [F.desc("month")], months)


def age_bucket(age: Column) -> Column:
    """Label by age in days; unknown ages fall in the oldest bucket."""
    chain = F
    for label, days in AGE_BUCKETS:
        chain = chain.when(age < days, F.lit(label))
    return chain.otherwise("365+ days")


def age_buckets(files: DataFrame, as_of=None) -> DataFrame:
    age = paths.age_days(F.col("modified_at"), clock(as_of))
    return files.groupBy(age_bucket(age).alias("age_bucket")).agg(
        F.count("*").alias("count"), F.sum("size_bytes").alias("total_size")
    )


def age_summary(files: DataFrame, as_of=None) -> DataFrame:
    return files.agg(
        F.count("*").alias("total_files"),
        F.round(F.avg(paths.age_days(F.col("modified_at"), clock(as_of))), 4).alias("avg_age_days"),
        F.min("modified_at").alias("oldest"),
        F.max("modified_at").alias("newest"),
    )


def stale_summary(files: DataFrame) -> DataFrame:
    """Count and bytes of rows flagged stale."""
    return files.where("is_orphaned").agg(
        F.count("*").alias("orphaned_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("orphaned_bytes")
    )


def extensions_per_category(files: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent extensions of each category with their rank."""
    counted = files.where(F.col("extension").isNotNull()).groupBy("file_category", "extension").agg(
        F.count("*").alias("count")
    )
    return top_per_group(counted, ["file_category"], [F.desc("count"), F.asc("extension")], n)


def depth_distribution(folder_index: DataFrame) -> DataFrame:
    """Folders per depth with the modal depth marked (the shallower one on ties)."""
    counted = folder_index.groupBy("depth").agg(F.count("*").alias("count"))
    # a handful of depths: the window covers aggregated rows only
    modal = F.max_by("depth", F.struct("count", -F.col("depth"))).over(Window.partitionBy())
    return counted.withColumn("is_modal", F.col("depth") == modal)


def top_level_folders(folder_index: DataFrame, n: int = 20) -> DataFrame:
    """How many folders lie under each top-level name."""
    counted = (
        folder_index.select(paths.top_level(F.col("path")).alias("folder"))
        .where(F.col("folder").isNotNull())
        .groupBy("folder")
        .agg(F.count("*").alias("count"))
    )
    return top_rows(counted, [F.desc("count"), F.asc("folder")], n)


def largest_files(files: DataFrame, n: int = 20) -> DataFrame:
    return top_rows(
        files.select("file_id", "name", "path", "size_bytes"), [F.desc("size_bytes"), F.asc("file_id")], n
    ).withColumn("size_mb", F.round(paths.megabytes(F.col("size_bytes")), 6))


def insights(files: DataFrame, groups: DataFrame, min_wasted_gb: float = 1.0) -> DataFrame:
    """Severity, title and numbers of the insights that hold for this catalog."""
    top = (
        by_category(files)
        .agg(F.max_by(F.struct("file_category", "pct_of_total", "total_size"), F.struct("total_size", "file_category")).alias("t"))
        .where(F.col("t").isNotNull())
        .select(
            F.lit("info").alias("severity"),
            F.concat(F.lit("Storage Dominated by "), F.initcap(F.col("t.file_category"))).alias("title"),
            F.col("t.total_size").alias("bytes"),
        )
    )
    dup = (
        duplication_total(groups)
        .where(paths.gigabytes(F.col("wasted_space")) > min_wasted_gb)
        .select(
            F.lit("warning").alias("severity"),
            F.concat(
                F.lit("Significant Duplication: "),
                F.format_number(paths.gigabytes(F.col("wasted_space")), 1),
                F.lit(" GB Recoverable"),
            ).alias("title"),
            F.col("wasted_space").alias("bytes"),
        )
    )
    stale = (
        stale_summary(files)
        .where(F.col("orphaned_files") > 0)
        .select(
            F.lit("suggestion").alias("severity"),
            F.concat(F.col("orphaned_files").cast("string"), F.lit(" Orphaned Files Found")).alias("title"),
            F.col("orphaned_bytes").alias("bytes"),
        )
    )
    return reduce(DataFrame.unionByName, [top, dup, stale])


def duplication_total(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count("*").alias("duplicate_sets"),
        F.coalesce(F.sum((F.col("member_count") - 1) * F.col("total_size")), F.lit(0)).alias("wasted_space"),
    )


def proposal(files: DataFrame, min_share: float = 0.01, min_bytes: int = 1_000_000_000) -> DataFrame:
    """Significant categories with their proposed target template and top folder."""
    grouped = files.groupBy("file_category").agg(
        F.count("*").alias("total_count"), F.sum("size_bytes").alias("total_size")
    )
    grouped = share_of_total(grouped, "total_count", "_pct", 12)
    chain = F
    for category, target in PROPOSED_TARGETS.items():
        chain = chain.when(F.col("file_category") == category, F.lit(target))
    target = chain.otherwise(F.concat(F.lit("Active/"), F.initcap("file_category"), F.lit("/{YYYY}")))
    significant = (F.col("_pct") > 100 * min_share) | (F.col("total_size") > min_bytes)
    return grouped.where(significant).select(
        "file_category",
        "total_count",
        "total_size",
        target.alias("target"),
        (F.col("file_category") == "code").alias("preserve_structure"),
        (F.col("file_category").isin("documents", "media", "code") & (F.col("total_count") > 100)).alias(
            "own_top_level"
        ),
    )


def lifecycle_threshold(files: DataFrame, as_of=None) -> DataFrame:
    """Days without modification after which a file should be archived."""
    avg = F.coalesce(F.avg(paths.age_days(F.col("modified_at"), clock(as_of))), F.lit(0.0))
    wanted = F.when(F.col("avg_age") > 30, F.floor(F.col("avg_age") * 1.5)).otherwise(F.lit(180))
    return files.agg(avg.alias("avg_age")).select(
        F.greatest(F.lit(180).cast("long"), wanted.cast("long")).alias("not_modified_days")
    )
