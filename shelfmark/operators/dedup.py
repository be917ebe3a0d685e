"""Exact duplicate groups, keeper choice, consolidation across sources.

Keepers are chosen by one aggregation per group (partial on the map side), never by
ranking a whole group in one task; members are joined back with hot groups split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.hashing import stable_id
from shelfmark.functions.scale import HOT_ROWS_MIN, join_groups

# Keeper scoring weights.
NEWEST_POINTS = 10
PREFERRED_POINTS = 20
DEPTH_POINTS = 10
DESCRIPTIVE_POINTS = 5
ACCESS_POINTS = 15
GENERIC_NAME = r"(?i)(copy|backup|\(\d+\)|untitled)"

BLOCK = ("size_bytes", "extension")
EXACT = ("size_bytes", "extension", "hash_quick", "hash_full")


def candidate_blocks(files: DataFrame) -> DataFrame:
    """(size, extension) blocks of non-empty files with at least two members."""
    return (
        files.where(F.col("size_bytes") > 0)
        .groupBy(*BLOCK)
        .agg(F.count("*").alias("member_count"))
        .where(F.col("member_count") > 1)
        .withColumn("block_id", stable_id("size_bytes", "extension"))
    )


def block_members(files: DataFrame, floor: int = HOT_ROWS_MIN) -> DataFrame:
    """Files of candidate blocks in long form (one row per member, no id lists)."""
    blocks = candidate_blocks(files)
    rows = files.where(F.col("size_bytes") > 0)
    return join_groups(rows, blocks, BLOCK, "member_count", "file_id", floor=floor)


def base_score(
    preferred_paths: Sequence[str] = (),
    preferred_points: int = PREFERRED_POINTS,
    depth_points: int = DEPTH_POINTS,
    descriptive_points: int = DESCRIPTIVE_POINTS,
    access_points: int = ACCESS_POINTS,
) -> Column:
    """Keeper score of a file without the points for being the newest."""
    preferred = F.lit(False)
    for part in preferred_paths:
        preferred = preferred | F.contains(F.col("path"), F.lit(part))
    return (
        F.when(preferred, preferred_points).otherwise(0)
        + F.greatest(F.lit(0), F.lit(depth_points) - paths.separators(F.col("path")))
        + F.when(F.col("name").rlike(GENERIC_NAME), 0).otherwise(descriptive_points)
        + F.least(F.lit(access_points), F.greatest(F.lit(0), F.coalesce(F.col("access_count"), F.lit(0))))
    ).cast("long")


def _keeper_columns(newest_points: int) -> list[Column]:
    """canonical_file and newest_file from the aggregates _newest and _best."""
    newest_total = F.col("_newest.base") + newest_points
    best_total = -F.col("_best.minus_base")
    newest_id, best_id = F.col("_newest.file_id"), F.col("_best.file_id")
    keeper = (
        F.when(newest_total > best_total, newest_id)
        .when(newest_total < best_total, best_id)
        .otherwise(F.least(newest_id, best_id))
    )
    return [keeper.alias("canonical_file"), newest_id.alias("newest_file")]


def keeper_groups(
    files: DataFrame,
    keys: Sequence[str],
    preferred_paths: Sequence[str] = (),
    newest_points: int = NEWEST_POINTS,
    **weights: int,
) -> DataFrame:
    """One row per key with two or more files: keeper, newest file, counts, bytes.

    Score ties go to the smaller file_id, and so does "newest" among equal times.
    """
    base = base_score(preferred_paths, **weights)
    oldest = F.lit(-(2**62))
    age = -F.coalesce(F.unix_micros("modified_at"), oldest)
    return (
        files.groupBy(*keys)
        .agg(
            F.count("*").alias("member_count"),
            F.sum("size_bytes").alias("_bytes"),
            F.min(F.struct(age.alias("age"), F.col("file_id"), base.alias("base"))).alias("_newest"),
            F.min(F.struct((-base).alias("minus_base"), F.col("file_id"), F.col("size_bytes"))).alias("_best"),
        )
        .where(F.col("member_count") > 1)
        .select(*keys, "member_count", "_bytes", *_keeper_columns(newest_points))
    )


def exact_groups(
    files: DataFrame, min_size: int = 1024, preferred_paths: Sequence[str] = (), **weights: int
) -> DataFrame:
    """Duplicate groups: equal size, extension, quick hash and full hash.

    ``total_size`` is the size of one copy, as in the group table; ``space_wasted``
    is everything but the keeper.
    """
    eligible = files.where((F.col("size_bytes") >= min_size) & F.col("hash_full").isNotNull())
    groups = keeper_groups(eligible, EXACT, preferred_paths, **weights)
    return groups.select(
        stable_id(F.lit("exact"), "size_bytes", "extension", "hash_full").alias("group_id"),
        *EXACT,
        "canonical_file",
        "newest_file",
        "member_count",
        F.col("size_bytes").alias("total_size"),
        F.lit("exact").alias("similarity_type"),
        F.lit("exact").alias("detection_rule"),
        (F.col("_bytes") - F.col("size_bytes")).alias("space_wasted"),
    )


def exact_members(
    files: DataFrame,
    groups: DataFrame,
    preferred_paths: Sequence[str] = (),
    newest_points: int = NEWEST_POINTS,
    floor: int = HOT_ROWS_MIN,
    **weights: int,
) -> DataFrame:
    """Member rows of exact groups with their score and reason."""
    keyed = groups.select("group_id", "canonical_file", "newest_file", "member_count", *EXACT)
    rows = files.where(F.col("hash_full").isNotNull())
    joined = join_groups(rows, keyed, EXACT, "member_count", "file_id", floor=floor)
    newest = F.when(F.col("file_id") == F.col("newest_file"), newest_points).otherwise(0)
    keeper = F.col("file_id") == F.col("canonical_file")
    return joined.select(
        "group_id",
        "file_id",
        (base_score(preferred_paths, **weights) + newest).cast("long").alias("priority_score"),
        F.when(keeper, "Canonical copy").otherwise("Duplicate").alias("reason"),
        keeper.alias("is_canonical"),
    )


def with_duplicate_flags(files: DataFrame, members: DataFrame) -> DataFrame:
    """is_duplicate (in any group, keeper included), duplicate_group, is_canonical.

    A file in several groups takes the largest group id.
    """
    per_file = members.groupBy("file_id").agg(
        F.max("group_id").alias("duplicate_group"), F.max("is_canonical").alias("is_canonical")
    )
    kept = files.drop("is_duplicate", "duplicate_group", "is_canonical")
    return (
        kept.join(per_file, "file_id", "left")
        .withColumn("is_duplicate", F.col("duplicate_group").isNotNull())
        .withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)))
    )


def session_groups(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Groups whose keeper is among ``files`` (session scoping), keeper path added."""
    keepers = files.select(F.col("file_id").alias("canonical_file"), F.col("path").alias("canonical_path"))
    return groups.join(keepers, "canonical_file")


def redundant_copies(files: DataFrame, members: DataFrame) -> DataFrame:
    """Member files other than the keeper, with their group."""
    extra = members.where(~F.col("is_canonical")).select("group_id", "file_id")
    return files.join(extra, "file_id")


def duplication_metrics(groups: DataFrame) -> DataFrame:
    """Sets, redundant files and wasted bytes by similarity type."""
    return groups.groupBy("similarity_type").agg(
        F.count("*").alias("duplicate_sets"),
        F.sum(F.col("member_count") - 1).alias("total_duplicate_files"),
        F.sum((F.col("member_count") - 1) * F.col("total_size")).alias("wasted_space"),
    )


def consolidate(
    files: DataFrame, hash_col: str = "content_hash", priority_col: str = "priority", floor: int = HOT_ROWS_MIN
) -> DataFrame:
    """One keeper per content hash: highest source priority, then path.

    Every other copy names the keeper in ``duplicate_of``.
    """
    keepers = files.groupBy(hash_col).agg(
        F.count("*").alias("_copies"),
        F.min(F.struct((-F.col(priority_col)).alias("p"), F.col("path"))).getField("path").alias("_keeper"),
    )
    joined = join_groups(files, keepers, [hash_col], "_copies", "path", floor=floor)
    original = F.col("path") == F.col("_keeper")
    return joined.withColumn("is_original", original).withColumn(
        "duplicate_of", F.when(~original, F.col("_keeper"))
    ).drop("_copies", "_keeper")


def consolidation_counts(consolidated: DataFrame) -> DataFrame:
    """Scanned, unique and duplicate totals."""
    return consolidated.agg(
        F.count("*").alias("scanned"),
        F.count_if("is_original").alias("unique_files"),
        F.count_if(~F.col("is_original")).alias("duplicates"),
    )


def keeper_by_root(files: DataFrame, default_priority: int = 50) -> DataFrame:
    """Keeper per hash across roots: root priority, newest, longest stem, file_id."""
    order = F.struct(
        (-F.coalesce(F.col("root_priority"), F.lit(default_priority))).alias("a"),
        (-F.coalesce(F.unix_micros("modified_at"), F.lit(-(2**62)))).alias("b"),
        (-F.length(paths.stem(F.col("path")))).alias("c"),
        F.col("file_id").alias("d"),
    )
    return (
        files.groupBy("hash_quick")
        .agg(F.count("*").alias("copies"), F.min_by(F.struct("file_id", "path", "root_id"), order).alias("k"))
        .where(F.col("copies") > 1)
        .select("hash_quick", "copies", F.col("k.file_id").alias("canonical_file"),
                F.col("k.path").alias("canonical_path"), F.col("k.root_id").alias("root_id"))
    )


def duplicate_summary(registry: DataFrame) -> DataFrame:
    """Hash groups with several copies; both waste formulas."""
    groups = (
        registry.where(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"), F.max("file_size").alias("largest"))
        .where(F.col("n") > 1)
    )
    return groups.agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_duplicates"),
        F.coalesce(F.sum(F.col("bytes") * (F.col("n") - 1)), F.lit(0)).alias("wasted_space"),
        F.coalesce(F.sum(F.col("bytes") - F.col("largest")), F.lit(0)).alias("reclaimable_bytes"),
    )
