"""Comparisons between roots, scans, and disk against catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scale import join_groups


def cross_root_duplicates(files: DataFrame, min_size: int = 0) -> DataFrame:
    """Contents present in several roots.

    Paths of a content stay in long form (``cross_root_copies``): the list for one
    popular content has no bound.
    """
    # (hash, root) first: the distinct count then runs over a few rows per hash
    per_root = (
        files.where(F.col("hash_quick").isNotNull() & (F.col("size_bytes") >= min_size))
        .groupBy("hash_quick", "root_id")
        .agg(F.count("*").alias("n"), F.min("size_bytes").alias("bytes"))
    )
    return (
        per_root.groupBy("hash_quick")
        .agg(
            F.count("*").alias("root_count"),
            F.sum("n").alias("total_copies"),
            F.array_join(F.array_sort(F.collect_list("root_id")), ",").alias("roots"),
            F.min("bytes").alias("size"),
        )
        .where(F.col("root_count") > 1)
    )


def cross_root_copies(files: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Every path of a content that lies in several roots."""
    contents = duplicates.select("hash_quick", "total_copies")
    rows = files.select("hash_quick", "root_id", "relative_path")
    return join_groups(rows, contents, ["hash_quick"], "total_copies", "relative_path").drop("total_copies")


def path_conflicts(files: DataFrame) -> DataFrame:
    """Relative paths that differ in content between roots.

    Rows are reduced to (path, content) and (path, root) by plain aggregations: counting
    both kinds of distinct values in one would hold every row several times.
    """
    known = files.where(F.col("hash_quick").isNotNull())
    versions = (
        known.groupBy("relative_path", "hash_quick")
        .agg(F.count("*").alias("n"))
        .groupBy("relative_path")
        .agg(F.count("*").alias("version_count"), F.sum("n").alias("copies"))
        .where(F.col("version_count") > 1)
    )
    # a missing root is none, as in a distinct count
    roots = (
        known.where(F.col("root_id").isNotNull())
        .groupBy("relative_path", "root_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("relative_path")
        .agg(F.count("*").alias("root_count"))
        .where(F.col("root_count") > 1)
    )
    same = F.col("v.relative_path").eqNullSafe(F.col("r.relative_path"))
    return versions.alias("v").join(roots.alias("r"), same).select("v.relative_path", "version_count", "root_count", "copies")


def path_state(files: DataFrame, root: str) -> DataFrame:
    """One row per relative path of a root: the largest hash stands for the path."""
    return files.where(F.col("root_id") == root).groupBy("relative_path").agg(F.max("hash_quick").alias("hash_quick"))


def compare_paths(files: DataFrame, root_a: str, root_b: str) -> DataFrame:
    """Status per relative path of two roots: identical, different, only_a, only_b."""
    a = path_state(files, root_a).select("relative_path", F.col("hash_quick").alias("hash_a"), F.lit(1).alias("in_a"))
    b = path_state(files, root_b).select("relative_path", F.col("hash_quick").alias("hash_b"), F.lit(1).alias("in_b"))
    status = (
        F.when(F.col("in_b").isNull(), "only_a")
        .when(F.col("in_a").isNull(), "only_b")
        .when(F.col("hash_a").eqNullSafe(F.col("hash_b")), "identical")
        .otherwise("different")
    )
    return a.join(b, "relative_path", "full_outer").select("relative_path", "hash_a", "hash_b", status.alias("status"))


def compare_roots(files: DataFrame, root_a: str, root_b: str) -> DataFrame:
    """Counts of a comparison and the sync score, 100 when both roots are empty."""
    def n(status: str):
        return F.count_if(F.col("status") == status)

    return compare_paths(files, root_a, root_b).agg(
        n("identical").alias("identical_files"),
        n("different").alias("files_different"),
        n("only_a").alias("files_only_a"),
        n("only_b").alias("files_only_b"),
        F.round(F.coalesce(F.try_divide(n("identical") * F.lit(100.0), F.count("*")), F.lit(100.0)), 2).alias("sync_score"),
    )


def audit_sync(comparisons: DataFrame, threshold: float = 95.0) -> DataFrame:
    """Comparisons below the threshold with a severity."""
    return comparisons.where(F.col("sync_score") < threshold).select(
        "*",
        F.when(F.col("sync_score") < 50, "critical").otherwise("warning").alias("severity"),
        (F.col("files_only_a") + F.col("files_only_b")).alias("missing_files"),
        F.col("files_different").alias("conflicts"),
    )


def reconcile(disk: DataFrame, registry: DataFrame) -> DataFrame:
    """Disk against registry: new, missing, moved or in_place, for every registry row.

    A registry row whose own path holds its content is in place; any other whose content
    lies somewhere on disk has moved to the smallest path no row of that content is at
    (else to the smallest of all); the rest is missing.  Content on disk that no row has
    is new, once per content.  Rows meet per (content, path) and then per content.
    """
    at = disk.where(F.col("content_hash").isNotNull()).groupBy("content_hash", F.col("path").alias("disk_path")).agg(F.lit(True).alias("_there"))
    rows = registry.where(F.col("content_hash").isNotNull()).select("content_hash", "file_id", "canonical_path")
    homes = rows.select("content_hash", F.col("canonical_path").alias("disk_path"), F.lit(True).alias("_taken")).distinct()
    spots = at.join(homes, ["content_hash", "disk_path"], "left")
    contents = spots.groupBy("content_hash").agg(
        F.min(F.when(F.col("_taken").isNull(), F.col("disk_path"))).alias("_free"), F.min("disk_path").alias("_any")
    )
    home = spots.where("_taken").select("content_hash", F.col("disk_path").alias("canonical_path"), F.lit(True).alias("_home"))
    placed = rows.join(home, ["content_hash", "canonical_path"], "left").join(contents, "content_hash", "left")
    status = F.when(F.col("_home"), "in_place").when(F.col("_any").isNotNull(), "moved").otherwise("missing")
    own = placed.select(
        "content_hash",
        "file_id",
        "canonical_path",
        F.when(F.col("_home"), F.col("canonical_path")).otherwise(F.coalesce("_free", "_any")).alias("disk_path"),
        status.alias("status"),
    )
    none = F.lit(None)
    new = contents.join(rows.select("content_hash"), "content_hash", "left_anti").select(
        "content_hash",
        none.cast(registry.schema["file_id"].dataType).alias("file_id"),
        none.cast("string").alias("canonical_path"),
        F.col("_any").alias("disk_path"),
        F.lit("new").alias("status"),
    )
    return own.unionByName(new)


def scan_difference(before: DataFrame, after: DataFrame, source_col: str = "source_id") -> DataFrame:
    """New, updated, deleted and unchanged files per source between two scans."""
    facts = ["content_hash", "size_bytes", "modified_at"]
    old = before.select(source_col, "path", F.struct(*facts).alias("old"))
    new = after.select(source_col, "path", F.struct(*facts).alias("new"))
    joined = old.join(new, [source_col, "path"], "full_outer")
    return joined.groupBy(source_col).agg(
        F.count_if(F.col("old").isNull()).alias("new_files"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias("updated_files"),
        F.count_if(F.col("new").isNull()).alias("deleted_files"),
        F.count_if(F.col("old").eqNullSafe(F.col("new"))).alias("unchanged_files"),
    )
