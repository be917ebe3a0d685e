"""Row predicates and flags over catalog and registry rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import rule_tables as tables
from shelfmark.functions.globs import matches_any
from shelfmark.functions.scale import join_groups


def clock(as_of: str | Column | None) -> Column:
    """The explicit clock of a time-relative operator; defaults to now."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def in_session(df: DataFrame, session_id: str) -> DataFrame:
    """Rows of one scan session (prunes when the table is partitioned by session)."""
    return df.where(F.col("scan_session_id") == session_id)


def exact_candidates(files: DataFrame, min_size: int = 1) -> DataFrame:
    return files.where(F.col("size_bytes") >= min_size)


def fuzzy_candidates(files: DataFrame, min_size: int = 1024) -> DataFrame:
    """Files not already in an exact group and large enough to compare by name."""
    unflagged = ~F.coalesce(F.col("is_duplicate"), F.lit(False))
    return files.where(unflagged & (F.col("size_bytes") >= min_size))


def with_stale_flag(
    files: DataFrame,
    days: int = 365,
    as_of: str | Column | None = None,
    max_size: int | None = None,
    extensions: Sequence[str] | None = None,
) -> DataFrame:
    """is_orphaned: not accessed for ``days``; optional size and extension criteria."""
    stale = F.col("accessed_at") < clock(as_of) - F.make_dt_interval(days=F.lit(days))
    if max_size is not None:
        stale = stale & (F.col("size_bytes") < max_size)
    if extensions is not None:
        stale = stale & F.lower("extension").isin(*extensions)
    return files.withColumn("is_orphaned", F.coalesce(stale, F.lit(False)))


def with_temp_flag(files: DataFrame, suffixes: Sequence[str] = tables.TEMP_SUFFIXES) -> DataFrame:
    """is_temp: extension on the list, or the name ends with one of them."""
    body = "|".join(s.lstrip(".") for s in suffixes)
    by_name = F.lower("name").rlike(rf"\.({body})$")
    by_ext = F.coalesce(F.lower("extension").isin(*suffixes), F.lit(False))
    return files.withColumn("is_temp", by_name | by_ext)


def with_low_value_flag(files: DataFrame, age_days: int = 90, as_of: str | Column | None = None) -> DataFrame:
    """is_low_value with its reason: cache path, log file, older than ``age_days``."""
    relative = F.ltrim(F.col("path"), F.lit("/"))
    old = F.col("modified_at") < clock(as_of) - F.make_dt_interval(days=F.lit(age_days))
    cache = matches_any(relative, tables.LOW_VALUE_CACHE_GLOBS, False)
    log = matches_any(relative, tables.LOW_VALUE_LOG_GLOBS, False)
    reason = F.when(cache & old, "cache").when(log & old, "log")
    return files.withColumn("low_value_reason", reason).withColumn("is_low_value", reason.isNotNull())


def classify_candidates(files: DataFrame, min_size: int = 0, extensions: Sequence[str] | None = None) -> DataFrame:
    """Files worth sending to a classifier."""
    keep = F.col("size_bytes") >= min_size
    if extensions:
        keep = keep & F.lower("extension").isin(*extensions)
    return files.where(keep)


def is_movable(exclude: str = "members") -> Column:
    """Not temporary, not stale, no duplicate.

    ``exclude="members"`` leaves out whole duplicate groups (keeper included);
    ``"non_canonical"`` keeps each group's keeper.
    """
    duplicate = F.coalesce(F.col("is_duplicate"), F.lit(False))
    if exclude == "non_canonical":
        duplicate = duplicate & ~F.coalesce(F.col("is_canonical"), F.lit(False))
    return ~duplicate & ~F.col("is_orphaned") & ~F.col("is_temp")


def movable(files: DataFrame, exclude: str = "members") -> DataFrame:
    """Files a plan may move."""
    return files.where(is_movable(exclude))


def placeholder_decision(status: Column, behavior: str | Column, error: Column | None = None) -> Column:
    """struct(should_process, reason) for online-only files."""
    mode = F.lit(behavior) if isinstance(behavior, str) else behavior
    detail = F.coalesce(error, F.lit("unknown")) if error is not None else F.lit("unknown")

    def answer(ok: bool, reason: Column) -> Column:
        return F.struct(F.lit(ok).alias("should_process"), reason.alias("reason"))

    return (
        F.when(status == "error", answer(False, F.concat(F.lit("Error: "), detail)))
        .when(status != "online_only", answer(True, F.lit("File is available")))
        .when(mode == "skip", answer(False, F.lit("Skipping online-only file")))
        .when(mode == "download", answer(True, F.lit("Download requested")))
        .when(mode == "warn", answer(True, F.lit("Processing with warning")))
        .otherwise(answer(False, F.lit("Unknown behavior")))
    )


def unorganised(path: Column) -> Column:
    """Documents still waiting in an inbox or review folder."""
    return path.ilike("%Inbox%") | path.ilike("%To_Review%")


def trainable(registry: DataFrame, min_confidence: float = 0.70, min_per_type: int = 5) -> DataFrame:
    """Confident, known-type rows whose type has enough examples."""
    rows = registry.where(
        F.col("document_type").isNotNull()
        & (F.col("document_type") != "unknown")
        & (F.col("confidence") >= min_confidence)
    )
    types = rows.groupBy("document_type").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_per_type)
    # a shuffle by type would gather the texts of a type in one task
    return join_groups(rows, types, ["document_type"], "_n", "file_id").select(*registry.columns)
