"""Two-way sync decisions for a change feed against local state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import globs, paths

# Conflict policies.
LOCAL_WINS, REMOTE_WINS, NEWER_WINS, KEEP_BOTH = "local_wins", "remote_wins", "newer_wins", "keep_both"


def backup_path(path: Column) -> Column:
    """``dir/stem.local.ext``: where the local side of a kept-both conflict goes."""
    ext = paths.suffix_of_name(paths.name(path))
    return F.concat(F.left(path, F.length(path) - F.length(ext)), F.lit(".local"), ext)


def sync_decisions(
    changes: DataFrame,
    local: DataFrame,
    policy: str | Callable[[Column, Column], Column] = NEWER_WINS,
    max_size: int | None = None,
    exclude: Sequence[str] = (),
    include: Sequence[str] = (),
    delete_orphans: bool = False,
    dry_run: bool = False,
    keys: Sequence[str] = ("path",),
) -> DataFrame:
    """Decision per change: skip, delete, ignore, local_wins, keep_both or download.

    ``local`` has one row per path with ``local_modified``.  A conflict is a local file
    newer than the change; ``policy`` may be a column function of (remote, local) time.
    ``changes`` may be a stream (stream-static left join).
    """
    joined = changes.join(local.select(*keys, "local_modified"), list(keys), "left")
    exists = F.col("local_modified").isNotNull()
    selected = globs.sync_selected(F.col("path"), F.col("size"), max_size, exclude, include)
    conflict = exists & F.coalesce(F.col("local_modified") > F.col("modified_at"), F.lit(False))
    if callable(policy):
        resolution = policy(F.col("modified_at"), F.col("local_modified"))
    elif policy == NEWER_WINS:
        resolution = F.when(F.col("modified_at") > F.col("local_modified"), REMOTE_WINS).otherwise(LOCAL_WINS)
    else:
        resolution = F.lit(policy)
    deleted = F.when(F.lit(delete_orphans) & exists, "delete").otherwise("ignore")
    action = (
        F.when(~selected, "skip_filtered")
        .when(F.lit(dry_run), "skip_dry_run")
        .when(F.col("change_type") == "deleted", deleted)
        .when(conflict & (F.col("_resolution") == LOCAL_WINS), LOCAL_WINS)
        .when(conflict & (F.col("_resolution") == KEEP_BOTH), KEEP_BOTH)
        .otherwise("download")
    )
    return (
        joined.withColumn("_resolution", resolution)
        .withColumn("is_conflict", conflict)
        .withColumn("action", action)
        .withColumn("backup_path", F.when(F.col("action") == KEEP_BOTH, backup_path(F.col("path"))))
        .drop("_resolution")
    )


def push_decisions(local: DataFrame, remote: DataFrame, policy: str = NEWER_WINS, as_of: Column | None = None) -> DataFrame:
    """Decision per local file pushed to a remote tree."""
    joined = local.join(remote.select("path", "remote_modified"), "path", "left")
    conflict = F.coalesce(F.col("remote_modified") > F.col("local_modified"), F.lit(False))
    if policy == NEWER_WINS:
        # the source is the local file, so an older local file counts as local_wins
        resolution = F.when(F.col("local_modified") > F.col("remote_modified"), REMOTE_WINS).otherwise(LOCAL_WINS)
    else:
        resolution = F.lit(policy)
    stamp = F.date_format(as_of if as_of is not None else F.current_timestamp(), "yyyyMMddHHmmss")
    ext = paths.suffix_of_name(paths.name(F.col("path")))
    renamed = F.concat(F.left("path", F.length("path") - F.length(ext)), F.lit("."), stamp, ext)
    return (
        joined.withColumn("_resolution", resolution)
        .withColumn("is_conflict", conflict)
        .withColumn("action", F.when(conflict & (F.col("_resolution") == REMOTE_WINS), REMOTE_WINS).otherwise("upload"))
        .withColumn(
            "remote_path",
            F.when(conflict & (F.col("_resolution") == KEEP_BOTH), renamed).otherwise(F.col("path")),
        )
        .drop("_resolution")
    )


def sync_totals(decisions: DataFrame) -> DataFrame:
    """Scanned, transferred, skipped and conflicting changes, and bytes."""
    moved = F.col("action").isin("download", KEEP_BOTH)
    return decisions.agg(
        F.count("*").alias("files_scanned"),
        F.count_if(moved).alias("files_downloaded"),
        F.count_if(F.col("action").isin("skip_filtered", "skip_dry_run", LOCAL_WINS)).alias("files_skipped"),
        F.count_if(F.col("is_conflict") & F.col("action").isin(LOCAL_WINS, KEEP_BOTH)).alias("files_conflicted"),
        F.coalesce(F.sum(F.when(moved, F.coalesce("size", F.lit(0)))), F.lit(0)).alias("bytes_transferred"),
    )


def partial_state(changes: DataFrame) -> DataFrame:
    """``path, newest, changes`` of some changes; ``merge_states`` puts several such tables together."""
    renames = (F.col("change_type") == "renamed") & F.col("old_path").isNotNull()
    both = F.array(
        F.struct(
            F.col("path").alias("path"),
            F.when(renames, "created").otherwise(F.col("change_type")).alias("change_type"),
        ),
        F.struct(F.col("old_path").alias("path"), F.lit("deleted").alias("change_type")),
    )
    spread = changes.withColumn("_s", F.explode(F.when(renames, both).otherwise(F.slice(both, 1, 1))))
    newest = F.max(F.struct("modified_at", "event_id", F.col("_s.change_type").alias("change_type"), "size"))
    return spread.groupBy(F.col("_s.path").alias("path")).agg(newest.alias("newest"), F.count("*").alias("changes"))


def merge_states(partials: DataFrame) -> DataFrame:
    """One ``path, newest, changes`` row per path from many."""
    return partials.groupBy("path").agg(F.max("newest").alias("newest"), F.sum("changes").alias("changes"))


def _state(partials: DataFrame) -> DataFrame:
    return partials.select(
        "path", F.col("newest.change_type").alias("last_change"), F.col("newest.size").alias("size"),
        F.col("newest.modified_at").alias("modified_at"), (F.col("newest.change_type") != "deleted").alias("exists"), "changes",
    )


def latest_state(changes: DataFrame) -> DataFrame:
    """Latest state per path; a rename is a delete of the old and a create of the new path."""
    return _state(partial_state(changes))


def state_of(partials: DataFrame) -> DataFrame:
    """Latest state per path from the partial states of many batches."""
    return _state(merge_states(partials))
