"""Registry state changes: new snapshot = f(old snapshot, changes).

Tables are immutable; every function returns the next version (or the rows to append)
and the caller writes it to a new path with ``sources.tabular.write_snapshot``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.hashing import stable_id
from shelfmark.functions.rule_tables import FUNCTION_FOLDERS
from shelfmark.functions.scale import HOT_ROWS_MIN, join_groups
from shelfmark.operators.flags import clock


def one_per_key(rows: DataFrame, key: str, order: Sequence[str] = (), first: bool = False) -> DataFrame:
    """One row per key: the last in the order of ``order``, then of the whole row; or the first.

    Rows without a key are not merged.  Reduced by one aggregation with map-side partials.
    """
    rest = [c for c in rows.columns if c not in (key, *order)]
    # maps and other values without an order cannot rank rows; they only travel along
    sortable = [c for c in rest if not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]
    rank = F.struct(*[F.col(c) for c in (*order, *sortable)]) if order or sortable else F.lit(0)
    pick = F.min_by if first else F.max_by
    keyed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*rows.columns), rank).alias("_row")).select("_row.*")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def apply_changes(current: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Take ``columns`` from ``changes`` where the key occurs there, else keep them.

    Of several changes of a key the last in the order of ``order`` counts.
    """
    renamed = changes.select(key, *[c for c in order if c != key and c not in columns], *columns)
    renamed = one_per_key(renamed, key, order).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns]).withColumn("_hit", F.lit(True))
    joined = current.join(renamed, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return joined.drop("_hit", *[f"_new_{c}" for c in columns])


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Insert or replace by key; of several incoming rows the last in the order of ``order`` counts."""
    once = one_per_key(incoming, key, order)
    return current.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def insert_absent(current: DataFrame, incoming: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Insert rows whose key is new; existing rows win, then the first incoming row in the order of ``order``."""
    fresh = one_per_key(incoming, key, order, first=True).join(current.select(key), key, "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def register_batch(incoming: DataFrame, registry: DataFrame, floor: int = HOT_ROWS_MIN) -> DataFrame:
    """Pending rows for new content, duplicate rows for content already known, error rows for unreadable files.

    ``incoming``: original_path, content_hash, file_size.  Known means registered
    before or earlier (by path) in this batch; a file that comes a second time with the
    same content is a duplicate like any other.  Registry and batch are both reduced to
    one row per hash before they meet.  Rows without a hash get the state ``error``.
    """
    incoming = incoming.withColumn("file_id", stable_id("original_path", "content_hash"))
    # one file delivered twice in a batch is one row
    rows = incoming.where(F.col("content_hash").isNotNull()).dropDuplicates(["file_id"])
    batch = rows.groupBy("content_hash").agg(
        F.count("*").alias("_copies"),
        F.min(F.struct("original_path", "file_id")).getField("file_id").alias("_first"),
    )
    # the registered original owns its content, not one of its registered duplicates
    copy = F.coalesce("is_duplicate", F.lit(False)) if "is_duplicate" in registry.columns else F.lit(False)
    known = registry.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(
        F.min(F.struct(copy.alias("copy"), F.col("file_id").cast("string").alias("id"))).getField("id").alias("_known")
    )
    owners = batch.join(known, "content_hash", "left")
    joined = join_groups(rows, owners, ["content_hash"], "_copies", "file_id", floor=floor)
    duplicate = F.col("_known").isNotNull() | (F.col("file_id") != F.col("_first"))
    done = joined.select(
        "file_id",
        "original_path",
        "content_hash",
        "file_size",
        F.when(duplicate, "duplicate").otherwise("pending").alias("canonical_state"),
        duplicate.alias("is_duplicate"),
        F.when(duplicate, F.coalesce("_known", "_first")).alias("duplicate_of"),
    )
    none = F.lit(None).cast("string")
    failed = incoming.where(F.col("content_hash").isNull()).select(
        "file_id", "original_path", "content_hash", "file_size", F.lit("error").alias("canonical_state"), F.lit(False).alias("is_duplicate"), none.alias("duplicate_of")
    )
    return done.unionByName(failed)


def registration_summary(registered: DataFrame) -> DataFrame:
    return registered.agg(
        F.count("*").alias("scanned"),
        F.count_if(~F.col("is_duplicate") & (F.col("canonical_state") != "error")).alias("registered"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("canonical_state") == "error").alias("errors"),
    )


def add_by_path(inbox: DataFrame, documents: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Inbox rows whose path is not stored yet, one per path (the first of its rows)."""
    return one_per_key(inbox, path_col, first=True).join(documents.select(path_col), path_col, "left_anti")


def add_documents(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored rows for every incoming path: the existing row, else the new one."""
    found = documents.join(incoming.select("file_path").distinct(), "file_path", "left_semi")
    return found.unionByName(add_by_path(incoming, documents), allowMissingColumns=True)


def register_canonical(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files of an already organised tree whose content is unseen."""
    first = files.groupBy("content_hash").agg(F.min(F.struct("path", "file_size")).alias("f"))
    fresh = first.join(registry.select("content_hash"), "content_hash", "left_anti")
    return fresh.select(
        stable_id("f.path", "content_hash").alias("file_id"),
        F.col("f.path").alias("original_path"),
        F.col("f.path").alias("canonical_path"),
        "content_hash",
        F.col("f.file_size").alias("file_size"),
        F.lit("organized").alias("canonical_state"),
    )


def mark_classified(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Type, confidence, method and review flag; state becomes classified."""
    changes = decisions.withColumn("canonical_state", F.lit("classified"))
    columns = ["document_type", "confidence", "classification_method", "requires_review", "canonical_state"]
    return apply_changes(registry, changes, "file_id", columns)


def mark_organised(registry: DataFrame, plan: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(next registry, move_history rows) for planned (file_id, target_path).

    A file already at its target becomes organised without counting a move; of several
    plan rows of a file the one with the last target counts.
    """
    joined = registry.join(one_per_key(plan.select("file_id", "target_path"), "file_id"), "file_id", "left")
    planned = F.col("target_path").isNotNull()
    moved = planned & ~F.col("original_path").eqNullSafe(F.col("target_path"))
    nxt = (
        joined.withColumn("canonical_path", F.coalesce("target_path", "canonical_path"))
        .withColumn("canonical_state", F.when(planned, "organized").otherwise(F.col("canonical_state")))
        .withColumn("move_count", F.coalesce("move_count", F.lit(0)) + F.when(moved, 1).otherwise(0))
        .withColumn("last_moved", F.when(moved, clock(as_of)).otherwise(F.col("last_moved")))
        .drop("target_path")
    )
    history = joined.where(moved).select(
        "file_id",
        F.col("original_path").alias("from_path"),
        F.col("target_path").alias("to_path"),
        clock(as_of).alias("move_timestamp"),
        F.lit("initial_organization").alias("reason"),
    )
    return nxt, history


def correct_types(registry: DataFrame, corrections: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(next registry, correction log) for (path, correct_type[, corrected_at]) rows.

    A path may be the original or the canonical one; two equi joins find it.  Every
    correction is logged; the newest of a file sets its type (without ``corrected_at``
    the last by type, so that reruns agree).
    """
    at = F.col("corrected_at") if "corrected_at" in corrections.columns else F.lit(None).cast("timestamp")
    wanted = corrections.select("path", "correct_type", at.alias("corrected_at"))
    columns = ["file_id", "document_type", "correct_type", "corrected_at"]
    by_original = registry.join(wanted, registry.original_path == wanted.path).select(*columns)
    by_canonical = registry.join(wanted, registry.canonical_path == wanted.path).select(*columns)
    # the two joins may find the same row
    found = by_original.unionByName(by_canonical).distinct()
    log = found.select(
        "file_id", F.col("document_type").alias("wrong_type"), "correct_type", F.coalesce("corrected_at", clock(as_of)).alias("correction_timestamp")
    )
    newest = one_per_key(found.select("file_id", "corrected_at", "correct_type"), "file_id", ["corrected_at"])
    return set_types(registry, newest.select("file_id", F.col("correct_type").alias("document_type"))), log


def set_types(registry: DataFrame, typed: DataFrame, confidence: float = 1.0, method: str = "manual") -> DataFrame:
    """Set types by id as a person did: full confidence, review cleared."""
    changes = (
        typed.withColumn("confidence", F.lit(confidence))
        .withColumn("classification_method", F.lit(method))
        .withColumn("requires_review", F.lit(False))
    )
    return apply_changes(
        registry, changes, "file_id", ["document_type", "confidence", "classification_method", "requires_review"]
    )


def check_corrections(rows: DataFrame, known: Mapping[str, tuple] = FUNCTION_FOLDERS) -> tuple[DataFrame, DataFrame]:
    """(valid, errors) of reviewer rows; blank answers are left out of both."""
    filled = rows.where(F.btrim(F.coalesce(F.col("correct_type"), F.lit(""))) != "").withColumn(
        "correct_type", F.btrim("correct_type")
    )
    valid = F.col("correct_type").isin(*known)
    return filled.where(valid), filled.where(~valid).withColumn(
        "error", F.concat(F.lit("Invalid type: "), F.col("correct_type"))
    )


def upsert_classifications(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace classifications by id; probability maps stay typed maps."""
    return upsert(current, incoming, "classification_id")


def predictions_to_append(results: DataFrame, model_version: str, as_of=None) -> DataFrame:
    """Prediction rows with the probabilities as JSON, largest first, top five."""
    ranked = F.slice(
        F.array_sort(
            F.map_entries("probabilities"),
            lambda a, b: F.when(a["value"] > b["value"], -1)
            .when(a["value"] < b["value"], 1)
            .when(a["key"] < b["key"], -1)
            .when(a["key"] > b["key"], 1)
            .otherwise(0),
        ),
        1,
        5,
    )
    return results.select(
        stable_id("document_id", F.lit(model_version)).alias("prediction_id"),
        "document_id",
        "predicted_category",
        "confidence",
        F.to_json(F.map_from_entries(ranked)).alias("probabilities"),
        F.lit(model_version).alias("model_version"),
        clock(as_of).alias("prediction_timestamp"),
    )


def add_source(sources: DataFrame, source: Mapping[str, object]) -> DataFrame:
    """Next version of the sources with one more; an id that exists is replaced."""
    row = sources.sparkSession.createDataFrame([tuple(source.get(c) for c in sources.columns)], sources.schema)
    return upsert(sources, row, "source_id")


def scan_history_rows(counts: DataFrame, as_of=None) -> DataFrame:
    """History rows to append after a scan: one per source with what it found."""
    return counts.select(
        stable_id("source_id", clock(as_of).cast("string")).alias("scan_id"),
        "source_id",
        F.coalesce("new_files", F.lit(0)).alias("files_added"),
        F.coalesce("updated_files", F.lit(0)).alias("files_updated"),
        F.coalesce("deleted_files", F.lit(0)).alias("files_removed"),
        clock(as_of).alias("scanned_at"),
    )


def set_source_state(sources: DataFrame, source_id: str, active: bool) -> DataFrame:
    return sources.withColumn(
        "active", F.when(F.col("source_id") == source_id, F.lit(active)).otherwise(F.col("active"))
    )


def sources_with_counts(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources with their number of registered files (zero included)."""
    counts = registry.groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.join(counts, "source_id", "left").withColumn("file_count", F.coalesce("n", F.lit(0))).drop("n")


def feedback_rows(reviewed: DataFrame, as_of=None) -> DataFrame:
    """Feedback rows (was the prediction right) from reviewed predictions."""
    return reviewed.select(
        stable_id("document_id", "predicted_category", "correct_category").alias("feedback_id"),
        "document_id",
        "predicted_category",
        "correct_category",
        (F.col("predicted_category") == F.col("correct_category")).alias("was_correct"),
        clock(as_of).alias("feedback_timestamp"),
        F.lit(False).alias("processed"),
    )


def mark_processed(feedback: DataFrame, as_of=None) -> DataFrame:
    """Next feedback version with every open entry closed."""
    open_entry = ~F.coalesce("processed", F.lit(False))
    return feedback.withColumn(
        "processed_at", F.when(open_entry, clock(as_of)).otherwise(F.col("processed_at"))
    ).withColumn("processed", F.lit(True))


def mark_missing_and_moved(registry: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Apply a hash reconciliation: missing flags and externally moved paths."""
    status = reconciled.where(F.col("status") != "new").select("file_id", "status", "disk_path")
    return (
        registry.join(status, "file_id", "left")
        .withColumn("is_missing", F.coalesce(F.col("status") == "missing", F.lit(False)))
        .withColumn(
            "canonical_path",
            F.when(F.col("status") == "moved", F.col("disk_path")).otherwise(F.col("canonical_path")),
        )
        .drop("status", "disk_path")
    )
