"""Accuracy, stability, drift and feedback metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.scale import top_per_group, top_rows
from shelfmark.operators.flags import clock


def _rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(empty)), 6)


def accuracy(registry: DataFrame, corrections: DataFrame) -> DataFrame:
    """(classified - corrections) / classified, every correction counted."""
    n_corrections = corrections.agg(F.count("*").alias("n")).scalar()
    counted = registry.agg(F.count_if(F.col("classification_method").isNotNull()).alias("total_classified"))
    return counted.select(
        "total_classified",
        n_corrections.alias("total_corrections"),
        _rate(F.col("total_classified") - n_corrections, F.col("total_classified")).alias("accuracy"),
    )


def common_errors(corrections: DataFrame, n: int = 10) -> DataFrame:
    grouped = corrections.groupBy("wrong_type").agg(F.count("*").alias("count"))
    return top_rows(grouped, [F.desc("count"), F.asc("wrong_type")], n)


def accuracy_distinct(registry: DataFrame, corrections: DataFrame) -> DataFrame:
    """Accuracy with each corrected file counted once."""
    corrected = corrections.agg(F.count_distinct("file_id").alias("n")).scalar()
    return registry.agg(F.count_if(F.col("document_type").isNotNull()).alias("classified")).select(
        "classified", corrected.alias("corrected_files"),
        _rate(F.col("classified") - corrected, F.col("classified")).alias("accuracy"),
    )


def _corrected_ids(corrections: DataFrame) -> DataFrame:
    return corrections.select("file_id").distinct().withColumn("_corrected", F.lit(True))


def category_accuracy(registry: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per type: files, corrected files, accuracy, average confidence."""
    corrected = F.count_if(F.coalesce("_corrected", F.lit(False)))
    return (
        registry.where(F.col("document_type").isNotNull())
        .select("file_id", "document_type", "confidence")
        .join(_corrected_ids(corrections), "file_id", "left")
        .groupBy("document_type")
        .agg(
            F.count("*").alias("total"),
            corrected.alias("corrected"),
            _rate(F.count("*") - corrected, F.count("*")).alias("accuracy"),
            F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        )
    )


def row_accuracy(registry: DataFrame, planned: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per file: lies where the rules put it, was never corrected, is not flagged.

    ``planned`` holds (file_id, target_path) of the current rules.
    """
    return (
        registry.select("file_id", "canonical_path", "requires_review")
        .join(planned.select("file_id", "target_path"), "file_id", "left")
        .join(_corrected_ids(corrections), "file_id", "left")
        .select(
            "file_id",
            (
                F.col("canonical_path").eqNullSafe(F.col("target_path"))
                & F.col("_corrected").isNull()
                & ~F.coalesce("requires_review", F.lit(False))
            ).alias("is_accurate"),
        )
    )


def stability(registry: DataFrame) -> DataFrame:
    """1 - moved-several-times / organised; 1 when nothing is organised."""
    organised = F.col("canonical_state") == "organized"
    return registry.agg(
        F.round(F.coalesce(F.avg(F.when(organised, F.col("move_count"))), F.lit(0.0)), 6).alias("avg_moves_per_file"),
        F.count_if(F.col("move_count") > 1).alias("files_moved_multiple_times"),
        F.count_if(organised).alias("total_organized"),
        _rate(
            F.count_if(organised) - F.count_if(F.col("move_count") > 1), F.count_if(organised), 1.0
        ).alias("stability"),
    )


def dedup_rate(registry: DataFrame) -> DataFrame:
    dup = F.count_if("is_duplicate")
    return registry.agg(
        F.count("*").alias("total_files"),
        dup.alias("duplicate_files"),
        (F.count("*") - dup).alias("unique_files"),
        _rate(dup, F.count("*")).alias("deduplication_rate"),
    )


def metrics_snapshot(registry: DataFrame, corrections: DataFrame, snapshot_date: str) -> DataFrame:
    """One row per metric: date, type, value and the whole detail as JSON."""
    def snap(kind: str, df: DataFrame, value: str) -> DataFrame:
        return df.select(
            F.lit(snapshot_date).cast("date").alias("snapshot_date"),
            F.lit(kind).alias("metric_type"),
            F.col(value).alias("metric_value"),
            F.to_json(F.struct(*df.columns)).alias("metric_data"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            snap("classification", accuracy(registry, corrections), "accuracy"),
            snap("stability", stability(registry), "stability"),
            snap("deduplication", dedup_rate(registry), "deduplication_rate"),
        ],
    )


def store_statistics(
    documents: DataFrame, predictions: DataFrame, feedback: DataFrame, categories: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Counts of the training store and the accuracy of its latest session."""
    def one(df: DataFrame, agg: Column) -> Column:
        return df.agg(agg.alias("v")).scalar()

    totals = documents.agg(F.count("*").alias("total_documents"))
    return totals.select(
        "total_documents",
        one(predictions, F.count("*")).alias("total_predictions"),
        one(feedback, F.count("*")).alias("total_feedback"),
        one(feedback, F.count_if("was_correct")).alias("correct_predictions"),
        one(feedback, F.count_if(~F.col("was_correct"))).alias("corrected_predictions"),
        one(categories, F.count_if("is_active")).alias("active_categories"),
        one(sessions, F.count("*")).alias("training_sessions"),
        one(sessions, F.max_by("accuracy", "session_id")).alias("latest_accuracy"),
    )


def retrain_trigger(
    feedback: DataFrame,
    as_of=None,
    min_incorrect: int = 100,
    min_documents: int = 50,
    min_age_days: int = 7,
    min_entries: int = 20,
) -> DataFrame:
    """Should the model be retrained, and why."""
    stats = feedback.where(~F.coalesce("processed", F.lit(False))).agg(
        F.count("*").alias("total_feedback"),
        F.count_if(~F.col("was_correct")).alias("incorrect_count"),
        F.count_distinct("document_id").alias("unique_docs"),
        F.coalesce(F.floor(paths.age_days(F.min("feedback_timestamp"), clock(as_of))), F.lit(0)).alias("feedback_age_days"),
    )
    many = F.when(
        F.col("incorrect_count") >= min_incorrect,
        F.concat(F.lit("High incorrect count: "), F.col("incorrect_count").cast("string")),
    )
    wide = F.when(
        F.col("unique_docs") >= min_documents,
        F.concat(F.lit("Sufficient unique feedback: "), F.col("unique_docs").cast("string")),
    )
    old = F.when(
        (F.col("feedback_age_days") >= min_age_days) & (F.col("total_feedback") >= min_entries),
        F.concat(F.lit("Feedback aged "), F.col("feedback_age_days").cast("string"), F.lit(" days with "),
                 F.col("total_feedback").cast("string"), F.lit(" entries")),
    )
    reasons = F.array_compact(F.array(many, wide, old))
    return stats.withColumn("should_retrain", F.size(reasons) > 0).withColumn("reasons", F.array_join(reasons, "; "))


def low_confidence_types(registry: DataFrame, threshold: float = 0.7, min_count: int = 3) -> DataFrame:
    return (
        registry.where(F.col("confidence") < threshold)
        .groupBy("document_type")
        .agg(
            F.count("*").alias("count"),
            F.round(F.avg("confidence"), 6).alias("avg_confidence"),
            F.min("confidence").alias("min_confidence"),
        )
        .where(F.col("count") >= min_count)
    )


def misclassification_hotspots(corrections: DataFrame, registry: DataFrame, min_count: int = 3) -> DataFrame:
    """(predicted, correct) pairs corrected at least ``min_count`` times."""
    return (
        corrections.select("file_id", "correct_type")
        .join(registry.select("file_id", F.col("document_type").alias("predicted_type")), "file_id")
        .groupBy("predicted_type", "correct_type")
        .agg(F.count("*").alias("error_count"))
        .where(F.col("error_count") >= min_count)
    )


def drift(registry: DataFrame, as_of=None, days: int = 7, min_change: float = 50.0) -> DataFrame:
    """Types whose count in the last ``days`` moved against the ``days`` before."""
    now = clock(as_of)
    recent_start, start = now - F.make_dt_interval(days=F.lit(days)), now - F.make_dt_interval(days=F.lit(2 * days))
    recent = F.count_if(F.col("created_at") > recent_start)
    previous = F.count_if(F.col("created_at") <= recent_start)
    return (
        registry.where(F.col("created_at") > start)
        .groupBy("document_type")
        .agg(recent.alias("recent"), previous.alias("previous"))
        .where(F.col("previous") > 0)
        .withColumn(
            "change_pct", F.round((F.col("recent") - F.col("previous")) / F.col("previous") * F.lit(100.0), 6)
        )
        .where(F.abs("change_pct") > min_change)
    )


def name_token_patterns(
    registry: DataFrame, top: int = 3, min_count: int = 5, years: tuple[str, ...] = ("2023", "2024", "2025")
) -> DataFrame:
    """Name marks that go with a document type, the strongest ``top`` per type."""
    low = F.lower("file_name")
    year = reduce(lambda a, b: a | b, [F.contains(low, F.lit(y)) for y in years])
    marks = F.array_compact(
        F.array(
            F.when(F.contains(low, F.lit("invoice")), F.lit("invoice_keyword")),
            F.when(F.contains(low, F.lit("receipt")), F.lit("receipt_keyword")),
            F.when(year, F.lit("year_in_name")),
            F.when(F.startswith(F.col("file_name"), F.lit("[")), F.lit("bracketed_prefix")),
        )
    )
    counted = (
        registry.select("document_type", F.explode(marks).alias("pattern"))
        .groupBy("document_type", "pattern")
        .agg(F.count("*").alias("frequency"))
    )
    ranked = top_per_group(counted, ["document_type"], [F.desc("frequency"), F.asc("pattern")], top)
    return ranked.where(F.col("frequency") >= min_count).drop("rank")


def hourly_counts(registry: DataFrame, as_of=None, days: int | None = 7) -> DataFrame:
    rows = registry
    if days is not None:
        rows = rows.where(F.col("created_at") > clock(as_of) - F.make_dt_interval(days=F.lit(days)))
    return rows.groupBy("document_type", paths.hour_key(F.col("created_at")).alias("hour")).agg(F.count("*").alias("count"))


def peak_hours(registry: DataFrame, as_of=None, days: int | None = 7) -> DataFrame:
    """Busiest hour per type (the earlier hour on ties)."""
    return hourly_counts(registry, as_of, days).groupBy("document_type").agg(
        F.max_by("hour", F.struct("count", (-F.col("hour").cast("int")))).alias("peak_hour"),
        F.max("count").alias("peak_count"),
    )


def reclassification_summary(changes: DataFrame) -> DataFrame:
    """Changed rows by old type, new type and reason, in one pass."""
    return (
        changes.groupingSets([["old_type"], ["new_type"], ["reason"]], "old_type", "new_type", "reason")
        .agg(F.count("*").alias("count"), F.grouping_id().alias("g"))
        .select(
            F.when(F.col("g") == 3, "old_type").when(F.col("g") == 5, "new_type").otherwise("reason").alias("dimension"),
            F.coalesce("old_type", "new_type", "reason").alias("key"),
            "count",
        )
    )


def reorganisation_check(plan: DataFrame, inventory: DataFrame, low_below: float = 0.70) -> DataFrame:
    """Existing and missing files per domain after a reorganisation."""
    present = inventory.select(F.col("path").alias("new_path")).distinct().withColumn("_found", F.lit(True))
    return (
        plan.join(present, "new_path", "left")
        .groupBy("domain", "document_type")
        .agg(
            F.count("*").alias("planned"),
            F.count_if(F.col("_found").isNotNull()).alias("existing"),
            F.count_if(F.col("_found").isNull()).alias("missing"),
            F.count_if(F.col("confidence") < low_below).alias("low_confidence"),
        )
    )


def correction_summary(corrections: DataFrame) -> DataFrame:
    """Corrections by old and by new type."""
    return (
        corrections.groupingSets([["wrong_type"], ["correct_type"]], "wrong_type", "correct_type")
        .agg(F.count("*").alias("count"), F.grouping("wrong_type").alias("g"))
        .select(
            F.when(F.col("g") == 0, "old_type").otherwise("new_type").alias("dimension"),
            F.coalesce("wrong_type", "correct_type").alias("key"),
            "count",
        )
    )


def corrections_with_registry(corrections: DataFrame, registry: DataFrame) -> DataFrame:
    """Corrections with the registered path; newest first when ordered by the caller."""
    return corrections.join(registry.select("file_id", "original_path", "document_type"), "file_id")


def class_distribution(registry: DataFrame, min_size: int = 5) -> DataFrame:
    """Rows per class and whether the class is large enough to learn."""
    return registry.where(F.col("document_type").isNotNull()).groupBy("document_type").agg(
        F.count("*").alias("count")
    ).withColumn("enough", F.col("count") >= min_size)
