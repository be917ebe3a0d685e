"""Accuracy, stability, drift, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import organise, quality
from shelfmark.plans.fixtures import REGISTRY_CLOCK, Tables
from shelfmark.plans.registry import query
from shelfmark.session import shared_folder
from shelfmark.streaming import changes, inbox

NOW = f"TIMESTAMP '{REGISTRY_CLOCK}'"


@query("accuracy_metrics", "A25", """
    WITH c AS (SELECT count(*) AS n FROM fx_corrections)
    SELECT k AS total_classified, n AS total_corrections, round((k - n) / CAST(k AS DOUBLE), 6) AS accuracy FROM c,
    (SELECT count(classification_method) AS k FROM fx_registry)""")
def _(t: Tables):
    return quality.accuracy(t.registry, t.corrections)


@query("accuracy_common_errors", "A25", """
    SELECT wrong_type, count(*) AS count FROM fx_corrections GROUP BY 1 ORDER BY count DESC, wrong_type LIMIT 10""")
def _(t: Tables):
    return quality.common_errors(t.corrections)


@query("accuracy_distinct", "A26", """
    SELECT k AS classified, n AS corrected_files, round((k - n) / CAST(k AS DOUBLE), 6) AS accuracy FROM
    (SELECT count(DISTINCT file_id) AS n FROM fx_corrections), (SELECT count(document_type) AS k FROM fx_registry)""")
def _(t: Tables):
    return quality.accuracy_distinct(t.registry, t.corrections)


@query("category_accuracy", "A27 J8", """
    SELECT document_type, count(*) AS total, count(c.file_id) AS corrected,
           round((count(*) - count(c.file_id)) / CAST(count(*) AS DOUBLE), 6) AS accuracy,
           round(avg(confidence), 6) AS avg_confidence
    FROM fx_registry r LEFT JOIN (SELECT DISTINCT file_id FROM fx_corrections) c ON r.file_id = c.file_id
    WHERE document_type IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    return quality.category_accuracy(t.registry, t.corrections)


@query("row_accuracy", "C22", """
    SELECT r.file_id, r.canonical_path IS NOT NULL AND c.file_id IS NULL AND NOT requires_review AS is_accurate
    FROM fx_registry r LEFT JOIN (SELECT DISTINCT file_id FROM fx_corrections) c ON r.file_id = c.file_id""")
def _(t: Tables):
    # every organised row lies at /Canonical/General/<name>, which is where this plan puts it
    planned = t.registry.select("file_id", F.concat(F.lit("/Canonical/General/"), "file_name").alias("target_path"))
    return quality.row_accuracy(t.registry, planned, t.corrections)


@query("stability_metrics", "A28", """
    SELECT round(coalesce(avg(CASE WHEN canonical_state = 'organized' THEN move_count END), 0), 6) AS avg_moves_per_file,
           count(*) FILTER (move_count > 1) AS files_moved_multiple_times,
           count(*) FILTER (canonical_state = 'organized') AS total_organized,
           round((count(*) FILTER (canonical_state = 'organized') - count(*) FILTER (move_count > 1))
                 / CAST(count(*) FILTER (canonical_state = 'organized') AS DOUBLE), 6) AS stability FROM fx_registry""")
def _(t: Tables):
    return quality.stability(t.registry)


@query("dedup_rate", "A29", """
    SELECT count(*) AS total_files, count(*) FILTER (is_duplicate) AS duplicate_files,
           count(*) FILTER (NOT is_duplicate) AS unique_files,
           round(count(*) FILTER (is_duplicate) / CAST(count(*) AS DOUBLE), 6) AS deduplication_rate FROM fx_registry""")
def _(t: Tables):
    return quality.dedup_rate(t.registry_dups)


@query("metrics_snapshot", "A30", """
    SELECT DATE '2024-01-31' AS snapshot_date, 'deduplication' AS metric_type,
           round(count(*) FILTER (is_duplicate) / CAST(count(*) AS DOUBLE), 6) AS metric_value FROM fx_registry
    UNION ALL SELECT DATE '2024-01-31', 'classification', round((k - n) / CAST(k AS DOUBLE), 6) FROM
        (SELECT count(*) AS n FROM fx_corrections), (SELECT count(classification_method) AS k FROM fx_registry)
    UNION ALL SELECT DATE '2024-01-31', 'stability',
           round((count(*) FILTER (canonical_state = 'organized') - count(*) FILTER (move_count > 1))
                 / CAST(count(*) FILTER (canonical_state = 'organized') AS DOUBLE), 6) FROM fx_registry""")
def _(t: Tables):
    return quality.metrics_snapshot(t.registry_dups, t.corrections, "2024-01-31").drop("metric_data")


def feedback(t: Tables):
    return t.corrections.selectExpr("file_id document_id", "wrong_type predicted_category", "correct_type correct_category",
                                    "false was_correct", "correction_timestamp feedback_timestamp", "false processed")


@query("store_statistics", "A35", """
    SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM fx_registry WHERE document_type IS NOT NULL)
           AS total_predictions, (SELECT count(*) FROM fx_corrections) AS total_feedback, CAST(0 AS BIGINT) AS correct_predictions,
           (SELECT count(*) FROM fx_corrections) AS corrected_predictions,
           (SELECT count(DISTINCT document_type) FROM fx_registry) AS active_categories,
           (SELECT count(DISTINCT source_id) FROM fx_registry) AS training_sessions,
           (SELECT round(avg(confidence), 6) FROM fx_registry WHERE source_id = (SELECT max(source_id) FROM fx_registry))
           AS latest_accuracy""")
def _(t: Tables):
    predictions = t.registry.where("document_type is not null")
    categories = predictions.select("document_type").distinct().withColumn("is_active", F.lit(True))
    sessions = t.registry.groupBy(F.col("source_id").alias("session_id")).agg(F.round(F.avg("confidence"), 6).alias("accuracy"))
    return quality.store_statistics(t.base, predictions, feedback(t), categories, sessions)


TRIGGER = f"""
    SELECT n AS total_feedback, n AS incorrect_count, d AS unique_docs, age AS feedback_age_days,
           n >= 100 OR d >= 50 OR (age >= 7 AND n >= 20) AS should_retrain,
           concat_ws('; ', CASE WHEN n >= 100 THEN 'High incorrect count: ' || n END,
                     CASE WHEN d >= 50 THEN 'Sufficient unique feedback: ' || d END,
                     CASE WHEN age >= 7 AND n >= 20 THEN 'Feedback aged ' || age || ' days with ' || n || ' entries' END) AS reasons
    FROM (SELECT count(*) AS n, count(DISTINCT file_id) AS d,
                 CAST(floor(epoch({NOW} - min(correction_timestamp)) / 86400) AS BIGINT) AS age FROM fx_corrections)"""


@query("retrain_trigger", "A36", TRIGGER)
def _(t: Tables):
    return quality.retrain_trigger(feedback(t), REGISTRY_CLOCK)


@query("retrain_watch", "R8 A36", TRIGGER)
def _(t: Tables):
    """Feedback that arrives in three batches; the trigger is evaluated after each, and the last is what counts."""
    folder = shared_folder(t.spark, "feedback")
    arriving = feedback(t).withColumn("part", F.pmod(F.xxhash64("document_id"), F.lit(3)))
    arriving.write.partitionBy("part").parquet(f"{folder}/arriving")
    watch = inbox.retrain_watch(f"{folder}/store", f"{folder}/triggers", REGISTRY_CLOCK)
    for part in range(3):
        def run(batch, _, part=part):
            batch.write.mode("overwrite").parquet(f"{folder}/store/batch={part}")
            watch(batch, part)

        stream = t.spark.readStream.schema(feedback(t).schema).parquet(f"{folder}/arriving/part={part}")
        changes.run_to_end(stream, f"{folder}/checkpoint/{part}", run)
    return t.spark.read.schema(quality.retrain_trigger(feedback(t), REGISTRY_CLOCK).schema).json(f"{folder}/triggers/batch=2")


@query("low_confidence_types", "A37", """
    SELECT document_type, count(*) AS count, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence
    FROM fx_registry WHERE confidence < 0.7 GROUP BY 1 HAVING count(*) >= 3""")
def _(t: Tables):
    return quality.low_confidence_types(t.registry)


@query("misclass_hotspots", "A38 J9", """
    SELECT document_type AS predicted_type, correct_type, count(*) AS error_count
    FROM fx_corrections c JOIN fx_registry r ON c.file_id = r.file_id GROUP BY ALL HAVING count(*) >= 3""")
def _(t: Tables):
    return quality.misclassification_hotspots(t.corrections, t.registry)


@query("drift_7d", "A39 O1", f"""
    SELECT *, round((recent - previous) / CAST(previous AS DOUBLE) * 100.0, 6) AS change_pct FROM (
        SELECT document_type, count(*) FILTER (created_at > {NOW} - INTERVAL 7 DAY) AS recent,
               count(*) FILTER (created_at <= {NOW} - INTERVAL 7 DAY) AS previous FROM fx_registry
        WHERE created_at > {NOW} - INTERVAL 14 DAY GROUP BY 1) WHERE previous > 0
    AND abs((recent - previous) / CAST(previous AS DOUBLE) * 100.0) > 5""")
def _(t: Tables):
    return quality.drift(t.registry, REGISTRY_CLOCK, min_change=5.0)


@query("filename_tokens", "A40 W4", """
    WITH marks AS (SELECT document_type, unnest(list_filter([
        CASE WHEN contains(lower(file_name), 'invoice') THEN 'invoice_keyword' END,
        CASE WHEN contains(lower(file_name), 'receipt') THEN 'receipt_keyword' END,
        CASE WHEN contains(file_name, '2023') OR contains(file_name, '2024') OR contains(file_name, '2025') THEN 'year_in_name' END,
        CASE WHEN starts_with(file_name, '[') THEN 'bracketed_prefix' END], lambda x: x IS NOT NULL)) AS pattern FROM fx_registry)
    SELECT document_type, pattern, frequency FROM (
        SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY frequency DESC, pattern) AS rn FROM (
            SELECT document_type, pattern, count(*) AS frequency FROM marks GROUP BY ALL)) WHERE rn <= 3 AND frequency >= 5""")
def _(t: Tables):
    return quality.name_token_patterns(t.registry)


@query("hourly_counts", "A41", f"""
    SELECT document_type, strftime(created_at, '%H') AS hour, count(*) AS count FROM fx_registry
    WHERE created_at > {NOW} - INTERVAL 7 DAY GROUP BY ALL""")
def _(t: Tables):
    return quality.hourly_counts(t.registry, REGISTRY_CLOCK)


@query("hourly_peaks", "A41 Q10", f"""
    SELECT document_type, hour AS peak_hour, n AS peak_count FROM (
        SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY n DESC, hour) AS rn FROM (
            SELECT document_type, strftime(created_at, '%H') AS hour, count(*) AS n FROM fx_registry
            WHERE created_at > {NOW} - INTERVAL 7 DAY GROUP BY ALL)) WHERE rn = 1""")
def _(t: Tables):
    return quality.peak_hours(t.registry, REGISTRY_CLOCK)


@query("reclassify_summary", "A43", """
    SELECT 'old_type' AS dimension, wrong_type AS key, count(*) AS count FROM fx_corrections GROUP BY 2
    UNION ALL SELECT 'new_type', correct_type, count(*) FROM fx_corrections GROUP BY 2
    UNION ALL SELECT 'reason', wrong_type || '>' || correct_type, count(*) FROM fx_corrections GROUP BY 2""")
def _(t: Tables):
    changes = t.corrections.select(F.col("wrong_type").alias("old_type"), F.col("correct_type").alias("new_type"),
                                   F.concat_ws(">", "wrong_type", "correct_type").alias("reason"))
    return quality.reclassification_summary(changes)


@query("correction_summary", "A45", """
    SELECT 'old_type' AS dimension, wrong_type AS key, count(*) AS count FROM fx_corrections GROUP BY 2
    UNION ALL SELECT 'new_type', correct_type, count(*) FROM fx_corrections GROUP BY 2""")
def _(t: Tables):
    return quality.correction_summary(t.corrections)


@query("corrections_newest", "J7", """
    SELECT c.file_id, c.correct_type, r.original_path FROM fx_corrections c JOIN fx_registry r ON c.file_id = r.file_id
    ORDER BY c.correction_timestamp DESC, c.file_id LIMIT 50""")
def _(t: Tables):
    joined = quality.corrections_with_registry(t.corrections, t.registry)
    return joined.orderBy(F.desc("correction_timestamp"), "file_id").limit(50).select("file_id", "correct_type", "original_path")


@query("class_distribution", "A47", """
    SELECT document_type, count(*) AS count, count(*) >= 5 AS enough FROM fx_registry WHERE document_type IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    return quality.class_distribution(t.registry)


@query("reorganisation_check", "A44", """
    SELECT CASE document_type WHEN 'financial_invoice' THEN 'Financial' WHEN 'technical_manual' THEN 'Technical'
           WHEN 'unknown' THEN 'Review_Required' ELSE 'General' END AS domain, document_type, count(*) AS planned,
           count(*) FILTER (canonical_state = 'organized') AS existing, count(*) FILTER (canonical_state <> 'organized') AS missing,
           count(*) FILTER (confidence < 0.7) AS low_confidence
    FROM fx_registry WHERE document_type IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    docs = t.registry.where("document_type is not null").withColumn("file_path", F.col("original_path"))
    plan, _ = organise.function_plan(docs)
    # organised files are the ones found on disk after the run
    inventory = plan.where(F.col("canonical_state") == "organized").select(F.col("new_path").alias("path"))
    return quality.reorganisation_check(plan, inventory)
