"""Registry state changes, sources, feedback, training data joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import compare, models, transitions
from shelfmark.plans.fixtures import REGISTRY_CLOCK, Tables
from shelfmark.plans.registry import query
from shelfmark.plans.sync_queries import RECONCILED, reconciled

REGISTER = """WITH batch AS (SELECT path, hash_full AS h, size_bytes, sha256(concat_ws('|', path, hash_full)) AS id FROM fx_files
        WHERE access_count > 0),
    known AS (SELECT hash_full AS h, min(file_id) AS owner FROM fx_files WHERE access_count = 0 GROUP BY 1)
    SELECT id AS file_id, path AS original_path, b.h AS content_hash, size_bytes AS file_size,
           CASE WHEN owner IS NOT NULL OR n > 1 THEN 'duplicate' ELSE 'pending' END AS canonical_state,
           owner IS NOT NULL OR n > 1 AS is_duplicate,
           CASE WHEN owner IS NOT NULL OR n > 1 THEN coalesce(owner, first_id) END AS duplicate_of FROM (
        SELECT *, row_number() OVER w AS n, first_value(id) OVER w AS first_id FROM batch WINDOW w AS (PARTITION BY h ORDER BY path)) b
    LEFT JOIN known k ON b.h = k.h"""


def registered(t: Tables):
    """Files that were accessed arrive; files never accessed are registered already."""
    rows = t.files.select("file_id", F.col("path").alias("original_path"), F.col("hash_full").alias("content_hash"),
                          F.col("size_bytes").alias("file_size"), "access_count")
    return transitions.register_batch(rows.where("access_count > 0").drop("file_id"), rows.where("access_count = 0"))


@query("register_batch", "U1 D7 W6 S6", REGISTER)
def _(t: Tables):
    return registered(t)


@query("register_summary", "S6 A46", f"""
    SELECT count(*) AS scanned, count(*) FILTER (NOT is_duplicate) AS registered, count(*) FILTER (is_duplicate) AS duplicates,
           CAST(0 AS BIGINT) AS errors FROM ({REGISTER})""")
def _(t: Tables):
    return transitions.registration_summary(registered(t))


@query("register_canonical", "S18", """
    SELECT hash_full AS content_hash, min(path) AS original_path FROM fx_files WHERE access_count > 0 AND hash_full NOT IN (
        SELECT hash_full FROM fx_files WHERE access_count = 0) GROUP BY 1""")
def _(t: Tables):
    rows = t.files.select("path", F.col("hash_full").alias("content_hash"), F.col("size_bytes").alias("file_size"), "access_count")
    added = transitions.register_canonical(rows.where("access_count > 0"), rows.where("access_count = 0"))
    return added.select("content_hash", "original_path")


@query("inbox_add_absent", "S7 U11", """
    SELECT file_id, path AS file_path, text FROM fx_files WHERE path NOT IN (SELECT path FROM fx_files WHERE root_id = 'src1')""")
def _(t: Tables):
    rows = t.files.select("file_id", F.col("path").alias("file_path"), "text", "root_id")
    return transitions.add_by_path(rows, rows.where("root_id = 'src1'")).drop("root_id")


@query("add_documents", "U11", "SELECT path AS file_path, file_id, length(text) AS chars FROM fx_files")
def _(t: Tables):
    rows = t.files.select(F.col("path").alias("file_path"), "file_id", F.length("text").cast("long").alias("chars"), "root_id")
    return transitions.add_documents(rows.drop("root_id"), rows.where("root_id = 'src1'").drop("root_id"))


@query("mark_classified", "U2", """
    SELECT file_id, CASE WHEN canonical_state = 'pending' THEN 'medical' ELSE document_type END AS document_type,
           CASE WHEN canonical_state = 'pending' THEN 'classified' ELSE canonical_state END AS canonical_state FROM fx_registry""")
def _(t: Tables):
    decided = t.registry.where("canonical_state = 'pending'").selectExpr(
        "file_id", "'medical' document_type", "0.9d confidence", "'pattern' classification_method", "false requires_review")
    return transitions.mark_classified(t.registry, decided).select("file_id", "document_type", "canonical_state")


def plan_of(t: Tables):
    return t.registry.where("canonical_state <> 'organized'").select(
        "file_id", F.when(F.col("canonical_state") == "classified", F.concat(F.lit("/Canonical/"), "file_name"))
        .otherwise(F.col("original_path")).alias("target_path"))


def organised(t: Tables):
    return transitions.mark_organised(t.registry.withColumn("last_moved", F.lit(None).cast("timestamp")), plan_of(t), REGISTRY_CLOCK)


@query("mark_organised", "U3", """
    SELECT file_id, CASE canonical_state WHEN 'classified' THEN '/Canonical/' || file_name WHEN 'pending' THEN original_path
           ELSE canonical_path END AS canonical_path, 'organized' AS canonical_state,
           CASE WHEN canonical_state = 'classified' THEN move_count + 1 ELSE move_count END AS move_count FROM fx_registry""")
def _(t: Tables):
    return organised(t)[0].select("file_id", "canonical_path", "canonical_state", "move_count")


@query("mark_organised_repeated", "U3", """
    SELECT r.file_id, CASE canonical_state WHEN 'classified' THEN '/Canonical/' || file_name WHEN 'pending' THEN original_path
           ELSE canonical_path END AS canonical_path, CASE WHEN canonical_state = 'classified' THEN move_count + 1 ELSE move_count END AS move_count,
           CASE WHEN canonical_state = 'classified' THEN 1 ELSE 0 END AS moves FROM fx_registry r""")
def _(t: Tables):
    """Every file is planned three times, twice to the same place."""
    plan = plan_of(t)
    plan = plan.unionByName(plan).unionByName(plan.where("target_path is not null").withColumn("target_path", F.lit("!earlier")))
    registry = t.registry.withColumn("last_moved", F.lit(None).cast("timestamp"))
    after, history = transitions.mark_organised(registry, plan, REGISTRY_CLOCK)
    moves = history.groupBy("file_id").agg(F.count("*").cast("int").alias("moves"))
    return after.join(moves, "file_id", "left").select("file_id", "canonical_path", "move_count", F.coalesce("moves", F.lit(0)).alias("moves"))


@query("move_history", "U3", """
    SELECT file_id, original_path AS from_path, '/Canonical/' || file_name AS to_path, 'initial_organization' AS reason
    FROM fx_registry WHERE canonical_state = 'classified'""")
def _(t: Tables):
    return organised(t)[1].drop("move_timestamp")


def corrected(t: Tables):
    wanted = t.registry.where("document_type = 'unknown'").select(
        F.coalesce("canonical_path", "original_path").alias("path"), F.lit("medical").alias("correct_type"))
    return transitions.correct_types(t.registry, wanted, REGISTRY_CLOCK)


@query("correct_types", "U4 U5", """
    SELECT file_id, CASE WHEN document_type = 'unknown' THEN 'medical' ELSE document_type END AS document_type,
           CASE WHEN document_type = 'unknown' THEN CAST(1 AS DOUBLE) ELSE confidence END AS confidence,
           CASE WHEN document_type = 'unknown' THEN FALSE ELSE requires_review END AS requires_review FROM fx_registry""")
def _(t: Tables):
    return corrected(t)[0].select("file_id", "document_type", "confidence", "requires_review")


@query("correction_log", "U4", """
    SELECT file_id, 'unknown' AS wrong_type, 'medical' AS correct_type FROM fx_registry WHERE document_type = 'unknown'""")
def _(t: Tables):
    return corrected(t)[1].drop("correction_timestamp")


def answers(t: Tables):
    return t.registry.select("file_id", F.when(F.col("source_id") == "src1", "  ").when(F.col("source_id") == "src2", "no_such_type")
                             .otherwise(" medical ").alias("correct_type"))


@query("corrections_valid", "U6 S12", """
    SELECT file_id, 'medical' AS correct_type FROM fx_registry WHERE source_id NOT IN ('src1', 'src2')""")
def _(t: Tables):
    return transitions.check_corrections(answers(t))[0]


@query("corrections_invalid", "U6 J11", """
    SELECT file_id, 'no_such_type' AS correct_type, 'Invalid type: no_such_type' AS error FROM fx_registry WHERE source_id = 'src2'""")
def _(t: Tables):
    return transitions.check_corrections(answers(t))[1]


@query("upsert_classifications", "U7 O3", """
    SELECT 'd' || file_id AS classification_id, CASE WHEN canonical_state = 'pending' THEN 'medical' ELSE document_type END AS predicted_category
    FROM fx_registry WHERE canonical_state = 'pending' OR document_type IS NOT NULL""")
def _(t: Tables):
    rows = t.registry.selectExpr("concat('d', file_id) classification_id", "document_type predicted_category", "canonical_state")
    current = rows.where("predicted_category is not null").drop("canonical_state")
    incoming = rows.where("canonical_state = 'pending'").selectExpr("classification_id", "'medical' predicted_category")
    return transitions.upsert_classifications(current, incoming)


@query("insert_absent", "O3", """
    SELECT file_id, CASE WHEN document_type IS NOT NULL THEN 'old' ELSE 'new' END AS origin FROM fx_registry""")
def _(t: Tables):
    rows = t.registry.select("file_id", "document_type")
    current = rows.where("document_type is not null").select("file_id", F.lit("old").alias("origin"))
    return transitions.insert_absent(current, rows.select("file_id", F.lit("new").alias("origin")), "file_id")


@query("append_predictions", "U12 X22", """
    SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), 'v1')) AS prediction_id, doc_id AS document_id,
           '{"c":' || CAST(0.5 AS VARCHAR) || ',"b":' || CAST(0.25 AS VARCHAR) || ',"a":' || CAST(0.125 AS VARCHAR) || '}' AS probabilities
    FROM documents""")
def _(t: Tables):
    results = t.base.selectExpr("doc_id document_id", "'c' predicted_category", "0.5d confidence",
                                "map('a', 0.125d, 'b', 0.25d, 'c', 0.5d) probabilities")
    return transitions.predictions_to_append(results, "v1", REGISTRY_CLOCK).select("prediction_id", "document_id", "probabilities")



@query("source_counts", "J16 U8", """
    SELECT source_id, source_id <> 'src1' AS active, count(*) AS file_count FROM fx_registry GROUP BY 1
    UNION ALL SELECT 'empty', TRUE, CAST(0 AS BIGINT)""")
def _(t: Tables):
    sources = t.registry.select("source_id").distinct()
    every = sources.unionByName(sources.agg(F.lit("empty").alias("source_id"))).withColumn("active", F.lit(True))
    return transitions.sources_with_counts(transitions.set_source_state(every, "src1", False), t.registry)


def reviewed(t: Tables):
    return t.corrections.selectExpr("file_id document_id", "wrong_type predicted_category", "correct_type correct_category")


@query("feedback_rows", "U9", """
    SELECT file_id AS document_id, wrong_type AS predicted_category, correct_type AS correct_category, wrong_type = correct_type AS was_correct
    FROM fx_corrections""")
def _(t: Tables):
    return transitions.feedback_rows(reviewed(t), REGISTRY_CLOCK).select("document_id", "predicted_category", "correct_category", "was_correct")


@query("feedback_processed", "U9 M10", "SELECT file_id AS document_id, TRUE AS processed FROM fx_corrections")
def _(t: Tables):
    rows = transitions.feedback_rows(reviewed(t), REGISTRY_CLOCK).withColumn("processed_at", F.lit(None).cast("timestamp"))
    return transitions.mark_processed(rows, REGISTRY_CLOCK).select("document_id", "processed")


def history(t: Tables, latest: bool):
    documents = t.registry.select(F.col("file_id").alias("document_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    first = t.registry.where("document_type is not null").selectExpr(
        "file_id document_id", "document_type predicted_category", "confidence pred_confidence", "created_at prediction_timestamp")
    second = first.where("predicted_category = 'unknown'").withColumn("predicted_category", F.lit("tax_form")).withColumn(
        "prediction_timestamp", F.expr("prediction_timestamp + interval 1 hour"))
    feedback = t.corrections.selectExpr("file_id document_id", "correct_type correct_category", "false was_correct",
                                        "correction_timestamp feedback_timestamp")
    return models.document_history(documents, first.unionByName(second), feedback, latest)


@query("document_history", "J4", """
    SELECT r.file_id AS document_id, p.kind AS predicted_category, c.correct_type AS correct_category FROM fx_registry r
    LEFT JOIN (SELECT file_id, document_type AS kind FROM fx_registry WHERE document_type IS NOT NULL
               UNION ALL SELECT file_id, 'tax_form' FROM fx_registry WHERE document_type = 'unknown') p ON r.file_id = p.file_id
    LEFT JOIN fx_corrections c ON r.file_id = c.file_id""")
def _(t: Tables):
    return history(t, False).select("document_id", "predicted_category", "correct_category")


TRAINING = """SELECT r.file_id AS document_id, coalesce(c.correct_type, CASE WHEN document_type = 'unknown' THEN 'tax_form' ELSE document_type END)
    AS label, c.file_id IS NOT NULL AS was_corrected, coalesce(confidence, 0) AS confidence FROM fx_registry r
    LEFT JOIN fx_corrections c ON r.file_id = c.file_id"""


@query("training_set", "M1 W7 J4", f"SELECT document_id, label, was_corrected FROM ({TRAINING}) WHERE label IS NOT NULL AND confidence >= 0.2")
def _(t: Tables):
    return models.training_set(history(t, True), 0.2).select("document_id", "label", "was_corrected")


@query("retraining_rows", "M10 J9", """
    SELECT c.file_id AS document_id, correct_type AS label, length(text) AS chars FROM fx_corrections c JOIN fx_registry r ON c.file_id = r.file_id""")
def _(t: Tables):
    feedback = transitions.feedback_rows(reviewed(t), REGISTRY_CLOCK)
    rows = models.retraining_rows(feedback, t.base.select(F.col("doc_id").alias("document_id"), "text"))
    return rows.select("document_id", "label", F.length("text").cast("long").alias("chars"))


@query("text_features", "M2", """
    SELECT file_id, sha256(lower(file_name || ' ' || file_name || ' ' || file_name || ' ' || text)) AS features FROM fx_registry""")
def _(t: Tables):
    return models.with_text_features(t.registry).select("file_id", F.sha2("model_text", 256).alias("features"))


@query("missing_and_moved", "U10 J14", RECONCILED + """
    SELECT f.file_id, coalesce(p.status = 'missing', FALSE) AS is_missing,
           CASE WHEN p.status = 'moved' THEN p.disk_path ELSE f.canonical_path END AS canonical_path
    FROM fx_registry f LEFT JOIN placed p ON f.file_id = p.file_id""")
def _(t: Tables):
    return transitions.mark_missing_and_moved(t.registry, reconciled(t)).select("file_id", "is_missing", "canonical_path")




@query("register_again", "U1 D7", """
    SELECT canonical_state, count(*) AS files, count(DISTINCT duplicate_of) AS owners FROM (
        SELECT 'duplicate' AS canonical_state, o.owner AS duplicate_of FROM fx_files f
        JOIN (SELECT hash_full, min(file_id) AS owner FROM fx_files GROUP BY 1) o ON f.hash_full = o.hash_full) GROUP BY 1
    UNION ALL SELECT 'error', 1, 0""")
def _(t: Tables):
    """Every registered file is dropped a second time, and one that cannot be read."""
    rows = t.files.select("file_id", F.col("path").alias("original_path"), F.col("hash_full").alias("content_hash"), F.col("size_bytes").alias("file_size"))
    broken = t.spark.sql("SELECT '/broken' original_path, CAST(NULL AS STRING) content_hash, 0L file_size")
    again = transitions.register_batch(rows.drop("file_id").unionByName(broken), rows)
    return again.groupBy("canonical_state").agg(F.count("*").alias("files"), F.count_distinct("duplicate_of").alias("owners"))


def versions(t: Tables):
    """Many incoming rows a key: the files of each root, in the order of their ids."""
    return t.files.select("root_id", F.col("doc_id").alias("version"), F.col("name").alias("value"))


@query("upsert_repeated_keys", "O3 U7", """
    SELECT root_id, max(doc_id) AS version, arg_max(name, doc_id) AS value FROM fx_files GROUP BY 1
    UNION ALL SELECT 'kept', CAST(-1 AS BIGINT), 'old'""")
def _(t: Tables):
    current = t.spark.sql("SELECT 'src1' root_id, -1L version, 'old' value UNION ALL SELECT 'kept', -1L, 'old'")
    return transitions.upsert(current, versions(t), "root_id", ["version"])


@query("insert_repeated_keys", "O3 U11", """
    SELECT root_id, CASE root_id WHEN 'src1' THEN -1 ELSE min(doc_id) END AS version,
           CASE root_id WHEN 'src1' THEN 'old' ELSE arg_min(name, doc_id) END AS value FROM fx_files GROUP BY 1""")
def _(t: Tables):
    current = t.spark.sql("SELECT 'src1' root_id, -1L version, 'old' value")
    return transitions.insert_absent(current, versions(t), "root_id", ["version"])


@query("change_repeated_keys", "U2 U5 U6", """
    SELECT r.root_id, coalesce(n.value, 'unchanged') AS value FROM (SELECT DISTINCT root_id FROM fx_files) r
    LEFT JOIN (SELECT root_id, arg_max(name, doc_id) AS value FROM fx_files WHERE root_id <> 'src2' GROUP BY 1) n ON r.root_id = n.root_id""")
def _(t: Tables):
    current = t.files.select("root_id").distinct().withColumn("value", F.lit("unchanged"))
    return transitions.apply_changes(current, versions(t).where("root_id <> 'src2'"), "root_id", ["value"], ["version"])


def corrected_twice(t: Tables):
    unknown = t.registry.where("document_type = 'unknown'").select(F.coalesce("canonical_path", "original_path").alias("path"), "created_at")
    both = [unknown.select("path", F.lit(kind).alias("correct_type"), F.expr(f"created_at + INTERVAL {day} DAYS").alias("corrected_at"))
            for kind, day in (("technical_manual", 1), ("medical", 2))]
    return transitions.correct_types(t.registry, both[0].unionByName(both[1]), REGISTRY_CLOCK)


@query("correct_types_newest", "U4 U5", """
    SELECT file_id, CASE WHEN document_type = 'unknown' THEN 'medical' ELSE document_type END AS document_type FROM fx_registry""")
def _(t: Tables):
    return corrected_twice(t)[0].select("file_id", "document_type")


@query("correction_log_all", "U4", """
    SELECT file_id, 'unknown' AS wrong_type, kind AS correct_type FROM fx_registry, (VALUES ('technical_manual'), ('medical')) v(kind)
    WHERE document_type = 'unknown'""")
def _(t: Tables):
    return corrected_twice(t)[1].drop("correction_timestamp")


@query("source_history", "U8 J18", """
    SELECT source_id, count(*) FILTER (document_type IS NULL) AS files_added, CAST(0 AS BIGINT) AS files_updated,
           count(*) FILTER (document_type = 'unknown') AS files_removed, TIMESTAMP '2024-01-31 00:00:00' AS scanned_at
    FROM fx_registry GROUP BY 1""")
def _(t: Tables):
    rows = t.registry.selectExpr("source_id", "original_path path", "content_hash", "file_size size_bytes", "created_at modified_at", "document_type")
    found = compare.scan_difference(rows.where("document_type is not null"), rows.where("document_type is distinct from 'unknown'"))
    return transitions.scan_history_rows(found, REGISTRY_CLOCK).drop("scan_id")


@query("source_add", "U8", """
    SELECT source_id, active FROM (SELECT DISTINCT source_id, TRUE AS active FROM fx_registry) WHERE source_id <> 'src1'
    UNION ALL SELECT 'src1', FALSE UNION ALL SELECT 'usb', TRUE""")
def _(t: Tables):
    sources = t.registry.select("source_id").distinct().withColumn("active", F.lit(True))
    for source in ({"source_id": "usb", "active": True}, {"source_id": "src1", "active": False}):
        sources = transitions.add_source(sources, source)
    return sources
