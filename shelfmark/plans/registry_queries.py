"""Registry reports, look-ups, review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import flags, keyed, registry
from shelfmark.plans import rule_sql as rs
from shelfmark.plans.fixtures import Tables
from shelfmark.plans.registry import query
from shelfmark.operators.registry import LIKELY, SUGGESTIONS
from shelfmark.session import shared_folder


@query("registry_overview", "A15", """
    SELECT count(*) AS total_files, CAST(sum(file_size) AS BIGINT) AS total_size_bytes,
           count(*) FILTER (document_type <> 'unknown') AS classified, count(*) FILTER (document_type IS NULL) AS null_type,
           count(*) FILTER (document_type = 'unknown') AS unknown_type,
           round(count(*) FILTER (document_type <> 'unknown') / CAST(count(*) AS DOUBLE), 6) AS classification_rate FROM fx_registry""")
def _(t: Tables):
    return registry.overview(t.registry)


@query("registry_by_type", "A16", """
    SELECT coalesce(document_type, 'NULL') AS document_type, count(*) AS count, CAST(sum(file_size) AS BIGINT) AS total_size
    FROM fx_registry GROUP BY 1 ORDER BY count DESC, document_type LIMIT 50""")
def _(t: Tables):
    return registry.by_type(t.registry)


@query("registry_by_ext", "A17", """
    SELECT lower(substr(original_path, instr(original_path, '.') + 1)) AS extension, count(*) AS count,
           CAST(sum(file_size) AS BIGINT) AS total_size FROM fx_registry WHERE contains(original_path, '.')
    GROUP BY 1 ORDER BY count DESC, extension LIMIT 50""")
def _(t: Tables):
    return registry.by_path_extension(t.registry)


@query("registry_by_method", "A18", """
    SELECT classification_method AS method, count(*) AS count, round(avg(confidence), 6) AS avg_confidence FROM fx_registry
    WHERE classification_method IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    return registry.by_method(t.registry)


@query("registry_confidence_hist", "A19", """
    SELECT CASE WHEN confidence IS NULL THEN 'null' WHEN confidence >= 0.9 THEN 'very_high (90%+)' WHEN confidence >= 0.7
           THEN 'high (70-90%)' WHEN confidence >= 0.5 THEN 'medium (50-70%)' WHEN confidence >= 0.3 THEN 'low (30-50%)'
           ELSE 'very_low (<30%)' END AS bucket, count(*) AS count FROM fx_registry GROUP BY 1""")
def _(t: Tables):
    return registry.confidence_histogram(t.registry)


@query("registry_confidence_bands", "A20", """
    SELECT * FROM (SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.9 THEN 'Very High (>=90%)'
           WHEN confidence >= 0.75 THEN 'High (75-90%)' WHEN confidence >= 0.5 THEN 'Medium (50-75%)' WHEN confidence >= 0.25
           THEN 'Low (25-50%)' ELSE 'Very Low (<25%)' END AS conf_level, count(*) AS count,
           round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM fx_registry GROUP BY 1)
    WHERE conf_level <> 'none'""")
def _(t: Tables):
    return registry.confidence_bands(t.registry)


@query("registry_model_bands", "A21", """
    SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low'
           ELSE 'very_low' END AS confidence_bucket, count(*) AS count FROM fx_registry
    WHERE classification_method = 'ml_model' GROUP BY 1""")
def _(t: Tables):
    return registry.model_confidence_bands(t.registry)


def classifications(t: Tables):
    return t.registry.where("classification_method is not null").selectExpr(
        "concat('d', file_id) file_id", "classification_method model_name", "document_type predicted_category", "confidence")


CLASSIFICATIONS = """SELECT 'd' || file_id AS file_id, classification_method AS model_name, document_type AS predicted_category,
    confidence FROM fx_registry WHERE classification_method IS NOT NULL"""


@query("registry_model_stats", "A23", f"""
    SELECT model_name, count(*) AS total, round(avg(confidence), 6) AS avg_confidence,
           count(*) FILTER (confidence >= 0.7) AS high_confidence, count(*) FILTER (confidence < 0.5) AS low_confidence
    FROM ({CLASSIFICATIONS}) GROUP BY 1""")
def _(t: Tables):
    return registry.model_statistics(classifications(t))


@query("registry_category_distribution", "A24", f"""
    SELECT predicted_category, count(*) AS count FROM ({CLASSIFICATIONS}) GROUP BY 1
    ORDER BY count DESC, predicted_category NULLS FIRST LIMIT 10""")
def _(t: Tables):
    return registry.category_distribution(classifications(t))


@query("registry_classified_files", "J3", f"""
    SELECT c.file_id, c.model_name, c.predicted_category, f.path, f.name FROM ({CLASSIFICATIONS}) c JOIN fx_files f
    ON c.file_id = f.file_id""")
def _(t: Tables):
    return registry.classifications_with_files(classifications(t), t.files).drop("confidence")


@query("registry_state_counts", "A31", """
    WITH r AS (SELECT * FROM fx_registry)
    SELECT 'total' AS section, 'all' AS key, count(*) AS count FROM r
    UNION ALL SELECT 'state', canonical_state, count(*) FROM r GROUP BY canonical_state
    UNION ALL (SELECT 'type', document_type, count(*) AS c FROM r WHERE document_type IS NOT NULL GROUP BY document_type
               ORDER BY c DESC, document_type LIMIT 15)
    UNION ALL SELECT 'method', classification_method, count(*) FROM r WHERE classification_method IS NOT NULL
              GROUP BY classification_method
    UNION ALL SELECT 'duplicates', 'all', count(*) FROM r WHERE is_duplicate
    UNION ALL SELECT 'low_confidence', 'all', count(*) FROM r WHERE confidence < 0.7 AND confidence > 0""")
def _(t: Tables):
    return registry.dashboard(t.registry_dups)


RUN = """SELECT file_id, document_type, confidence, classification_method AS method,
    CASE WHEN file_id % 2 = 0 THEN 'technical_manual' END AS old_type FROM fx_registry"""


def run_rows(t: Tables):
    return t.registry.selectExpr("file_id", "document_type", "coalesce(confidence, 0d) confidence",
                                 "classification_method method", "case when file_id % 2 = 0 then 'technical_manual' end old_type")


@query("run_statistics", "A32", f"""
    WITH r AS (SELECT * REPLACE (coalesce(confidence, 0) AS confidence) FROM ({RUN}))
    SELECT count(*) AS total, count(document_type) AS classified,
           count(*) FILTER (document_type IS NOT NULL AND confidence >= 0.7) AS high_confidence,
           count(*) FILTER (document_type IS NOT NULL AND confidence < 0.7) AS low_confidence,
           count(*) FILTER (document_type IS NULL) AS failed, round(count(document_type) / CAST(count(*) AS DOUBLE), 6) AS success_rate,
           round(count(*) FILTER (document_type IS NOT NULL AND confidence >= 0.7) / CAST(count(document_type) AS DOUBLE), 6) AS high_confidence_rate,
           count(*) FILTER (document_type <> old_type) AS changed, count(*) FILTER (document_type = old_type) AS unchanged FROM r""")
def _(t: Tables):
    return registry.run_statistics(run_rows(t), old_type="old_type")


@query("run_breakdown", "A32 A54", f"""
    SELECT 'type' AS dimension, document_type AS key, count(*) AS count FROM ({RUN}) WHERE document_type IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'method', method, count(*) FROM ({RUN}) WHERE document_type IS NOT NULL GROUP BY 2""")
def _(t: Tables):
    return registry.run_breakdown(run_rows(t))


@query("inbox_breakdown", "A54", """
    SELECT coalesce(document_type, 'unclassified') AS document_type, count(*) AS count FROM fx_registry
    WHERE starts_with(original_path, '/src1') GROUP BY 1""")
def _(t: Tables):
    return registry.inbox_breakdown(t.registry, "/src1")


@query("registry_quick_stats", "A48", """
    SELECT count(*) AS total, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.75) AS medium,
           round(100.0 * count(*) FILTER (text <> '') / count(*), 4) AS has_text_pct,
           count(*) FILTER (document_type <> 'general_document') AS specific,
           round(100.0 * count(*) FILTER (document_type <> 'general_document') / count(*), 4) AS specific_pct FROM fx_registry""")
def _(t: Tables):
    return registry.quick_statistics(t.registry, "text")


@query("media_split", "A49", """
    SELECT CASE extension WHEN '.jpg' THEN 'image' WHEN '.mp4' THEN 'video' ELSE 'document' END AS media_kind,
           extension AS ext, count(*) AS count FROM fx_files_big GROUP BY ALL""")
def _(t: Tables):
    return registry.media_split(t.files_big)


@query("name_keywords", "A52", """
    SELECT keyword, count(*) AS count FROM (
        SELECT unnest(regexp_split_to_array(lower(regexp_replace(left(name, length(name) - length(extension)),
               '^\\d{4}-\\d{2}-\\d{2}_review_', '')), '[_\\[\\]\\s-]')) AS keyword FROM fx_files)
    WHERE length(keyword) >= 3 GROUP BY 1 ORDER BY count DESC, keyword LIMIT 50""")
def _(t: Tables):
    return registry.name_keywords(t.files)


@query("name_keywords_parts", "A52", """
    SELECT keyword, count(*) AS count FROM (
        SELECT unnest(regexp_split_to_array(lower(left(name, length(name) - 4)), '[_\\[\\]\\s-]')) AS keyword FROM fx_names)
    WHERE length(keyword) >= 3 GROUP BY 1 ORDER BY count DESC, keyword LIMIT 50""")
def _(t: Tables):
    return registry.name_keywords(t.names)


@query("unknown_rows", "F6", """
    SELECT file_id, original_path, confidence FROM fx_registry WHERE document_type IS NULL OR document_type = 'unknown'""")
def _(t: Tables):
    return registry.unknown_rows(t.registry).select("file_id", "original_path", "confidence")


@query("low_confidence_rows", "F6 L2", """
    SELECT file_id, document_type, confidence FROM fx_registry WHERE confidence < 0.5 ORDER BY confidence, file_id LIMIT 100""")
def _(t: Tables):
    return registry.low_confidence(t.registry.select("file_id", "document_type", "confidence"))


@query("review_window", "F6", """
    SELECT file_id, confidence FROM fx_registry WHERE confidence > 0 AND confidence < 0.7""")
def _(t: Tables):
    return registry.review_window(t.registry).select("file_id", "confidence")


@query("search_documents", "F7 Q1", """
    SELECT file_id, file_name, document_type, confidence FROM fx_registry WHERE document_type = 'technical_manual'
    AND confidence >= 0.2 AND confidence <= 0.9 AND file_name ILIKE '%REPORT%' ORDER BY confidence, file_id LIMIT 50""")
def _(t: Tables):
    rows = t.registry.select("file_id", "file_name", "document_type", "confidence")
    return registry.search(rows, "technical_manual", 0.2, 0.9, "%REPORT%")


@query("search_hits", "F7", """
    SELECT file_id, file_name, document_type, confidence FROM fx_registry WHERE document_type = 'technical_manual'
    AND confidence >= 0.2 AND confidence <= 0.9 AND file_name ILIKE '%CONTRACT%' ORDER BY confidence, file_id LIMIT 50""")
def _(t: Tables):
    rows = t.registry.select("file_id", "file_name", "document_type", "confidence")
    return registry.search(rows, "technical_manual", 0.2, 0.9, "%CONTRACT%")


@query("search_names", "F8", """
    SELECT file_id, file_name FROM fx_registry WHERE contains(lower(file_name), 'invoice') ORDER BY file_id DESC LIMIT 50""")
def _(t: Tables):
    return registry.search_names(t.registry.select("file_id", "file_name"), "Invoice")


@query("registry_page", "S14 L5", """
    SELECT file_id, file_name, canonical_state FROM fx_registry WHERE canonical_state = 'pending'
    ORDER BY file_id DESC LIMIT 50 OFFSET 50""")
def _(t: Tables):
    return registry.page(t.registry.select("file_id", "file_name", "canonical_state"), 2, state="pending")


@query("registry_page_after", "S14 L5", """
    SELECT file_id, file_name, canonical_state FROM fx_registry WHERE canonical_state = 'pending' AND file_id < 150
    ORDER BY file_id DESC LIMIT 50""")
def _(t: Tables):
    return registry.page_after(t.registry.select("file_id", "file_name", "canonical_state"), 150, state="pending")


@query("registry_page_total", "S14", """
    SELECT count(*) AS total FROM fx_registry WHERE document_type = 'financial_invoice' AND canonical_state = 'pending'""")
def _(t: Tables):
    return registry.page_total(t.registry, "financial_invoice", "pending")


@query("lookup_by_id", "F19", "SELECT file_id, original_path, document_type FROM fx_registry WHERE file_id = 17")
def _(t: Tables):
    return registry.by_id(t.registry, 17).select("file_id", "original_path", "document_type")


DIGEST = "SELECT min(hash_full) FROM fx_files"


@query("lookup_by_hash", "F20", f"SELECT file_id, hash_quick FROM fx_files WHERE hash_quick = ({DIGEST})")
def _(t: Tables):
    smallest = t.files.agg(F.min("hash_full").alias("h")).scalar()
    return registry.by_hash(t.files, smallest).select("file_id", "hash_quick")


@query("active_sources", "F21", """
    SELECT root_id, count(*) % 2 = 0 AS active, count(*) AS priority FROM fx_files GROUP BY 1 HAVING count(*) % 2 = 0""")
def _(t: Tables):
    sources = t.files.groupBy("root_id").agg(F.count("*").alias("priority")).withColumn("active", F.col("priority") % 2 == 0)
    return registry.active(sources)


@query("unorganised_rows", "F16", """
    SELECT file_id FROM fx_registry WHERE original_path ILIKE '%Inbox%' OR original_path ILIKE '%To_Review%'
    OR original_path ILIKE '%Invoice%'""")
def _(t: Tables):
    path = F.col("original_path")
    return t.registry.where(flags.unorganised(path) | path.ilike("%Invoice%")).select("file_id")


@query("trainable_rows", "F17 A47", """
    SELECT file_id, document_type FROM (SELECT *, count(*) OVER (PARTITION BY document_type) AS n FROM fx_registry
    WHERE document_type <> 'unknown' AND confidence >= 0.7) WHERE n >= 5""")
def _(t: Tables):
    return flags.trainable(t.registry).select("file_id", "document_type")


@query("movable_rows", "F12 Q6", """
    SELECT file_id FROM fx_flagged WHERE NOT is_duplicate AND NOT is_orphaned AND NOT is_temp""")
def _(t: Tables):
    return flags.movable(t.flagged).select("file_id")


@query("movable_keepers", "F12 Q6", """
    SELECT file_id FROM fx_flagged WHERE (NOT is_duplicate OR is_canonical) AND NOT is_orphaned AND NOT is_temp""")
def _(t: Tables):
    return flags.movable(t.flagged, "non_canonical").select("file_id")


for _priority, _cut, _types in (("critical", 0.5, "'unknown'"), ("high", 0.75, "'unknown', 'general_document'"),
                                ("all", 0.75, "'unknown', 'general_document', 'form'")):
    def _build(t: Tables, p=_priority):
        return registry.review_candidates(t.registry.select("file_id", "document_type", "confidence"), p)

    query(f"review_candidates_{_priority}", "F9", f"""
        SELECT file_id, document_type, confidence FROM fx_registry WHERE confidence < {_cut} OR document_type IN ({_types})
        ORDER BY confidence ASC NULLS FIRST, file_id LIMIT 20""")(_build)


def suggestion_sql() -> str:
    parts = []
    for pattern, settled, exclusion, label in SUGGESTIONS:
        fits = " OR ".join(
            f"starts_with(document_type, {rs.text(v[:-1])})" if v.endswith("*") else f"document_type = {rs.text(v)}" for v in settled)
        hit = f"{rs.matches('file_name', pattern)} AND NOT coalesce({fits}, FALSE)"
        if exclusion:
            hit += f" AND NOT {rs.matches('file_name', exclusion)}"
        parts.append(f"CASE WHEN {hit} THEN {rs.text(label)} END")
    return f"concat_ws(' | ', {', '.join(parts)})"


def reason_sql() -> str:
    c = "coalesce(confidence, 0)"
    parts = [f"CASE WHEN {c} < 0.5 THEN 'VERY LOW confidence' WHEN {c} < 0.75 THEN 'Low confidence' END",
             "CASE WHEN document_type IN ('unknown', 'general_document', 'general_document_short', 'form') THEN 'Generic classification' END"]
    parts += [f"CASE WHEN document_type = {rs.text(k)} AND {rs.matches('file_name', p)} THEN {rs.text(label)} END" for k, p, label in LIKELY]
    parts += ["CASE WHEN regexp_matches(file_name, '^file-[A-Za-z0-9]{22}-[A-F0-9]{8}-') THEN 'Cryptic filename - needs content review' END",
              "CASE WHEN regexp_matches(file_name, 'cco_\\d{6}') THEN 'Generic CCO file - needs context' END"]
    return f"coalesce(nullif(concat_ws('; ', {', '.join(parts)}), ''), 'Flagged for review')"


REVIEW = """(confidence < 0.75 OR document_type IN ('unknown', 'general_document', 'general_document_short', 'form')
    OR (document_type = 'medical' AND file_name ILIKE '%vehicle%')
    OR (document_type = 'hr_resume' AND (file_name ILIKE '%resume%' OR file_name ILIKE '%yoga%'))
    OR (document_type = 'financial_invoice' AND (file_name ILIKE '%calculator%' OR file_name ILIKE '%estimator%')))"""


@query("review_list", "F10 C15", f"""
    SELECT file_id, file_name, document_type, confidence, {suggestion_sql()} AS suggested_types, {reason_sql()} AS reason
    FROM fx_registry WHERE {REVIEW}""")
def _(t: Tables):
    return registry.review_list(t.registry)


@query("review_reasons", "A42", f"""
    WITH l AS (SELECT document_type, {reason_sql()} AS reason FROM fx_registry WHERE {REVIEW})
    SELECT 'type' AS dimension, document_type AS key, count(*) AS count FROM l GROUP BY 2
    UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(string_split(reason, '; ')) AS r FROM l) GROUP BY r""")
def _(t: Tables):
    return registry.review_statistics(registry.review_list(t.registry))


@query("review_ordered", "L3", f"""
    SELECT file_id, file_name, confidence FROM fx_registry WHERE {REVIEW} ORDER BY CASE WHEN confidence < 0.5 THEN 1
    WHEN document_type = 'unknown' THEN 2 WHEN confidence < 0.75 THEN 3 ELSE 4 END, confidence ASC NULLS FIRST, file_name LIMIT 100""")
def _(t: Tables):
    return registry.review_list(t.registry).orderBy(*registry.review_order()).limit(100).select("file_id", "file_name", "confidence")


@query("lookup_by_hash_keyed", "F20", f"SELECT file_id, hash_quick, path FROM fx_files WHERE hash_quick = ({DIGEST})")
def _(t: Tables):
    folder = shared_folder(t.spark, "keyed")
    keyed.write_keyed(t.files.select("file_id", "hash_quick", "path"), folder, "hash_quick", "file_id")
    smallest = t.files.agg(F.min("hash_full").alias("h")).scalar()
    value = t.spark.range(1).select(smallest.alias("h")).first().h
    return keyed.by_key(t.spark, folder, "hash_quick", value)


@query("search_names_indexed", "F8", """
    SELECT file_id, file_name FROM fx_registry WHERE contains(lower(file_name), 'voice #1') ORDER BY file_id DESC LIMIT 50""")
def _(t: Tables):
    folder = shared_folder(t.spark, "names")
    keyed.write_names(t.registry, folder, "file_id", "file_name")
    return keyed.search(t.spark, folder, "Voice #1", 50, like=False).toDF("file_id", "file_name")


@query("search_like_indexed", "F7 F8", "SELECT file_id, file_name FROM fx_registry WHERE file_name ILIKE '%Contract%_1_.%df'")
def _(t: Tables):
    folder = shared_folder(t.spark, "names")
    keyed.write_names(t.registry, folder, "file_id", "file_name")
    return keyed.search(t.spark, folder, "%Contract%_1_.%df").toDF("file_id", "file_name")
