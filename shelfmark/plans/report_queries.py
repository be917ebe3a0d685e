"""Storage reports."""

from __future__ import annotations

from shelfmark.operators import flags, lifecycle, storage
from shelfmark.plans.fixtures import CATALOG_CLOCK, Tables
from shelfmark.plans.registry import query
from pyspark.sql import functions as F

AGE = f"epoch(TIMESTAMP '{CATALOG_CLOCK}' - modified_at) / 86400.0"


@query("report_overview", "A1", """
    SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size, count(DISTINCT extension)
           AS unique_extensions, min(created_at) AS oldest, max(created_at) AS newest FROM fx_files""")
def _(t: Tables):
    return storage.overview(t.files)


@query("report_folders", "S4 A1 J6", """
    SELECT path, CAST(depth AS BIGINT) AS depth, file_count, total_size FROM fx_big_folders""")
def _(t: Tables):
    return storage.folders(t.files_big).select("path", "depth", "file_count", "total_size")


@query("report_file_types", "A2", """
    SELECT file_category, count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS total_size,
           round(100.0 * sum(size_bytes) / sum(sum(size_bytes)) OVER (), 2) AS pct_of_total
    FROM fx_catalog GROUP BY file_category""")
def _(t: Tables):
    return storage.by_category(t.catalog)


@query("report_subcategories", "A3", """
    SELECT file_category, file_subcategory, count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS total_size,
           round(avg(size_bytes), 4) AS avg_size FROM fx_catalog GROUP BY ALL""")
def _(t: Tables):
    return storage.by_subcategory(t.catalog)


@query("report_category_totals", "A3", """
    SELECT file_category, file_subcategory, count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS total_size,
           round(avg(size_bytes), 4) AS avg_size FROM fx_catalog GROUP BY ROLLUP (file_category, file_subcategory)""")
def _(t: Tables):
    return storage.by_subcategory(t.catalog, totals=True)


@query("report_extensions", "A4", """
    SELECT extension, count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS total_size, round(avg(size_bytes), 4)
           AS avg_size FROM fx_files_big GROUP BY extension ORDER BY total_size DESC, extension LIMIT 20""")
def _(t: Tables):
    return storage.by_extension(t.files_big)


@query("report_size_hist", "A5", """
    SELECT l.range_label, count(f.size_bytes) AS count, CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS total_size
    FROM (VALUES ('tiny', 0, 10240), ('small', 10240, 102400), ('medium', 102400, 1048576), ('large', 1048576, 10485760),
                 ('very_large', 10485760, 104857600), ('huge', 104857600, 9000000000000000000)) l(range_label, lo, hi)
    LEFT JOIN fx_files_big f ON f.size_bytes >= l.lo AND f.size_bytes < l.hi GROUP BY l.range_label""")
def _(t: Tables):
    return storage.size_histogram(t.files_big)


@query("report_size_classes", "A6", """
    SELECT CASE WHEN size_bytes < 10240 THEN 'tiny' WHEN size_bytes < 1048576 THEN 'small' WHEN size_bytes < 10485760
           THEN 'medium' WHEN size_bytes < 104857600 THEN 'large' ELSE 'very_large' END AS size_class,
           count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS total_size FROM fx_files_big GROUP BY 1""")
def _(t: Tables):
    return storage.size_classes(t.files_big)


@query("report_timeline_created", "A7 X21", """
    SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS size
    FROM fx_files GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def _(t: Tables):
    return storage.timeline(t.files)


@query("report_timeline_modified", "A7", """
    SELECT strftime(modified_at, '%Y-%m') AS month, count(*) AS count FROM fx_files_big GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def _(t: Tables):
    return storage.timeline(t.files_big, "modified_at", with_size=False)


@query("report_age_buckets", "A8 X21", f"""
    SELECT CASE WHEN {AGE} < 30 THEN '0-30 days' WHEN {AGE} < 90 THEN '30-90 days' WHEN {AGE} < 180 THEN '90-180 days'
           WHEN {AGE} < 365 THEN '180-365 days' ELSE '365+ days' END AS age_bucket, count(*) AS count,
           CAST(sum(size_bytes) AS BIGINT) AS total_size FROM fx_files GROUP BY 1""")
def _(t: Tables):
    return storage.age_buckets(t.files, CATALOG_CLOCK)


@query("report_age_summary", "A8", f"""
    SELECT count(*) AS total_files, round(avg({AGE}), 4) AS avg_age_days, min(modified_at) AS oldest,
           max(modified_at) AS newest FROM fx_files""")
def _(t: Tables):
    return storage.age_summary(t.files, CATALOG_CLOCK)


@query("report_stale", "A10 F3", """
    SELECT count(*) AS orphaned_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS orphaned_bytes
    FROM fx_catalog WHERE is_orphaned""")
def _(t: Tables):
    return storage.stale_summary(t.catalog)


@query("report_folder_rollup", "A11 J6 X24", """
    SELECT path, file_count, total_size FROM fx_big_folders ORDER BY total_size DESC, path LIMIT 20""")
def _(t: Tables):
    return storage.largest_folders(t.files_big)


@query("report_category_extensions", "A12 W4", """
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file_category ORDER BY count DESC, extension)
                   AS INTEGER) AS rank FROM (SELECT file_category, extension, count(*) AS count FROM fx_catalog
                   GROUP BY file_category, extension)) WHERE rank <= 20""")
def _(t: Tables):
    return storage.extensions_per_category(t.catalog)


@query("report_folder_depth", "A13", """
    SELECT CAST(depth AS BIGINT) AS depth, count(*) AS count,
           row_number() OVER (ORDER BY count(*) DESC, depth) = 1 AS is_modal FROM fx_big_folders GROUP BY depth""")
def _(t: Tables):
    return storage.depth_distribution(storage.folders(t.files_big))


@query("report_top_level", "A14", """
    SELECT split_part(path, '/', 2) AS folder, count(*) AS count FROM fx_big_folders
    GROUP BY 1 ORDER BY count DESC, folder LIMIT 20""")
def _(t: Tables):
    return storage.top_level_folders(storage.folders(t.files_big))


@query("report_largest_files", "L1 X26", """
    SELECT file_id, name, path, size_bytes, round(size_bytes / 1000000.0, 6) AS size_mb FROM fx_files
    ORDER BY size_bytes DESC, file_id LIMIT 20""")
def _(t: Tables):
    return storage.largest_files(t.files)


@query("report_insights", "C17", """
    SELECT 'info' AS severity, 'Storage Dominated by ' || upper(left(file_category, 1)) || substr(file_category, 2)
           AS title, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM fx_catalog GROUP BY file_category
    QUALIFY row_number() OVER (ORDER BY sum(size_bytes) DESC, file_category DESC) = 1
    UNION ALL
    SELECT 'suggestion', CAST(count(*) AS VARCHAR) || ' Orphaned Files Found', CAST(sum(size_bytes) AS BIGINT)
    FROM fx_catalog WHERE is_orphaned HAVING count(*) > 0
    UNION ALL
    SELECT 'warning', 'Significant Duplication: ' || printf('%.1f', w / 1e9) || ' GB Recoverable', CAST(w AS BIGINT) FROM (
        SELECT sum((member_count - 1) * total_size) AS w FROM fx_groups) WHERE w / 1e9 > 1""")
def _(t: Tables):
    return storage.insights(t.catalog, t.groups)


@query("report_proposal", "C18", """
    SELECT file_category, n AS total_count, CAST(s AS BIGINT) AS total_size, CASE file_category
           WHEN 'documents' THEN 'Active/Documents/{subcategory}/{YYYY}' WHEN 'media' THEN 'Active/Media/{subcategory}/{YYYY-MM}'
           WHEN 'code' THEN 'Active/Projects/{project_name}/src' WHEN 'archives' THEN 'Archive/Compressed/{YYYY}'
           ELSE 'Active/' || upper(left(file_category, 1)) || substr(file_category, 2) || '/{YYYY}' END AS target,
           file_category = 'code' AS preserve_structure,
           file_category IN ('documents', 'media', 'code') AND n > 100 AS own_top_level FROM (
        SELECT file_category, count(*) AS n, sum(size_bytes) AS s, sum(count(*)) OVER () AS total FROM fx_catalog
        GROUP BY file_category) WHERE n / total > 0.01 OR s > 1000000000""")
def _(t: Tables):
    return storage.proposal(t.catalog)


@query("report_lifecycle_threshold", "C18", f"""
    SELECT greatest(180, CAST(CASE WHEN a > 30 THEN floor(a * 1.5) ELSE 180 END AS BIGINT)) AS not_modified_days
    FROM (SELECT coalesce(avg({AGE}), 0) AS a FROM fx_files)""")
def _(t: Tables):
    return storage.lifecycle_threshold(t.files, CATALOG_CLOCK)


@query("flags_temp", "F4", """
    SELECT is_temp, count(*) AS count FROM fx_catalog GROUP BY 1""")
def _(t: Tables):
    return t.catalog.groupBy("is_temp").agg(F.count("*").alias("count"))


@query("flags_stale", "F3 Q9", f"""
    SELECT file_id, accessed_at < TIMESTAMP '{CATALOG_CLOCK}' - INTERVAL 365 DAY AND size_bytes < 10240 AS is_orphaned
    FROM fx_files""")
def _(t: Tables):
    return flags.with_stale_flag(t.files, as_of=CATALOG_CLOCK, max_size=10240).select("file_id", "is_orphaned")


@query("flags_low_value", "F22", f"""
    SELECT file_id, extension = '.log' AND modified_at < TIMESTAMP '{CATALOG_CLOCK}' - INTERVAL 90 DAY AS is_low_value
    FROM fx_files""")
def _(t: Tables):
    return flags.with_low_value_flag(t.files, as_of=CATALOG_CLOCK).select("file_id", "is_low_value")


@query("flags_classify_candidates", "F5", """
    SELECT file_id, size_bytes, extension FROM fx_files WHERE size_bytes >= 1024 AND extension IN ('.pdf', '.docx')""")
def _(t: Tables):
    return flags.classify_candidates(t.files, 1024, [".pdf", ".docx"]).select("file_id", "size_bytes", "extension")


@query("lifecycle_archive_due", "P15", f"""
    SELECT file_id FROM fx_files WHERE date_diff('day', CAST(modified_at AS DATE), DATE '2025-01-01') >= 180
    AND access_count = 0""")
def _(t: Tables):
    return lifecycle.archive_due(t.files, as_of=CATALOG_CLOCK).select("file_id")


@query("lifecycle_quarantine_due", "P15", """
    SELECT file_id FROM fx_files WHERE date_diff('day', CAST(modified_at AS DATE), DATE '2025-01-01') >= 30""")
def _(t: Tables):
    held = t.files.withColumnRenamed("modified_at", "quarantined_at")
    return lifecycle.quarantine_review_due(held, as_of=CATALOG_CLOCK).select("file_id")
