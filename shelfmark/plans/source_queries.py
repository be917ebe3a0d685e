"""Catalog records, exports, MIME types, sampling."""

from __future__ import annotations

import mimetypes

from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import categories
from shelfmark.plans.fixtures import EXTENSIONS, Tables
from shelfmark.plans.registry import query
from shelfmark.sources import files as file_source
from shelfmark.sources import tabular


@query("folder_listing", "S17", """
    SELECT name, size_bytes FROM fx_files WHERE root_id = 'src1' AND lang = 'en'""")
def _(t: Tables):
    return file_source.listing(t.files, "/src1/en").select("name", "size_bytes")


@query("folder_walk", "S17", """
    SELECT '/' || root_id || '/' || lang AS folder, name, FALSE AS is_directory FROM fx_files
    UNION ALL SELECT DISTINCT '', root_id, TRUE FROM fx_files UNION ALL SELECT DISTINCT '/' || root_id, lang, TRUE FROM fx_files""")
def _(t: Tables):
    return file_source.walk(t.files)


@query("walk_as_changes", "S9", """
    SELECT path, 'modified' AS change_type, modified_at, size_bytes AS size FROM fx_files""")
def _(t: Tables):
    return file_source.as_changes(t.files).drop("old_path")


@query("export_json", "S10 X27", """
    SELECT file_id, '{"file_id":' || file_id || ',"file_name":"' || file_name || '","canonical_state":"' || canonical_state || '"}' AS value
    FROM fx_registry""")
def _(t: Tables):
    rows = t.registry.select("file_id", "file_name", "canonical_state")
    return rows.select("file_id", F.to_json(F.struct("file_id", "file_name", "canonical_state")).alias("value"))


MIME = {e: mimetypes.guess_type(f"x{e}")[0] for e in EXTENSIONS}
MIME_CASE = " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in MIME.items() if m)


@query("mime_types", "X9", f"SELECT extension, CASE extension {MIME_CASE} END AS mime_type, count(*) AS count FROM fx_files GROUP BY 1")
def _(t: Tables):
    return categories.with_mime_type(t.files, EXTENSIONS).groupBy("extension", "mime_type").agg(F.count("*").alias("count"))


@query("catalog_records", "F1 S5", """
    SELECT file_id, path, size_bytes, CAST(NULL AS VARCHAR) AS owner, FALSE AS has_mime FROM fx_files""")
def _(t: Tables):
    rows = schemas.conform(t.files.drop("doc_id", "text", "root_id", "lang", "relative_path"), schemas.FILES)
    return rows.select("file_id", "path", "size_bytes", "owner", F.col("mime_type").isNotNull().alias("has_mime"))


@query("table_versions", "O2", """
    SELECT file_id, CAST(NULL AS VARCHAR) AS source_id FROM fx_registry UNION ALL SELECT file_id, source_id FROM fx_registry""")
def _(t: Tables):
    old, new = t.registry.select("file_id"), t.registry.select("file_id", "source_id")
    return schemas.stack_versions(old, new)


@query("sessions_newest", "S5", """
    SELECT source_id AS session_id, min(created_at) AS started_at FROM fx_registry GROUP BY 1 ORDER BY started_at DESC, session_id LIMIT 50""")
def _(t: Tables):
    sessions = t.registry.groupBy(F.col("source_id").alias("session_id")).agg(F.min("created_at").alias("started_at"))
    return schemas.sessions_newest_first(sessions)


@query("preview_rows", "L4", "SELECT file_id, path FROM fx_files ORDER BY file_id LIMIT 10")
def _(t: Tables):
    return t.files.select("file_id", "path").orderBy("file_id").limit(10)


@query("registry_export_rows", "S10", """
    SELECT '{"file_id":"' || file_id || '","extension":"' || extension || '"}' AS value FROM fx_files""")
def _(t: Tables):
    return tabular.as_json(t.files.select("file_id", "extension"))
