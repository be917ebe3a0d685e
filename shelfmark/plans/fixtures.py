"""Catalog views derived from the driver tables, for Spark and as SQL for the checks.

Clocks are fixed: CATALOG_CLOCK for catalog views, REGISTRY_CLOCK for registry views.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scale import spread
from shelfmark.operators import categories, dedup, flags
from shelfmark.sources.tabular import read_events

CATALOG_CLOCK = "2025-01-01 00:00:00"
REGISTRY_CLOCK = "2024-01-31 00:00:00"
EXTENSIONS = (".pdf", ".txt", ".md", ".py", ".json", ".jpg", ".xlsx", ".docx", ".log", ".tmp", ".zip", ".xyz")
STEMS = ("report_", "Invoice #", "resume v", "screenshot ", "api-guide-", "contract_2024-03-01_", "note - Copy ")
PREFERRED = ("/src1/",)


def _case(expr: str, values: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {arms} ELSE '{values[-1]}' END"


EXT_SQL = _case("n % 12", EXTENSIONS)
STEM_SQL = _case("doc_id % 7", STEMS)
TYPE_SQL = (
    "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 THEN 'general_document' "
    "WHEN doc_id % 3 = 0 THEN 'financial_invoice' ELSE 'technical_manual' END"
)
METHOD_SQL = "CASE doc_id % 4 WHEN 0 THEN 'ml_model' WHEN 1 THEN 'pattern' WHEN 2 THEN 'fallback' END"
STATE_SQL = "CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'classified' ELSE 'organized' END"
CONF_SQL = "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id * 37 % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END"
BIG_EXT_SQL = _case("l_linenumber % 4", (".pdf", ".csv", ".mp4", ".bak"))
CHANGE_SQL = (
    "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'renamed' "
    "ELSE 'modified' END"
)

CATEGORY_SQL = (
    "CASE WHEN extension IN ('.tmp', '.log') THEN 'system' WHEN extension IN ('.pdf', '.txt', '.md', '.xlsx', '.docx') "
    "THEN 'documents' WHEN extension IN ('.py', '.json') THEN 'code' WHEN extension = '.jpg' THEN 'media' "
    "WHEN extension = '.zip' THEN 'archives' ELSE 'other' END"
)
SUBCATEGORY_SQL = (
    "CASE extension WHEN '.tmp' THEN 'temp_files' WHEN '.log' THEN 'logs' WHEN '.pdf' THEN 'pdfs' "
    "WHEN '.txt' THEN 'text_documents' WHEN '.md' THEN 'text_documents' WHEN '.xlsx' THEN 'spreadsheets' "
    "WHEN '.docx' THEN 'word_processing' WHEN '.py' THEN 'source_code' WHEN '.json' THEN 'config' "
    "WHEN '.jpg' THEN 'photos' WHEN '.zip' THEN 'compressed' ELSE 'unknown' END"
)


def _hours(expr: str, start: str) -> str:
    return f"TIMESTAMP '{start}' + to_hours(CAST({expr} AS BIGINT))"


# Views as SQL, for the side-by-side check.
VIEWS = {
    "fx_base": f"""
        SELECT doc_id, text, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n, sha256(text) AS h,
               {STEM_SQL} || CAST(doc_id AS VARCHAR) AS stem FROM documents""",
    "fx_files": f"""
        SELECT 'd' || CAST(doc_id AS VARCHAR) AS file_id, doc_id, source AS root_id, lang,
               '/' || lang || '/' || stem || {EXT_SQL} AS relative_path,
               '/' || source || '/' || lang || '/' || stem || {EXT_SQL} AS path,
               stem || {EXT_SQL} AS name, {EXT_SQL} AS extension, n AS size_bytes, h AS hash_quick, h AS hash_full,
               {_hours('doc_id % 17520', '2023-01-01 00:00:00')} AS created_at,
               {_hours('doc_id * 3 % 17520', '2023-01-01 00:00:00')} AS modified_at,
               {_hours('doc_id * 5 % 17520', '2023-01-01 00:00:00')} AS accessed_at,
               doc_id % 4 AS access_count, text FROM fx_base""",
    "fx_catalog": f"""
        SELECT *, {CATEGORY_SQL} AS file_category, {SUBCATEGORY_SQL} AS file_subcategory,
               accessed_at < TIMESTAMP '{CATALOG_CLOCK}' - INTERVAL 365 DAY AS is_orphaned,
               extension IN ('.tmp', '.bak', '.old', '.temp', '.cache') AS is_temp FROM fx_files""",
    "fx_scored": """
        SELECT *, CASE WHEN contains(path, '/src1/') THEN 20 ELSE 0 END
                  + greatest(0, 10 - (length(path) - length(replace(path, '/', ''))))
                  + CASE WHEN regexp_matches(name, '(?i)(copy|backup|\\(\\d+\\)|untitled)') THEN 0 ELSE 5 END
                  + least(15, greatest(0, access_count)) AS base
        FROM fx_catalog""",
    "fx_exact": """
        SELECT *, base + CASE WHEN newest = 1 THEN 10 ELSE 0 END AS score FROM (
            SELECT *, count(*) OVER (PARTITION BY size_bytes, extension, hash_full) AS copies,
                   row_number() OVER (PARTITION BY size_bytes, extension, hash_full
                                      ORDER BY modified_at DESC, file_id) AS newest
            FROM fx_scored WHERE size_bytes >= 1024) WHERE copies > 1""",
    "fx_members": """
        SELECT sha256(concat_ws('|', 'exact', CAST(size_bytes AS VARCHAR), extension, hash_full)) AS group_id, file_id,
               score, row_number() OVER (PARTITION BY size_bytes, extension, hash_full ORDER BY score DESC, file_id) = 1
               AS is_canonical, * EXCLUDE (file_id, score) FROM fx_exact""",
    "fx_groups": """
        SELECT group_id, max(CASE WHEN is_canonical THEN file_id END) AS canonical_file, count(*) AS member_count,
               max(size_bytes) AS total_size FROM fx_members GROUP BY group_id""",
    "fx_flagged": """
        SELECT c.*, m.group_id IS NOT NULL AS is_duplicate, m.group_id AS duplicate_group,
               coalesce(m.is_canonical, FALSE) AS is_canonical
        FROM fx_catalog c LEFT JOIN fx_members m ON c.file_id = m.file_id""",
    "fx_files_big": f"""
        SELECT 'l' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                CAST(round(l_extendedprice * 100) AS BIGINT)) AS file_id,
               '/s' || l_suppkey || '/p' || (l_partkey % 50) AS folder,
               '/s' || l_suppkey || '/p' || (l_partkey % 50) || '/f' || l_orderkey || '_' || l_linenumber || {BIG_EXT_SQL}
               AS path, 'f' || l_orderkey || '_' || l_linenumber || {BIG_EXT_SQL} AS name, {BIG_EXT_SQL} AS extension,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes, l_shipdate AS modified_at FROM lineitem""",
    "fx_big_folders": """
        SELECT path, depth, sum(n)::BIGINT AS file_count, sum(bytes)::BIGINT AS total_size FROM (
            SELECT split_part(folder, '/', 2) AS top, folder, count(*) AS n, sum(size_bytes) AS bytes FROM fx_files_big
            GROUP BY folder) d, LATERAL (SELECT '/' || d.top AS path, 2 AS depth UNION ALL SELECT d.folder, 3) a
        GROUP BY path, depth""",
    "fx_names": """
        SELECT 'p' || p_partkey AS file_id, '/' || replace(p_brand, '#', '') || '/' || p_type || '/' || p_name
               || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (1)' ELSE ' - Copy' END || '.pdf' AS path,
               '/' || replace(p_brand, '#', '') || '/' || p_type AS folder,
               p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (1)' ELSE ' - Copy' END || '.pdf' AS name,
               '.pdf' AS extension, CAST(4096 + 64 * p_size AS BIGINT) AS size_bytes FROM part""",
    "fx_registry": f"""
        SELECT doc_id AS file_id, '/' || source || '/' || lang || '/' || stem || {EXT_SQL} AS original_path,
               stem || {EXT_SQL} AS file_name, n AS file_size, h AS content_hash, {TYPE_SQL} AS document_type,
               {CONF_SQL} AS confidence, {METHOD_SQL} AS classification_method, {STATE_SQL} AS canonical_state,
               CASE WHEN doc_id % 3 = 2 THEN '/Canonical/General/' || stem || {EXT_SQL} END AS canonical_path,
               doc_id % 3 AS move_count, source AS source_id, doc_id % 17 = 0 AS requires_review,
               row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 AS is_duplicate,
               {_hours('doc_id % 720', '2024-01-01 00:00:00')} AS created_at, text FROM fx_base""",
    "fx_corrections": f"""
        SELECT doc_id AS file_id, CASE WHEN toxic = 1 THEN 'financial_invoice' ELSE 'technical_manual' END AS wrong_type,
               CASE WHEN quality = 0 THEN 'legal_contract' ELSE 'medical' END AS correct_type,
               {_hours('doc_id % 720', '2024-01-01 00:00:00')} AS correction_timestamp
        FROM labels WHERE quality = 0 OR toxic = 1""",
    "fx_changes": f"""
        SELECT event_id, '/u' || user_id || '/f' || (event_id % 40) AS path, {CHANGE_SQL} AS change_type,
               ts AS modified_at, CAST(round(value * 100) AS BIGINT) AS size,
               CASE WHEN event_type = 'purchase' THEN '/u' || user_id || '/f' || ((event_id + 1) % 40) END AS old_path
        FROM events""",
    "fx_local": """
        SELECT path, max(modified_at) AS local_modified FROM fx_changes
        WHERE change_type IN ('created', 'modified') GROUP BY path""",
    "fx_roots": """
        SELECT l_linestatus AS root_id, '/s' || l_suppkey || '/p' || l_partkey || '_' || CAST(l_quantity AS BIGINT)
               AS relative_path, sha256(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR)) AS hash_quick,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes FROM lineitem""",
}


def with_views(sql: str) -> str:
    """The statement with the views it needs as leading common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    heads = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    joined = f", {body[5:]}" if body[:5].upper() == "WITH " else f" {body}"
    return f"WITH {heads}{joined}"


class Tables:
    """Driver tables and the views over them, created on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return read_events(self.spark, f"{self.folder}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        return spread(self.read("documents")).selectExpr(
            "doc_id", "text", "lang", "source", "n_chars", "cast(octet_length(text) as bigint) n", "sha2(text, 256) h",
            f"concat({STEM_SQL}, cast(doc_id as string)) stem",
        )

    @staticmethod
    def hours(expr: str, start: str) -> str:
        return f"timestampadd(HOUR, cast({expr} as int), timestamp'{start}')"

    @cached_property
    def files(self) -> DataFrame:
        start = "2023-01-01 00:00:00"
        return self.base.selectExpr(
            "concat('d', doc_id) file_id", "doc_id", "source root_id", "lang",
            f"concat('/', lang, '/', stem, {EXT_SQL}) relative_path",
            f"concat('/', source, '/', lang, '/', stem, {EXT_SQL}) path",
            f"concat(stem, {EXT_SQL}) name", f"{EXT_SQL} extension", "n size_bytes", "h hash_quick", "h hash_full",
            f"{self.hours('doc_id % 17520', start)} created_at",
            f"{self.hours('doc_id * 3 % 17520', start)} modified_at",
            f"{self.hours('doc_id * 5 % 17520', start)} accessed_at",
            "doc_id % 4 access_count", "text",
        )

    @cached_property
    def catalog(self) -> DataFrame:
        return flags.with_temp_flag(flags.with_stale_flag(categories.with_category(self.files), as_of=CATALOG_CLOCK))

    @cached_property
    def groups(self) -> DataFrame:
        return dedup.exact_groups(self.catalog, preferred_paths=PREFERRED)

    @cached_property
    def members(self) -> DataFrame:
        return dedup.exact_members(self.catalog, self.groups, preferred_paths=PREFERRED)

    @cached_property
    def flagged(self) -> DataFrame:
        return dedup.with_duplicate_flags(self.catalog, self.members)

    @cached_property
    def files_big(self) -> DataFrame:
        cents = "cast(round(l_extendedprice * 100) as bigint)"
        return self.read("lineitem").selectExpr(
            f"concat('l', concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {cents})) file_id",
            f"concat('/s', l_suppkey, '/p', l_partkey % 50, '/f', l_orderkey, '_', l_linenumber, {BIG_EXT_SQL}) path",
            f"concat('f', l_orderkey, '_', l_linenumber, {BIG_EXT_SQL}) name",
            f"{BIG_EXT_SQL} extension", f"{cents} size_bytes", "l_shipdate modified_at",
        )

    @cached_property
    def names(self) -> DataFrame:
        mark = "case p_partkey % 3 when 0 then '' when 1 then ' (1)' else ' - Copy' end"
        return spread(self.read("part")).selectExpr(
            "concat('p', p_partkey) file_id",
            f"concat('/', replace(p_brand, '#', ''), '/', p_type, '/', p_name, {mark}, '.pdf') path",
            f"concat(p_name, {mark}, '.pdf') name", "'.pdf' extension", "cast(4096 + 64 * p_size as bigint) size_bytes",
        )

    @cached_property
    def registry(self) -> DataFrame:
        """Without is_duplicate (see ``registry_dups``), which costs a shuffle."""
        name = f"concat(stem, {EXT_SQL})"
        return self.base.selectExpr(
            "doc_id file_id", f"concat('/', source, '/', lang, '/', {name}) original_path", f"{name} file_name",
            "n file_size", "h content_hash", f"{TYPE_SQL} document_type", f"{CONF_SQL} confidence",
            f"{METHOD_SQL} classification_method", f"{STATE_SQL} canonical_state",
            f"case when doc_id % 3 = 2 then concat('/Canonical/General/', {name}) end canonical_path",
            "doc_id % 3 move_count", "source source_id", "doc_id % 17 = 0 requires_review",
            f"{self.hours('doc_id % 720', '2024-01-01 00:00:00')} created_at", "text",
        )

    @cached_property
    def registry_dups(self) -> DataFrame:
        """Registry with is_duplicate: a content hash that an earlier id already has."""
        from shelfmark.functions.scale import join_groups

        first = self.registry.groupBy("content_hash").agg(F.min("file_id").alias("_first"), F.count("*").alias("_n"))
        joined = join_groups(self.registry, first, ["content_hash"], "_n", "file_id")
        return joined.withColumn("is_duplicate", F.col("file_id") > F.col("_first")).drop("_first", "_n")

    @cached_property
    def corrections(self) -> DataFrame:
        return self.read("labels").where("quality = 0 or toxic = 1").selectExpr(
            "doc_id file_id", "case when toxic = 1 then 'financial_invoice' else 'technical_manual' end wrong_type",
            "case when quality = 0 then 'legal_contract' else 'medical' end correct_type",
            f"{self.hours('doc_id % 720', '2024-01-01 00:00:00')} correction_timestamp",
        )

    @staticmethod
    def changes_of(events: DataFrame) -> DataFrame:
        return events.selectExpr(
            "event_id", "concat('/u', user_id, '/f', event_id % 40) path", f"{CHANGE_SQL} change_type",
            "ts modified_at", "cast(round(value * 100) as bigint) size",
            "case when event_type = 'purchase' then concat('/u', user_id, '/f', (event_id + 1) % 40) end old_path",
        )

    @cached_property
    def changes(self) -> DataFrame:
        return self.changes_of(self.read("events"))

    @cached_property
    def local_state(self) -> DataFrame:
        return self.changes.where("change_type in ('created', 'modified')").groupBy("path").agg(
            F.max("modified_at").alias("local_modified")
        )

    @cached_property
    def roots(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "l_linestatus root_id",
            "concat('/s', l_suppkey, '/p', l_partkey, '_', cast(l_quantity as bigint)) relative_path",
            "sha2(cast(cast(round(l_discount * 100) as bigint) as string), 256) hash_quick",
            "cast(round(l_extendedprice * 100) as bigint) size_bytes",
        )
