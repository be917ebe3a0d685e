"""Action tables, name conflicts, staging, domains, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import rule_tables as tables
from shelfmark.operators import flags, lifecycle, organise, planning
from shelfmark.plans import rule_sql as rs
from shelfmark.plans.fixtures import CATALOG_CLOCK, REGISTRY_CLOCK, Tables
from shelfmark.plans.registry import query

QUARANTINE = """SELECT file_id, path AS source_path, 'Quarantine/Duplicates_2025-01-01/' || name AS target_path,
    'duplicate_quarantine' AS rule_id, 'Duplicate (group ' || group_id || ')' AS reason, size_bytes AS file_size
    FROM fx_members WHERE NOT is_canonical"""
# a stricter clock than CATALOG_CLOCK leaves some files fresh, so all three kinds of action occur
MIXED_CLOCK = "2024-06-01 00:00:00"
MIXED_STALE = f"accessed_at < TIMESTAMP '{MIXED_CLOCK}' - INTERVAL 450 DAY"
TARGET = """'/Repository/' || CASE file_category WHEN 'documents' THEN 'Active/Documents/General/' || strftime(modified_at, '%Y')
    WHEN 'media' THEN 'Active/Media/media/' || strftime(modified_at, '%Y-%m') WHEN 'code' THEN 'Active/Projects/General/src'
    WHEN 'archives' THEN 'Archive/Compressed/' || strftime(modified_at, '%Y') END || '/' || name"""
REORGANISE = f"""SELECT file_id, path AS source_path, {TARGET} AS target_path, 'reorganize_' || file_category AS rule_id,
    'Reorganize to ' || file_category || ' structure' AS reason, size_bytes AS file_size FROM fx_flagged
    WHERE NOT is_duplicate AND NOT is_temp AND NOT ({MIXED_STALE}) AND file_category IN ('documents', 'media', 'code', 'archives')"""
ARCHIVE = f"""SELECT file_id, path AS source_path, '/Repository/Archive/' || file_category || '/2025/' || name AS target_path,
    'lifecycle_archive' AS rule_id, 'Orphaned file (not accessed recently)' AS reason, size_bytes AS file_size
    FROM fx_flagged WHERE {MIXED_STALE}"""
COLUMNS = ["file_id", "source_path", "target_path", "rule_id", "reason", "file_size"]


def flagged(t: Tables):
    """Flagged catalog with a stale rule that leaves some files fresh."""
    stale = F.col("accessed_at") < F.lit(MIXED_CLOCK).cast("timestamp") - F.make_dt_interval(days=F.lit(450))
    return t.flagged.withColumn("is_orphaned", stale)


@query("plan_quarantine", "P1 J1 J2", QUARANTINE)
def _(t: Tables):
    return planning.quarantine(t.files, t.members, CATALOG_CLOCK).select(*COLUMNS)


@query("plan_reorganize", "P2 X18 F12", REORGANISE)
def _(t: Tables):
    return planning.reorganise(flagged(t)).select(*COLUMNS)


@query("plan_archive", "P3", ARCHIVE)
def _(t: Tables):
    return planning.archive(flagged(t), as_of=CATALOG_CLOCK).select(*COLUMNS)


@query("plan_full", "P4 O2", f"{QUARANTINE} UNION ALL {REORGANISE} UNION ALL {ARCHIVE}")
def _(t: Tables):
    return planning.full_plan(flagged(t), t.members, as_of=CATALOG_CLOCK).select(*COLUMNS)


@query("plan_summary", "A33", f"""
    SELECT k AS action_type, count(*) AS count, CAST(sum(file_size) AS BIGINT) AS total_size FROM (
        SELECT unnest(['move', 'total']) AS k, file_size FROM ({QUARANTINE} UNION ALL {REORGANISE} UNION ALL {ARCHIVE})) GROUP BY 1""")
def _(t: Tables):
    return planning.plan_summary(planning.full_plan(flagged(t), t.members, as_of=CATALOG_CLOCK))


@query("plan_renaming", "P2 X5 X3", f"""
    SELECT file_id, regexp_extract(({TARGET}), '^(.*)/[^/]*$', 1) || '/' || strftime(modified_at, '%Y-%m-%d') || '_General_' || file_category
           || '_' || CASE WHEN contains(name, 'v') AND regexp_matches(name, '(?i)v\\d') THEN 'v' || lpad(CAST(CAST(regexp_extract(name,
              '(?i)v(\\d+)', 1) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(regexp_extract(name, '(?i)v(\\d+)', 1) AS BIGINT)
              AS VARCHAR))) AS INTEGER), '0') ELSE 'v01' END || extension AS target_path
    FROM fx_flagged WHERE NOT is_duplicate AND NOT is_temp AND NOT ({MIXED_STALE})
    AND file_category IN ('documents', 'media', 'code', 'archives')""")
def _(t: Tables):
    return planning.reorganise(flagged(t), rename=True).select("file_id", "target_path")


BIG_ACTIONS = "SELECT file_id AS action_id, '/flat/' || part_name AS target_path FROM (SELECT 'p' || p_partkey AS file_id, p_name || '.pdf' AS part_name FROM part)"


def part_actions(t: Tables):
    return t.read("part").selectExpr("concat('p', p_partkey) action_id", "concat('/flat/', p_name, '.pdf') target_path",
                                     "concat('/in/', p_partkey, '.pdf') source_path", "cast(p_size as bigint) file_size")


@query("plan_conflict_names", "W3", f"""
    SELECT action_id, target_path, CASE WHEN n = 1 THEN target_path ELSE regexp_replace(target_path, '\\.pdf$', '') || '_' || (n - 1)
           || '.pdf' END AS resolved_path FROM (
        SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY md5(action_id), action_id) AS n FROM ({BIG_ACTIONS}))""")
def _(t: Tables):
    return planning.resolve_names(part_actions(t)).select("action_id", "target_path", "resolved_path")


@query("plan_conflict_existing", "W3 P9", f"""
    SELECT action_id, CASE WHEN k = 0 THEN target_path ELSE regexp_replace(target_path, '\\.pdf$', '') || '_' || k || '.pdf' END
           AS resolved_path FROM (
        SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY md5(action_id), action_id) - 1
               + CASE WHEN contains(target_path, 'red') THEN 2 ELSE 0 END AS k FROM ({BIG_ACTIONS}))""")
def _(t: Tables):
    """Names with red exist already, and so do their first numbers."""
    red = part_actions(t).where(F.contains("target_path", F.lit("red"))).select(F.col("target_path").alias("path"))
    on_disk = red.unionByName(red.select(F.regexp_replace("path", r"\.pdf$", "_1.pdf").alias("path")))
    return planning.resolve_names(part_actions(t), on_disk).select("action_id", "resolved_path")


@query("plan_conflict_largest", "P8", """
    SELECT action_id, target_path, file_size FROM (SELECT 'p' || p_partkey AS action_id, '/flat/' || p_name || '.pdf' AS target_path,
           CAST(p_size AS BIGINT) AS file_size, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, 'p' || p_partkey DESC) AS n
           FROM part) WHERE n = 1""")
def _(t: Tables):
    return planning.apply_conflict_policy(part_actions(t), "largest").select("action_id", "target_path", "file_size")


INVENTORY = "SELECT '/Repository/documents/' || name AS path FROM fx_flagged WHERE extension = '.pdf'"


def on_disk(t: Tables):
    return t.files.where("extension = '.pdf'").select(F.concat(F.lit("/Repository/documents/"), "name").alias("path"))


STAGED = f"""SELECT f.file_id, f.path AS source_path, '/staging/' || replace(file_category, '_', '/') || '/' || name AS staging_path,
    '/Repository/' || replace(file_category, '_', '/') || '/' || name AS target_path, size_bytes AS file_size,
    CASE WHEN i.path IS NOT NULL THEN 'existing_file' END AS conflict_type FROM fx_flagged f LEFT JOIN ({INVENTORY}) i
    ON i.path = '/Repository/' || replace(file_category, '_', '/') || '/' || name
    WHERE NOT is_duplicate AND NOT is_temp AND NOT ({MIXED_STALE})"""


@query("plan_staging_conflicts", "P5", STAGED)
def _(t: Tables):
    return planning.staging(flagged(t), on_disk(t)).select(
        "file_id", "source_path", "staging_path", "target_path", "file_size", "conflict_type")


@query("plan_staging_summary", "A34", f"""
    SELECT count(*) AS action_count, count(conflict_type) AS conflict_count FROM ({STAGED})""")
def _(t: Tables):
    return planning.staging_summary(planning.staging(flagged(t), on_disk(t)))


@query("plan_staging_by_plan", "J5 A34", f"""
    SELECT p.root_id AS plan_id, count(s.file_id) AS action_count, count(s.conflict_type) AS conflict_count
    FROM (SELECT DISTINCT root_id FROM fx_files) p LEFT JOIN ({STAGED}) s ON starts_with(s.source_path, '/' || p.root_id || '/') GROUP BY 1""")
def _(t: Tables):
    actions = planning.staging(flagged(t), on_disk(t)).withColumn("plan_id", F.split("source_path", "/")[1])
    plans = t.files.select(F.col("root_id").alias("plan_id")).distinct()
    return planning.plans_with_counts(plans, actions)


@query("plan_staging_validate", "P6 J5", f"""
    SELECT count(*) FILTER (i.path IS NULL) AS unreadable_sources, count(*) FILTER (length(target_path) > 260) AS long_paths,
           CAST(coalesce(sum(i.size_bytes), 0) AS BIGINT) AS required_bytes, count(conflict_type) AS unresolved_conflicts,
           1000000000 > coalesce(sum(i.size_bytes), 0) * 1.1 AS space_ok,
           count(conflict_type) = 0 AND count(*) FILTER (i.path IS NULL) = 0 AS passed
    FROM ({STAGED}) s LEFT JOIN (SELECT path, size_bytes FROM fx_files WHERE extension <> '.zip') i ON s.source_path = i.path""")
def _(t: Tables):
    inventory = t.files.where("extension <> '.zip'").select("path", "size_bytes")
    return planning.validate_staging(planning.staging(flagged(t), on_disk(t)), inventory, 1_000_000_000)


PLAN_EVENTS = """SELECT user_id AS plan_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'staged'
    WHEN 'click' THEN 'validated' WHEN 'purchase' THEN 'committed' ELSE 'discarded' END AS status FROM events"""


@query("plan_status", "P7", f"""
    SELECT plan_id, arg_max(status, seq) AS status, bool_and(ok) AS is_valid FROM (
        SELECT *, CASE WHEN prev IS NULL THEN status = 'draft' ELSE prev || '>' || status IN ('draft>staged', 'staged>validated',
               'validated>committed', 'draft>discarded', 'staged>discarded', 'validated>discarded') END AS ok FROM (
            SELECT *, lag(status) OVER (PARTITION BY plan_id ORDER BY seq) AS prev FROM ({PLAN_EVENTS}))) GROUP BY plan_id""")
def _(t: Tables):
    events = t.read("events").selectExpr(
        "user_id plan_id", "event_id seq", "case event_type when 'signup' then 'draft' when 'view' then 'staged' when 'click' "
        "then 'validated' when 'purchase' then 'committed' else 'discarded' end status")
    return planning.plan_status(events)


@query("plan_outcome", "P9", f"""
    SELECT outcome, count(*) AS count FROM (
        SELECT CASE WHEN p_size > 25 THEN 'failed' WHEN n > 1 THEN 'renamed' ELSE 'moved' END AS outcome FROM (
            SELECT p_size, row_number() OVER (PARTITION BY p_name ORDER BY md5('p' || p_partkey)) AS n FROM part)) GROUP BY 1""")
def _(t: Tables):
    actions = part_actions(t)
    present = actions.where("file_size <= 25").select(F.col("source_path").alias("path"))
    return planning.outcome(actions, present).groupBy("outcome").agg(F.count("*").alias("count"))


@query("plan_rollback", "P9", """
    SELECT -p_partkey AS undo_order, '/flat/' || p_name || '.pdf' AS wanted, '/in/' || p_partkey || '.pdf' AS target_path FROM part
    WHERE p_size <= 25""")
def _(t: Tables):
    actions = part_actions(t).join(t.read("part").selectExpr("concat('p', p_partkey) action_id", "p_partkey step"), "action_id")
    present = actions.where("file_size <= 25").select(F.col("source_path").alias("path"))
    back = planning.rollback_list(planning.outcome(actions, present))
    return back.select("undo_order", F.regexp_replace("source_path", r"_\d+\.pdf$", ".pdf").alias("wanted"), "target_path")


DOC_DOMAINS = rs.case([(f"document_type = {rs.text(k)}", rs.text(d)) for k, d in organise.domain_rows()], "'fallback'")
EXT_OF = "ltrim(regexp_extract(file_name, '(\\.[^.]+)$', 1), '.')"
STEM_OF = "split_part(file_name, '.', 1)"


def clean_name(expr: str) -> str:
    expr = f"regexp_replace({expr}, '[<>:\"|?*\\\\/]', '_', 'g')"
    return f"trim(regexp_replace({expr}, '[_\\s]+', '_', 'g'), '_. ')"


@query("plan_domains", "P10 J10 X17 X19", f"""
    SELECT file_id, domain, '/Organized/' || CASE domain
           WHEN 'financial' THEN 'Financial/' || document_type || '/' || strftime(created_at, '%Y/%m') || '/' || {clean_name(
               "strftime(created_at, '%Y-%m-%d') || '_{vendor}_' || coalesce(inv, '{invoice_id}') || '_' || " + STEM_OF + " || '.' || " + EXT_OF)}
           WHEN 'technical' THEN 'Technical/' || document_type || '/{{project}}/' || {clean_name(
               "strftime(created_at, '%Y-%m-%d') || '_{product}_{version}_' || " + STEM_OF + " || '.' || " + EXT_OF)}
           WHEN 'general' THEN 'General/' || strftime(created_at, '%Y/%m') || '/' || {clean_name(
               "strftime(created_at, '%Y-%m-%d') || '_' || " + STEM_OF + " || '.' || " + EXT_OF)}
           ELSE 'Uncategorized/' || {EXT_OF} || '/' || strftime(created_at, '%Y-%m') || '/' || {clean_name(
               "strftime(created_at, '%Y-%m-%d') || '_' || " + STEM_OF + " || '.' || " + EXT_OF)} END AS target_path
    FROM (SELECT *, {DOC_DOMAINS} AS domain, nullif(regexp_extract(text, '(?i)(?:Invoice|INV|Order|#)\\s*:?\\s*([A-Z0-9-]+)', 1), '') AS inv
          FROM fx_registry)""")
def _(t: Tables):
    docs = t.registry.withColumn("processing_timestamp", F.col("created_at"))
    return organise.domain_plan(docs, text_col="text").select("file_id", "domain", "target_path")


CANONICAL = f"""SELECT file_id, original_path, canonical_path, domain, '/Canonical/' || CASE domain
    WHEN 'financial' THEN 'Financial/Invoice/' || y || '/' || coalesce(m, '{{MM}}') || '/' || coalesce(d, '{{YYYY-MM-DD}}') || '_'
         || coalesce(nullif(regexp_extract(file_name, '^([A-Za-z]+)_', 1), ''), 'Unknown') || '_' || file_name
    WHEN 'technical' THEN 'Technical/Manual/' || file_name WHEN 'general' THEN 'General/' || y || '/' || file_name
    ELSE 'General/' || file_name END AS target_path FROM (
        SELECT *, {DOC_DOMAINS} AS domain, coalesce(left(full_date, 4), loose, '2024') AS y,
               coalesce(substr(full_date, 6, 2), CASE WHEN loose IS NULL THEN '01' ELSE nullif(regexp_extract(file_name,
                        '[-_](\\d{{2}})[-_]', 1), '') END) AS m,
               coalesce(full_date, CASE WHEN loose IS NULL THEN '2024-01-31' END) AS d FROM (
            SELECT *, nullif(replace(regexp_extract(file_name, '(\\d{{4}}[-_]\\d{{2}}[-_]\\d{{2}})', 1), '_', '-'), '') AS full_date,
                   nullif(regexp_extract(file_name, '(\\d{{4}})', 1), '') AS loose FROM fx_registry))"""


@query("plan_canonical", "P11 X15 X18 X20", f"SELECT file_id, target_path FROM ({CANONICAL})")
def _(t: Tables):
    return organise.canonical_plan(t.registry, as_of=REGISTRY_CLOCK).select("file_id", "target_path")


@query("plan_replan", "P11 C14", f"""
    SELECT file_id, target_path FROM ({CANONICAL}) WHERE canonical_path IS DISTINCT FROM target_path""")
def _(t: Tables):
    return organise.replan(t.registry, as_of=REGISTRY_CLOCK).select("file_id", "target_path")


FUNCTION = rs.case([(f"document_type = {rs.text(k)}", rs.text("/".join(f))) for k, f in tables.FUNCTION_FOLDERS.items()])


@query("plan_functions", "P12 J11", f"""
    SELECT file_id, '/Organized/' || {FUNCTION} || '/' || file_name AS new_path FROM fx_registry WHERE {FUNCTION} IS NOT NULL""")
def _(t: Tables):
    moves, _ = organise.function_plan(t.registry.withColumn("file_path", F.col("original_path")))
    return moves.select("file_id", "new_path")


@query("plan_function_counts", "A44", f"""
    SELECT split_part({FUNCTION}, '/', 1) AS domain, count(*) AS count FROM fx_registry WHERE {FUNCTION} IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    moves, _ = organise.function_plan(t.registry.withColumn("file_path", F.col("original_path")))
    return organise.domain_counts(moves)


@query("plan_media", "P13 A49", """
    SELECT file_id, CASE extension WHEN '.mp4' THEN 'video' ELSE 'image' END AS media_kind,
           CASE extension WHEN '.mp4' THEN '/Videos/' ELSE '/Pictures/' END || name AS target_path FROM fx_files_big WHERE extension = '.mp4'""")
def _(t: Tables):
    return organise.media_plan(t.files_big).select("file_id", "media_kind", "target_path")


@query("plan_templates", "P14 X16 X18", r"""
    SELECT file_id, 'Financial/financial_invoice'
    AS folder FROM fx_registry WHERE document_type = 'financial_invoice'""".replace("'Financial/financial_invoice'", "'Financial/UNKNOWN/' || strftime(created_at, '%Y/%m')"))
def _(t: Tables):
    docs = t.registry.where("document_type = 'financial_invoice'").withColumn("modified_at", F.col("created_at"))
    planned = organise.template_plan(docs)
    return planned.select("file_id", F.regexp_extract("target_path", "^(.*)/[^/]*$", 1).alias("folder"))


@query("plan_retention", "P18", f"""
    SELECT file_id, domain, CASE domain WHEN 'legal' THEN 7 WHEN 'tax' THEN 7 WHEN 'medical' THEN 10 WHEN 'insurance' THEN 10 END AS retention_years,
           coalesce(CASE WHEN domain IN ('legal', 'tax') THEN CAST(created_at + INTERVAL 7 YEAR AS DATE) WHEN domain IN ('medical', 'insurance')
                    THEN CAST(created_at + INTERVAL 10 YEAR AS DATE) END < DATE '2034-01-01', FALSE) AS retention_over,
           CASE WHEN date_diff('day', CAST(accessed_at AS DATE), DATE '2034-01-01') >= 4000 THEN
           'Archive/' || domain || '/' || strftime(accessed_at, '%Y') || '/' || name END AS archive_target FROM (
        SELECT f.*, CASE c.correct_type WHEN 'medical' THEN 'medical' WHEN 'legal_contract' THEN 'legal' END AS domain
        FROM fx_files f JOIN fx_corrections c ON f.doc_id = c.file_id)""")
def _(t: Tables):
    typed = t.files.join(t.corrections.select(F.col("file_id").alias("doc_id"), F.col("correct_type").alias("document_type")), "doc_id")
    kept = lifecycle.retention(organise.with_domain(typed), archive_days=4000, as_of="2034-01-01 00:00:00")
    return kept.select("file_id", "domain", F.col("retention_years").cast("int").alias("retention_years"), "retention_over", "archive_target")


@query("movable_files", "F12", f"SELECT file_id FROM fx_flagged WHERE NOT is_duplicate AND NOT is_temp AND NOT ({MIXED_STALE})")
def _(t: Tables):
    return flags.movable(flagged(t)).select("file_id")


@query("movable_with_keepers", "F12", f"""
    SELECT file_id FROM fx_flagged WHERE (NOT is_duplicate OR is_canonical) AND NOT is_temp AND NOT ({MIXED_STALE})""")
def _(t: Tables):
    return flags.movable(flagged(t), "non_canonical").select("file_id")


CLAIMS = """SELECT 'p' || p_partkey AS action_id, '/flat/' || left(p_name, 6) || '.pdf' AS target_path, CAST(p_size AS BIGINT) AS file_size,
    TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INTEGER)) AS modified_at,
    CASE WHEN p_name LIKE 'a%' THEN 'existing_file' END AS conflict_type FROM part"""


def claims(t: Tables):
    """Many actions a target, and targets that exist already."""
    return t.read("part").selectExpr(
        "concat('p', p_partkey) action_id", "concat('/flat/', left(p_name, 6), '.pdf') target_path", "CAST(p_size AS BIGINT) file_size",
        "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, p_size) modified_at", "CASE WHEN p_name LIKE 'a%' THEN 'existing_file' END conflict_type")


def _winner(policy: str, order: str, condition: str = "TRUE") -> None:
    @query(f"plan_conflict_{policy}", "P8", f"""
        SELECT action_id, target_path, '{policy}' AS resolution_strategy FROM (
            SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY {order}) AS n FROM ({CLAIMS})) WHERE n = 1 AND {condition}""")
    def _(t: Tables):
        return planning.apply_conflict_policy(claims(t), policy).select("action_id", "target_path", "resolution_strategy")


_winner("skip", "action_id", "conflict_type IS NULL")
_winner("replace", "action_id DESC")
_winner("newest", "modified_at DESC, action_id DESC")


@query("plan_conflict_ask", "P8", f"SELECT action_id, target_path AS resolved_path FROM ({CLAIMS})")
def _(t: Tables):
    return planning.apply_conflict_policy(claims(t), "ask").select("action_id", "resolved_path")


@query("plan_conflict_rename", "P8 W3", f"""
    SELECT action_id, CASE WHEN n = 1 THEN target_path ELSE regexp_replace(target_path, '\\.pdf$', '') || '_' || (n - 1) || '.pdf' END AS resolved_path
    FROM (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY md5(action_id), action_id) AS n FROM ({CLAIMS}))""")
def _(t: Tables):
    return planning.apply_conflict_policy(claims(t), "rename").select("action_id", "resolved_path")
