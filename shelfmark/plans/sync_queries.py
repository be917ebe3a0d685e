"""Sync decisions, root comparisons, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import globs
from shelfmark.operators import compare, flags, sync
from shelfmark.plans.fixtures import Tables
from shelfmark.plans.registry import query

DECIDED = """SELECT c.event_id, c.path, c.size, local_modified > modified_at AS newer, change_type,
    coalesce(c.size, 0) <= 20000 AND NOT regexp_matches(c.path, 'f3$') AS selected FROM fx_changes c LEFT JOIN fx_local l ON c.path = l.path"""


def action_sql(local_wins: str) -> str:
    return f"""CASE WHEN NOT selected THEN 'skip_filtered' WHEN change_type = 'deleted' THEN 'ignore'
        WHEN coalesce(newer, FALSE) THEN '{local_wins}' ELSE 'download' END"""


def decisions(t: Tables, policy: str = sync.NEWER_WINS):
    return sync.sync_decisions(t.changes, t.local_state, policy, max_size=20000, exclude=["*f3"])


@query("plan_sync", "P17 J15 F11", f"SELECT event_id, path, {action_sql('local_wins')} AS action FROM ({DECIDED})")
def _(t: Tables):
    return decisions(t).select("event_id", "path", "action")


@query("plan_sync_keep_both", "P17", f"""
    SELECT event_id, {action_sql('keep_both')} AS action, CASE WHEN {action_sql('keep_both')} = 'keep_both' THEN path || '.local' END
           AS backup_path FROM ({DECIDED})""")
def _(t: Tables):
    return decisions(t, sync.KEEP_BOTH).select("event_id", "action", "backup_path")


@query("sync_totals", "A53", f"""
    SELECT count(*) AS files_scanned, count(*) FILTER (action = 'download') AS files_downloaded,
           count(*) FILTER (action IN ('skip_filtered', 'local_wins')) AS files_skipped,
           count(*) FILTER (action = 'local_wins') AS files_conflicted,
           CAST(sum(CASE WHEN action = 'download' THEN size ELSE 0 END) AS BIGINT) AS bytes_transferred
    FROM (SELECT *, {action_sql('local_wins')} AS action FROM ({DECIDED}))""")
def _(t: Tables):
    return sync.sync_totals(decisions(t))


@query("sync_push", "P17", """
    SELECT l.path, coalesce(r.remote_modified > l.local_modified, FALSE) AS is_conflict FROM fx_local l LEFT JOIN (
        SELECT path, max(modified_at) AS remote_modified FROM fx_changes WHERE change_type = 'renamed' GROUP BY path) r ON l.path = r.path""")
def _(t: Tables):
    remote = t.changes.where("change_type = 'renamed'").groupBy("path").agg(F.max("modified_at").alias("remote_modified"))
    return sync.push_decisions(t.local_state, remote).select("path", "is_conflict")


@query("sync_filter", "F11 S2", r"""
    SELECT file_id, size_bytes <= 8000 AND NOT regexp_matches(name, '^report_.*\.pdf$') AND regexp_matches(path, '\.(pdf|txt|md)$') AS selected
    FROM fx_files""")
def _(t: Tables):
    chosen = globs.sync_selected(F.col("path"), F.col("size_bytes"), 8000, ["report_*.pdf"], ["*.pdf", "*.txt", "*.md"])
    return t.files.select("file_id", chosen.alias("selected"))


@query("scan_exclusions", "S2 S3", """
    SELECT file_id, extension = '.tmp' OR root_id = 'src3' AS is_excluded FROM fx_files WHERE size_bytes <= 10000""")
def _(t: Tables):
    small = t.files.where(F.col("size_bytes") <= 10000)
    return small.select("file_id", globs.excluded(F.col("path"), ["*.TMP"], ["src3"]).alias("is_excluded"))


@query("placeholder_decision", "F18", """
    SELECT event_id, event_type NOT IN ('view', 'error') AS should_process, CASE event_type WHEN 'error' THEN 'Error: unknown'
           WHEN 'view' THEN 'Skipping online-only file' ELSE 'File is available' END AS reason FROM events""")
def _(t: Tables):
    status = F.when(F.col("event_type") == "view", "online_only").when(F.col("event_type") == "error", "error").otherwise("synced")
    rows = t.read("events").select("event_id", flags.placeholder_decision(status, "skip").alias("d"))
    return rows.select("event_id", "d.should_process", "d.reason")


@query("latest_change_state", "R4", """
    WITH spread AS (
        SELECT event_id, path, CASE WHEN change_type = 'renamed' THEN 'created' ELSE change_type END AS change_type, size, modified_at FROM fx_changes
        UNION ALL SELECT event_id, old_path, 'deleted', size, modified_at FROM fx_changes WHERE change_type = 'renamed')
    SELECT path, change_type AS last_change, size, change_type <> 'deleted' AS exists, changes FROM (
        SELECT *, count(*) OVER (PARTITION BY path) AS changes,
               row_number() OVER (PARTITION BY path ORDER BY modified_at DESC, event_id DESC) AS n FROM spread) WHERE n = 1""")
def _(t: Tables):
    return sync.latest_state(t.changes).drop("modified_at")


@query("cross_root_dups", "A50", """
    SELECT hash_quick, count(DISTINCT root_id) AS root_count, count(*) AS total_copies, string_agg(DISTINCT root_id, ',' ORDER BY root_id)
           AS roots, min(size_bytes) AS size FROM fx_roots GROUP BY hash_quick HAVING count(DISTINCT root_id) > 1""")
def _(t: Tables):
    return compare.cross_root_duplicates(t.roots)


@query("cross_root_copies", "A50", """
    SELECT hash_quick, root_id, relative_path FROM fx_roots WHERE hash_quick IN (
        SELECT hash_quick FROM fx_roots GROUP BY 1 HAVING count(DISTINCT root_id) > 1)""")
def _(t: Tables):
    return compare.cross_root_copies(t.roots, compare.cross_root_duplicates(t.roots))


@query("path_conflicts", "A51", """
    SELECT relative_path, count(DISTINCT hash_quick) AS version_count, count(DISTINCT root_id) AS root_count, count(*) AS copies FROM fx_roots
    GROUP BY 1 HAVING count(DISTINCT hash_quick) > 1 AND count(DISTINCT root_id) > 1""")
def _(t: Tables):
    return compare.path_conflicts(t.roots)


PATHS = """SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, a.h AS hash_a, b.h AS hash_b,
    CASE WHEN b.relative_path IS NULL THEN 'only_a' WHEN a.relative_path IS NULL THEN 'only_b' WHEN a.h = b.h THEN 'identical'
    ELSE 'different' END AS status
    FROM (SELECT relative_path, max(hash_quick) AS h FROM fx_roots WHERE root_id = 'F' GROUP BY 1) a
    FULL JOIN (SELECT relative_path, max(hash_quick) AS h FROM fx_roots WHERE root_id = 'O' GROUP BY 1) b ON a.relative_path = b.relative_path"""


@query("compare_paths", "J17 O4", PATHS)
def _(t: Tables):
    return compare.compare_paths(t.roots, "F", "O")


COMPARED = f"""SELECT count(*) FILTER (status = 'identical') AS identical_files, count(*) FILTER (status = 'different') AS files_different,
    count(*) FILTER (status = 'only_a') AS files_only_a, count(*) FILTER (status = 'only_b') AS files_only_b,
    round(100.0 * count(*) FILTER (status = 'identical') / count(*), 2) AS sync_score FROM ({PATHS})"""


@query("compare_roots", "J17 O4", COMPARED)
def _(t: Tables):
    return compare.compare_roots(t.roots, "F", "O")


@query("audit_sync", "O5", f"""
    SELECT *, CASE WHEN sync_score < 50 THEN 'critical' ELSE 'warning' END AS severity, files_only_a + files_only_b AS missing_files,
           files_different AS conflicts FROM ({COMPARED}) WHERE sync_score < 95""")
def _(t: Tables):
    return compare.audit_sync(compare.compare_roots(t.roots, "F", "O"))


RECONCILED = """WITH disk AS (SELECT DISTINCT content_hash, CASE WHEN canonical_state = 'organized' THEN canonical_path ELSE original_path END AS path
        FROM fx_registry WHERE document_type IS DISTINCT FROM 'unknown'),
    reg AS (SELECT content_hash, file_id, coalesce(canonical_path, '/lost/' || file_name) AS canonical_path FROM fx_registry
        WHERE classification_method IS NOT NULL),
    spots AS (SELECT d.content_hash, min(d.path) FILTER (h.path IS NULL) AS free_path, min(d.path) AS any_path
        FROM disk d LEFT JOIN (SELECT DISTINCT content_hash, canonical_path AS path FROM reg) h ON d.content_hash = h.content_hash AND d.path = h.path
        GROUP BY 1),
    placed AS (SELECT r.*, CASE WHEN d.path IS NOT NULL THEN 'in_place' WHEN s.any_path IS NOT NULL THEN 'moved' ELSE 'missing' END AS status,
            coalesce(d.path, s.free_path, s.any_path) AS disk_path
        FROM reg r LEFT JOIN disk d ON r.content_hash = d.content_hash AND r.canonical_path = d.path LEFT JOIN spots s ON r.content_hash = s.content_hash)"""
RECONCILED_ROWS = RECONCILED + """
    SELECT content_hash, file_id, disk_path, status FROM placed
    UNION ALL SELECT content_hash, NULL, any_path, 'new' FROM spots WHERE content_hash NOT IN (SELECT content_hash FROM reg)"""


def reconciled(t: Tables):
    path = F.when(F.col("canonical_state") == "organized", F.col("canonical_path")).otherwise(F.col("original_path"))
    disk = t.registry.where("document_type is distinct from 'unknown'").select("content_hash", path.alias("path"))
    known = t.registry.where("classification_method is not null").withColumn(
        "canonical_path", F.coalesce("canonical_path", F.concat(F.lit("/lost/"), "file_name")))
    return compare.reconcile(disk, known)


@query("reconcile_hash", "J14 U10", RECONCILED_ROWS)
def _(t: Tables):
    return reconciled(t).select("content_hash", "file_id", "disk_path", "status")


@query("scan_difference", "J18", """
    SELECT source_id, count(*) FILTER (NOT in_old) AS new_files, count(*) FILTER (in_old AND in_new AND changed) AS updated_files,
           count(*) FILTER (NOT in_new) AS deleted_files, count(*) FILTER (in_old AND in_new AND NOT changed) AS unchanged_files
    FROM (SELECT source_id, document_type IS NOT NULL AS in_old, document_type IS DISTINCT FROM 'unknown' AS in_new,
                 canonical_state = 'pending' AS changed FROM fx_registry) WHERE in_old OR in_new GROUP BY 1""")
def _(t: Tables):
    rows = t.registry.selectExpr("source_id", "original_path path", "content_hash", "file_size size_bytes", "created_at modified_at",
                                 "document_type", "canonical_state")
    before = rows.where("document_type is not null")
    after = rows.where("document_type is distinct from 'unknown'").withColumn(
        "size_bytes", F.when(F.col("canonical_state") == "pending", F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return compare.scan_difference(before, after)
