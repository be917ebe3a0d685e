"""Duplicate groups, keepers, consolidation, fuzzy names."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.names import COPY_MARKERS
from shelfmark.operators import dedup, flags, fuzzy
from shelfmark.plans.fixtures import PREFERRED, Tables
from shelfmark.plans.registry import query


@query("dup_candidates", "D1 F2", """
    SELECT size_bytes, extension, count(*) AS member_count FROM fx_files WHERE size_bytes > 0
    GROUP BY ALL HAVING count(*) > 1""")
def _(t: Tables):
    return dedup.candidate_blocks(t.files).drop("block_id")


@query("dup_block_members", "A55 D1", """
    SELECT * FROM (SELECT file_id, size_bytes, extension,
                          count(*) OVER (PARTITION BY size_bytes, extension) AS member_count
                   FROM fx_files WHERE size_bytes > 0) WHERE member_count > 1""")
def _(t: Tables):
    return dedup.block_members(t.files).select("file_id", "size_bytes", "extension", "member_count")


@query("dup_exact_groups", "D2 D4 W2", """
    SELECT group_id, any_value(size_bytes) AS size_bytes, any_value(extension) AS extension, count(*) AS member_count,
           max(CASE WHEN is_canonical THEN file_id END) AS canonical_file, max(size_bytes) AS total_size,
           'exact' AS similarity_type, CAST(sum(size_bytes) - max(size_bytes) AS BIGINT) AS space_wasted
    FROM fx_members GROUP BY group_id""")
def _(t: Tables):
    return t.groups.select("group_id", "size_bytes", "extension", "member_count", "canonical_file", "total_size",
                           "similarity_type", "space_wasted")


@query("dup_canonical", "W2 D4", """
    SELECT group_id, file_id, CAST(score AS BIGINT) AS priority_score,
           CASE WHEN is_canonical THEN 'Canonical copy' ELSE 'Duplicate' END AS reason, is_canonical FROM fx_members""")
def _(t: Tables):
    return t.members


@query("dup_flags", "D5", """
    SELECT file_id, is_duplicate, duplicate_group, is_canonical FROM fx_flagged""")
def _(t: Tables):
    return t.flagged.select("file_id", "is_duplicate", "duplicate_group", "is_canonical")


@query("dup_metrics", "A9", """
    SELECT 'exact' AS similarity_type, count(*) AS duplicate_sets, CAST(sum(member_count - 1) AS BIGINT)
           AS total_duplicate_files, CAST(sum((member_count - 1) * total_size) AS BIGINT) AS wasted_space
    FROM fx_groups GROUP BY 1""")
def _(t: Tables):
    return dedup.duplication_metrics(t.groups)


@query("dup_session_groups", "J1 F1", """
    SELECT g.group_id, g.canonical_file, f.path AS canonical_path, g.member_count
    FROM fx_groups g JOIN fx_files f ON g.canonical_file = f.file_id""")
def _(t: Tables):
    in_session = flags.in_session(t.files.withColumn("scan_session_id", F.lit("s1")), "s1")
    return dedup.session_groups(t.groups, in_session).select("group_id", "canonical_file", "canonical_path", "member_count")


@query("dup_redundant_copies", "J2", """
    SELECT group_id, file_id, path, size_bytes FROM fx_members WHERE NOT is_canonical""")
def _(t: Tables):
    return dedup.redundant_copies(t.files, t.members).select("group_id", "file_id", "path", "size_bytes")


@query("dup_consolidate", "W1 D6", """
    SELECT path, content_hash, priority, rn = 1 AS is_original, CASE WHEN rn > 1 THEN keeper END AS duplicate_of FROM (
        SELECT *, row_number() OVER w AS rn, first_value(path) OVER w AS keeper FROM (
            SELECT path, hash_full AS content_hash, doc_id % 4 AS priority FROM fx_files)
        WINDOW w AS (PARTITION BY content_hash ORDER BY priority DESC, path))""")
def _(t: Tables):
    rows = t.files.select("path", F.col("hash_full").alias("content_hash"), F.col("access_count").alias("priority"))
    return dedup.consolidate(rows)


@query("dup_consolidate_counts", "A46", """
    SELECT count(*) AS scanned, count(DISTINCT hash_full) AS unique_files,
           count(*) - count(DISTINCT hash_full) AS duplicates FROM fx_files""")
def _(t: Tables):
    rows = t.files.select("path", F.col("hash_full").alias("content_hash"), F.col("access_count").alias("priority"))
    return dedup.consolidation_counts(dedup.consolidate(rows))


@query("dup_root_keeper", "W5", """
    SELECT hash_quick, copies, file_id AS canonical_file, path AS canonical_path, root_id FROM (
        SELECT *, count(*) OVER (PARTITION BY hash_quick) AS copies, row_number() OVER (PARTITION BY hash_quick ORDER BY
               CASE WHEN root_id = 'src1' THEN 90 ELSE 50 END DESC, modified_at DESC,
               length(name) - length(extension) DESC, file_id) AS rn FROM fx_files) WHERE rn = 1 AND copies > 1""")
def _(t: Tables):
    rows = t.files.withColumn("root_priority", F.when(F.col("root_id") == "src1", 90))
    return dedup.keeper_by_root(rows)


@query("dup_registry_summary", "A22", """
    SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_duplicates,
           CAST(coalesce(sum(bytes * (n - 1)), 0) AS BIGINT) AS wasted_space,
           CAST(coalesce(sum(bytes - largest), 0) AS BIGINT) AS reclaimable_bytes FROM (
        SELECT count(*) AS n, sum(file_size) AS bytes, max(file_size) AS largest FROM fx_registry
        GROUP BY content_hash HAVING count(*) > 1)""")
def _(t: Tables):
    return dedup.duplicate_summary(t.registry)


def normalized_sql(column: str) -> str:
    for pattern in COPY_MARKERS:
        column = f"regexp_replace({column}, '(?i){pattern}', '', 'g')"
    return f"trim(lower({column}))"


FUZZY_PAIRS = f"""
    WITH rows_ AS (SELECT file_id, folder, size_bytes, size_bytes // 1024 AS kb, {normalized_sql('name')} AS norm FROM fx_names),
    prof AS (SELECT folder, kb, norm, size_bytes, min(file_id) AS rep FROM rows_ GROUP BY ALL)
    SELECT p.rep AS file_a, r.file_id AS file_b, CAST(1 AS DOUBLE) AS similarity, 'same_name' AS relation
    FROM rows_ r JOIN prof p USING (folder, kb, norm, size_bytes) WHERE r.file_id <> p.rep
    UNION ALL
    SELECT * FROM (
        SELECT a.rep AS file_a, b.rep AS file_b, round(1 - levenshtein(a.norm, b.norm)
               / CAST(greatest(length(a.norm), length(b.norm), 1) AS DOUBLE), 6) AS similarity, 'similar_name' AS relation
        FROM prof a JOIN prof b ON a.folder = b.folder AND a.kb = b.kb AND a.rep < b.rep
         AND abs(a.size_bytes - b.size_bytes) <= CAST(a.size_bytes AS DOUBLE) * 0.1) WHERE similarity >= 0.7"""


@query("fuzzy_names_levenshtein", "D3 J13 X1", FUZZY_PAIRS)
def _(t: Tables):
    return levenshtein_pairs(t).withColumn("similarity", F.round("similarity", 6))


def levenshtein_pairs(t: Tables):
    return fuzzy.fuzzy_pairs(flags.exact_candidates(t.names, 1024), threshold=0.7, measure="levenshtein")


@query("dup_components", "D8", f"""SELECT * FROM (
    WITH RECURSIVE p AS (SELECT file_a, file_b FROM ({FUZZY_PAIRS})),
    e AS (SELECT file_a AS x, file_b AS y FROM p UNION SELECT file_b, file_a FROM p),
    r AS (SELECT x AS file_id, x AS reached FROM e UNION SELECT r.file_id, e.y FROM r JOIN e ON r.reached = e.x)
    SELECT file_id, min(reached) AS group_id FROM r GROUP BY 1)""")
def _(t: Tables):
    return fuzzy.linked_groups(levenshtein_pairs(t))



@query("fuzzy_names_ratio", "D3 X25")
def _(t: Tables):
    candidates = flags.fuzzy_candidates(t.names.withColumn("is_duplicate", F.lit(False)))
    return fuzzy.fuzzy_pairs(candidates).withColumn("similarity", F.round("similarity", 6))


@query("fuzzy_groups", "D3 D4 Q7")
def _(t: Tables):
    return fuzzy.pair_groups(fuzzy.fuzzy_pairs(t.names), t.names)
