"""Text statistics, keywords, metadata, page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import names, paths
from shelfmark.functions import text as tx
from shelfmark.functions.scale import top_per_group
from shelfmark.functions.similarity import sequence_ratio
from shelfmark.operators import organise
from shelfmark.plans import rule_sql as rs
from shelfmark.plans.fixtures import REGISTRY_CLOCK, Tables
from shelfmark.plans.registry import query

STOP = ", ".join(rs.text(w) for w in tx.STOP_WORDS)


@query("text_stats", "T1 T8", f"""
    SELECT doc_id, length(text) AS char_count, len(w) AS word_count,
           greatest(len(regexp_extract_all(text, '[.!?]+(?:\\s|$)')), 1) AS sentence_count,
           len(list_distinct(list_filter(w, lambda x: x NOT IN ({STOP})))) AS unique_words,
           round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / CAST(nullif(len(w), 0) AS DOUBLE), 0), 6) AS avg_word_length
    FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)""")
def _(t: Tables):
    return t.base.select("doc_id", tx.statistics(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("text_stats_turns", "T1", """
    SELECT conv_id, turn, length(text) AS char_count, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word_count
    FROM conversations""")
def _(t: Tables):
    rows = t.read("conversations").select("conv_id", "turn", tx.statistics(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", "s.char_count", "s.word_count")


def keywords(docs, n: int = 20, min_length: int = 3):
    """Most frequent words per text, stop words left out."""
    words = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("word")).where(
        (F.length("word") >= min_length) & ~F.col("word").isin(*tx.STOP_WORDS)
    )
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("count"))
    return top_per_group(counted, ["doc_id"], [F.desc("count"), F.asc("word")], n)


@query("text_keywords", "T2 L6", f"""
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, word COLLATE "C") AS INTEGER) AS rank
        FROM (SELECT doc_id, word, count(*) AS count FROM (
            SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents)
        WHERE length(word) >= 3 AND word NOT IN ({STOP}) GROUP BY ALL)) WHERE rank <= 20""".replace(' COLLATE "C"', ""))
def _(t: Tables):
    return keywords(t.base)


@query("text_sentiment", "T3", f"""
    SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM (
        SELECT doc_id, {rs.hits('lower(text)', tx.POSITIVE_WORDS)} AS p, {rs.hits('lower(text)', tx.NEGATIVE_WORDS)} AS n FROM documents)""")
def _(t: Tables):
    low = t.base.select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", tx.sentiment(F.col("low")).alias("sentiment"))


@query("text_flags", "T4", f"""
    SELECT doc_id, regexp_matches(text, {rs.text(tx.EMAIL)}) AS has_email, contains(text, 'http') AND
           regexp_matches(text, 'https?://.') AS has_url, regexp_matches(text, '[0-9]') AS has_numbers FROM documents""")
def _(t: Tables):
    text = F.col("text")
    return t.base.select("doc_id", text.rlike(tx.EMAIL).alias("has_email"), text.rlike(tx.URL).alias("has_url"),
                         text.rlike("[0-9]").alias("has_numbers"))


@query("text_entities", "T5", f"""
    SELECT doc_id, CAST(len(regexp_extract_all(text, {rs.text(tx.AMOUNT)})) AS INTEGER) AS money_count,
           CAST(len(regexp_extract_all(text, {rs.text(tx.NUMERIC_DATE)})) + len(regexp_extract_all(text, {rs.text(tx.MONTH_DATE)}))
           AS INTEGER) AS date_count FROM documents""")
def _(t: Tables):
    text = F.col("text")
    return t.base.select("doc_id", tx.money_count(text).alias("money_count"), tx.date_count(text).alias("date_count"))


ENTITIES = f"""list_concat(regexp_extract_all(text, {rs.text(tx.NUMERIC_DATE)}, 1), list_concat(
    regexp_extract_all(text, {rs.text(tx.MONTH_DATE)}, 1), regexp_extract_all(text, {rs.text(tx.AMOUNT)}, 0)))"""


@query("text_summary", "T6", f"""
    SELECT doc_id, left(coalesce(nullif(regexp_extract(ltrim(text, ' '), '(?s)^(.*?[.!?])(?:\\s|$)', 1), ''), ltrim(text, ' ')), 200)
           || CASE WHEN len(e) = 0 THEN '' ELSE ' | Key entities: ' || array_to_string(list_filter(e, lambda x, i:
              list_position(e, x) = i)[1:3], ', ') END AS summary
    FROM (SELECT doc_id, text, {ENTITIES} AS e FROM documents)""")
def _(t: Tables):
    return t.base.select("doc_id", tx.summary(F.col("text")).alias("summary"))


@query("text_min_length", "T7", """
    SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 10 AS is_blank FROM documents""")
def _(t: Tables):
    return t.base.select("doc_id", tx.is_blank(F.col("text")).alias("is_blank"))


META = {"dates": (tx.NUMERIC_DATE, 5, "TRUE"), "amounts": (tx.AMOUNT, 3, "f"), "invoice_numbers": (tx.INVOICE_NUMBER, 2, "f"),
        "vin": (tx.VIN, 1, "a"), "mileage": (tx.MILEAGE, 1, "a"), "case_numbers": (tx.CASE_NUMBER, 2, "l")}
META_TYPES = ("financial_invoice", "automotive_service", "legal_contract")


@query("text_metadata", "X16", f"""
    SELECT doc_id, {', '.join(
        f"nullif(CASE WHEN {flag} THEN array_to_string(regexp_extract_all(text, {rs.text(p)}, 1)[1:{n}], '|') ELSE '' END, '') AS {k}"
        for k, (p, n, flag) in META.items())}
    FROM (SELECT doc_id, text, doc_id % 3 = 0 AS f, doc_id % 3 = 1 AS a, doc_id % 3 = 2 AS l FROM documents)""")
def _(t: Tables):
    kind = F.element_at(F.array(*[F.lit(k) for k in META_TYPES]), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = t.base.select("doc_id", tx.metadata_by_type(F.col("text"), kind).alias("m"))
    return rows.select("doc_id", *[F.nullif(F.array_join(F.try_element_at("m", F.lit(k)), "|"), F.lit("")).alias(k) for k in META])


@query("text_domain_fields", "X17", f"""
    SELECT doc_id, {', '.join("coalesce(" + ', '.join(f"nullif(regexp_extract(text, {rs.text(p)}, 1), '')" for p in ps) + f") AS {k}"
                              for k, ps in tx.DOMAIN_PATTERNS.items())} FROM documents""")
def _(t: Tables):
    return t.base.select("doc_id", *[tx.domain_field(F.col("text"), k).alias(k) for k in tx.DOMAIN_PATTERNS])


@query("pii_flags", "F15", f"""
    SELECT doc_id, {' OR '.join(rs.matches('text', p.removeprefix('(?i)')) for p in tx.SENSITIVE.values())} AS is_sensitive,
           {', '.join(f"regexp_matches(text, {rs.text(p)}) AS {k}" for k, p in tx.SENSITIVE.items())} FROM documents""")
def _(t: Tables):
    text = F.col("text")
    return t.base.select("doc_id", tx.is_sensitive(text).alias("is_sensitive"),
                         *[text.rlike(p).alias(k) for k, p in tx.SENSITIVE.items()])


def html_sql() -> str:
    bare = "html"
    for element in ("script", "style"):
        bare = f"regexp_replace({bare}, '(?is)<{element}\\b.*?</{element}\\s*>', '', 'g')"
    bare = f"regexp_replace({bare}, '(?s)<!--.*?-->', '', 'g')"
    bare = f"regexp_replace({bare}, '<[^>]*>', chr(10), 'g')"
    for entity, char in tx.HTML_ENTITIES:
        bare = f"replace({bare}, {rs.text(entity)}, {rs.text(char)})"
    bare = f"regexp_replace({bare}, '[ \\t\\r]+', ' ', 'g')"
    bare = f"regexp_replace({bare}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"trim({bare}, ' ' || chr(10))"


@query("html_text", "S16", f"SELECT page_id, {html_sql()} AS text FROM pages")
def _(t: Tables):
    return t.read("pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("text_counts", "S15", """
    SELECT doc_id, length(text) AS char_count, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count,
           len(string_split(text, chr(10))) AS line_count FROM documents""")
def _(t: Tables):
    text = F.col("text")
    return t.base.select("doc_id", F.length(text).cast("long").alias("char_count"),
                         tx.whitespace_word_count(text).cast("long").alias("word_count"), tx.line_count(text).cast("long").alias("line_count"))


@query("name_functions", "X1 X2 X3 X6 X8 X20", r"""
    SELECT file_id, regexp_replace(regexp_replace(regexp_replace(lower(name), '\s*\(\d+\)', '', 'g'), '\s*-\s*copy\s*\d*', '', 'g'),
           '\s*\d{4}-\d{2}-\d{2}', '', 'g') AS simple_normal,
           trim(regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '', 'g'), '\s+', '_', 'g'), '_') AS sanitized,
           'v' || lpad(CAST(CAST(nullif(regexp_extract(name, '(?i)v(\d+)', 1), '') AS BIGINT) AS VARCHAR), CAST(greatest(2,
               length(CAST(CAST(nullif(regexp_extract(name, '(?i)v(\d+)', 1), '') AS BIGINT) AS VARCHAR))) AS INTEGER), '0') AS version,
           split_part(name, '.', 1) AS stem, '/' || root_id || '/' || lang AS parent, CAST(3 AS INTEGER) AS depth FROM fx_files""")
def _(t: Tables):
    name, path = F.col("name"), F.col("path")
    simple = F.lower(name)
    for p in (r"\s*\(\d+\)", r"\s*-\s*copy\s*\d*", r"\s*\d{4}-\d{2}-\d{2}"):
        simple = F.regexp_replace(simple, p, "")
    return t.files.select("file_id", simple.alias("simple_normal"), names.sanitize(name).alias("sanitized"),
                          names.version(name).alias("version"), paths.stem(path).alias("stem"),
                          paths.parent(path).alias("parent"), paths.separators(path).alias("depth"))


@query("name_normalized", "X1", """
    SELECT file_id, {} AS norm FROM fx_names""".format(
        __import__("shelfmark.plans.dedup_queries", fromlist=["normalized_sql"]).normalized_sql("name")))
def _(t: Tables):
    return t.names.select("file_id", names.normalize(F.col("name")).alias("norm"))


@query("name_dates", "X11 X12 X13", r"""
    SELECT file_id, CASE WHEN regexp_matches(name, '(\d{4})[_-](\d{2})[_-](\d{2})') THEN
           replace(regexp_extract(name, '(\d{4}[_-]\d{2}[_-]\d{2})', 1), '_', '-') END AS date_in_name,
           left(regexp_replace(trim(regexp_replace(nullif(regexp_extract(name, '^([A-Z][a-zA-Z\s&]+?)[-_]', 1), ''), '[_-]+', ' ', 'g')),
                '\s+', '_', 'g'), 30) AS vendor,
           left(nullif(regexp_extract(name, '(?i)(?:Invoice|INV|invoice)[#\s_-]*:?\s*([A-Z0-9_-]+)', 1), ''), 20) AS invoice
    FROM fx_files""")
def _(t: Tables):
    name = F.col("name")
    return t.files.select("file_id", names.date_in_name(name).alias("date_in_name"), names.vendor_in_name(name).alias("vendor"),
                          names.invoice_in_name(name).alias("invoice"))


@query("name_enhanced", "X14 P16", r"""
    SELECT file_id, CASE WHEN starts_with(name, 'contract') THEN '2024_03_01_contract_2024_03_01_' || doc_id || extension
        ELSE doc_id || '_Invoice_#' || doc_id || extension END AS new_name
    FROM fx_files WHERE starts_with(name, 'contract') OR starts_with(name, 'Invoice')""")
def _(t: Tables):
    typed = t.files.withColumn("document_type", F.lit("financial_invoice"))
    return names.with_enhanced_name(typed, "name").select("file_id", "new_name").where("new_name is not null")


@query("rename_occupied", "P16 X14", r"""
    SELECT file_id, '/' || root_id || '/' || lang || '/' || CASE WHEN starts_with(name, 'contract')
        THEN '2024_03_01_contract_2024_03_01_' || doc_id || extension ELSE doc_id || '_Invoice_#' || doc_id || extension END AS new_path
    FROM fx_files WHERE (starts_with(name, 'contract') OR starts_with(name, 'Invoice')) AND doc_id % 2 <> 0""")
def _(t: Tables):
    """Files with an even number find their new name taken."""
    docs = t.files.withColumns({"document_type": F.lit("financial_invoice"), "file_name": F.col("name"), "file_path": F.col("path")})
    new = names.with_enhanced_name(docs.where("doc_id % 2 = 0")).where("new_name is not null")
    taken = new.select(F.concat_ws("/", paths.parent(F.col("path")), "new_name").alias("path"))
    return organise.rename_plan(docs, t.files.select("path").unionByName(taken)).select("file_id", "new_path")


@query("name_ratios", "X25", """
    SELECT file_id, CAST(1 AS DOUBLE) AS same, round(CAST(2 * length(name) AS DOUBLE) / (2 * length(name) + 8), 9) AS longer,
           round(CAST(2 * length(name) AS DOUBLE) / (2 * length(name) + 5), 9) AS led,
           CAST(0 AS DOUBLE) AS empty, CAST(0 AS DOUBLE) AS nothing_shared FROM fx_names WHERE length(name) < 190""")
def _(t: Tables):
    """Ratios that are known: the name and itself, with more behind, with more before, nothing, and other characters only."""
    name = F.col("name")
    shown = lambda other, left=name: F.round(sequence_ratio(left, other), 9)
    return t.names.where(F.length("name") < 190).select(
        "file_id", shown(name).alias("same"), shown(F.concat(name, F.lit("########"))).alias("longer"), shown(F.concat(F.lit("#####"), name)).alias("led"),
        shown(F.lit("")).alias("empty"), shown(F.regexp_replace(name, "(?s).", "#")).alias("nothing_shared"))


@query("name_fields", "X15", f"""
    SELECT file_id, CASE WHEN d <> '' THEN d WHEN y = '' THEN '2024-01-31' END AS date,
           CASE WHEN d <> '' THEN left(d, 4) WHEN y <> '' THEN y ELSE '2024' END AS yyyy,
           nullif(regexp_extract(file_name, '(?i)(?:invoice|inv|#)[\\s_-]*([A-Z0-9\\-]+)', 1), '') AS invoice_number,
           nullif(regexp_extract(file_name, '^([A-Za-z]+)_', 1), '') AS vendor_name FROM (
        SELECT *, replace(regexp_extract(file_name, '(\\d{{4}}[-_]\\d{{2}}[-_]\\d{{2}})', 1), '_', '-') AS d,
               regexp_extract(file_name, '(\\d{{4}})', 1) AS y FROM fx_registry)""")
def _(t: Tables):
    fields = names.name_fields(F.col("file_name"), F.lit(REGISTRY_CLOCK).cast("timestamp"))
    return t.registry.select("file_id", fields.alias("f")).select("file_id", "f.date", "f.yyyy", "f.invoice_number", "f.vendor_name")


@query("name_search_terms", "X23", r"""
    SELECT file_id, array_to_string(regexp_extract_all(regexp_replace(split_part(file_name, '.', 1),
           '(?i)^(file|document|scan|img)[_-]', ''), '\b([A-Za-z]{3,})\b', 1)[1:5], ' ') AS terms FROM fx_registry""")
def _(t: Tables):
    return t.registry.select("file_id", F.coalesce(names.search_terms(F.col("file_name")), F.lit("")).alias("terms"))


@query("path_ancestors", "X24", """
    SELECT file_id, unnest(['/' || root_id, '/' || root_id || '/' || lang]) AS ancestor FROM fx_files""")
def _(t: Tables):
    return t.files.select("file_id", F.explode(paths.ancestors(paths.parent(F.col("path")))).alias("ancestor"))


@query("path_projects", "X4 X5", """
    SELECT file_id, lang AS project, '2025-01-01_' || lang || '_documents_v01.pdf' AS conventional FROM fx_files""")
def _(t: Tables):
    project = paths.project(F.col("path"), tuple(f"src{i}" for i in range(20)))
    named = names.conventional_name(F.lit("2025-01-01"), project, F.lit("documents"), F.lit("v01"), F.lit("pdf"))
    return t.files.select("file_id", project.alias("project"), named.alias("conventional"))


@query("hash_functions", "X10", """
    SELECT doc_id, sha256(text) AS hash_full, strlen(text) <= 1048576 AS small FROM documents""")
def _(t: Tables):
    from shelfmark.functions import hashing

    raw = F.col("text").cast("binary")
    return t.base.select("doc_id", hashing.adaptive_hashes(raw, F.col("n")).alias("h"), (F.col("n") <= hashing.QUICK_BYTES).alias("small")).select(
        "doc_id", F.coalesce("h.hash_full", "h.hash_quick").alias("hash_full"), "small")


@query("event_properties", "X27", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t: Tables):
    parsed = F.from_json("props", "map<string,bigint>")
    return t.read("events").select("event_id", F.try_element_at(parsed, F.lit("k")).alias("k"))


@query("array_and_math", "X28 X29", """
    SELECT doc_id, n // 1024 AS size_kb, round(abs(n - n_chars) / CAST(n AS DOUBLE), 6) AS difference,
           array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], '-') AS first_words, list_contains(w, 'the') AS has_the
    FROM (SELECT doc_id, n, n_chars, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM fx_base)""")
def _(t: Tables):
    rows = t.base.select("doc_id", "n", "n_chars", tx.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.expr("n div 1024").alias("size_kb"),
                       F.round(tx.ratio(F.abs(F.col("n") - F.col("n_chars")), F.col("n")), 6).alias("difference"),
                       F.array_join(F.slice(F.array_distinct("w"), 1, 5), "-").alias("first_words"),
                       F.array_contains("w", "the").alias("has_the"))


@query("path_projects_default", "X4", """
    SELECT file_id, CASE doc_id % 6 WHEN 5 THEN NULL ELSE lang END AS project FROM fx_files""")
def _(t: Tables):
    """Each default marker folder in turn, and a path without one."""
    markers = F.array(*[F.lit(m) for m in ("projects", "Work", "dev", "development", "CODE", "other")])
    path = F.concat(F.lit("/home/"), F.element_at(markers, (F.col("doc_id") % 6 + 1).cast("int")), F.lit("/"), "lang", F.lit("/"), "name")
    return t.files.select("file_id", F.nullif(paths.project(path), F.lit("")).alias("project"))
