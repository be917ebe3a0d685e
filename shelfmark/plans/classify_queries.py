"""Rule-based classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import rule_tables as tables
from shelfmark.functions import rules
from shelfmark.functions.scale import spread
from shelfmark.functions.phrases import (
    BIOGRAPHY_NAMES, BIOGRAPHY_PHRASES, DOCUMENTATION_WORDS, LESSON_PHRASES, LETTER_PHRASES, NAME_SCORES, QUOTE_PHRASES,
    SCORED_TYPES,
)
from shelfmark.functions.text import AMOUNT, MONTH_DATE, NUMERIC_DATE
from shelfmark.operators import categories, classify
from shelfmark.plans import rule_sql as rs
from shelfmark.plans.fixtures import Tables
from shelfmark.plans.registry import query

# the fixture names hold no dot but the one of their extension
NAME_PARTS = """SELECT file_id, path, name, extension, lower(name) AS low, lower(left(name, length(name) - length(extension)))
    AS stem, ltrim(lower(extension), '.') AS ext FROM fx_files"""


def path_type(field: str) -> str:
    return rs.path_rules(tables.PATTERN_RULES, field, "low", "stem", "ext")


@query("classify_pattern", "C1 C3 X6", f"""
    SELECT file_id, {path_type('document_type')} AS document_type, {path_type('confidence')} AS confidence,
           {path_type('method')} AS method, {path_type('name')} AS matched_rule FROM ({NAME_PARTS})""")
def _(t: Tables):
    typed = classify.with_pattern_type(t.files)
    return typed.select("file_id", "document_type", "confidence", "method", "matched_rule")


@query("classify_pattern_big", "C1", f"""
    SELECT {path_type('document_type')} AS document_type, count(*) AS count FROM (
        SELECT lower(name) AS low, split_part(lower(name), '.', 1) AS stem, ltrim(extension, '.') AS ext FROM fx_files_big)
    GROUP BY 1""")
def _(t: Tables):
    return classify.with_pattern_type(spread(t.files_big)).groupBy("document_type").agg(F.count("*").alias("count"))


CUSTOM = [rules.Rule("notes", "personal_note", 0.99, 99, file="note"), *tables.PATTERN_RULES]


@query("classify_custom_rules", "C2", f"""
    SELECT document_type, count(*) AS count FROM (
        SELECT {rs.path_rules(CUSTOM, 'document_type', 'low', 'stem', 'ext')} AS document_type FROM ({NAME_PARTS})) GROUP BY 1""")
def _(t: Tables):
    return classify.with_pattern_type(t.files, rule_list=CUSTOM).groupBy("document_type").agg(F.count("*").alias("count"))


@query("classify_stored_rules", "C4 F21", f"""
    SELECT file_id, {rs.stored_rules(tables.STORED_RULES, 'document_type', 'low')} AS document_type,
           {rs.stored_rules(tables.STORED_RULES, 'name', 'low')} AS matched_rule FROM ({NAME_PARTS})""")
def _(t: Tables):
    return classify.with_stored_rule_type(t.files).select("file_id", "document_type", "matched_rule")


@query("classify_name_rules", "C5", f"""
    SELECT file_id, {rs.name_rules(tables.COMPREHENSIVE_RULES, 'document_type', 'name')} AS document_type,
           {rs.name_rules(tables.COMPREHENSIVE_RULES, 'confidence', 'name')} AS confidence,
           {rs.name_rules(tables.COMPREHENSIVE_RULES, 'name', 'name')} AS matched_rule FROM fx_files""")
def _(t: Tables):
    return classify.with_name_rule_type(t.files).select("file_id", "document_type", "confidence", "matched_rule")


# the first words of a text stand in for long file names
@query("classify_name_rules_text", "C5", f"""
    SELECT doc_id, {rs.name_rules(tables.COMPREHENSIVE_RULES, 'document_type', 't')} AS document_type FROM (
        SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""")
def _(t: Tables):
    rows = t.base.select("doc_id", F.translate("text", "\n", " ").alias("t"))
    return classify.with_name_rule_type(rows, "t").select("doc_id", "document_type")


@query("classify_simple_rules", "C6", f"""
    SELECT file_id, {rs.name_rules(tables.SIMPLE_RULES, 'document_type', 'name')} AS document_type FROM fx_files""")
def _(t: Tables):
    return classify.with_name_rule_type(t.files, rule_list=tables.SIMPLE_RULES).select("file_id", "document_type")


@query("classify_category", "C7 J12", """
    SELECT file_id, file_category, file_subcategory FROM fx_catalog""")
def _(t: Tables):
    return categories.with_category(t.files).select("file_id", "file_category", "file_subcategory")


ALL_EXTENSIONS = categories.extension_rows(tables.TAXONOMY)
TAXONOMY_VALUES = ", ".join(f"({i}, {rs.text(e)}, {rs.text(c)}, {rs.text(u)})" for i, (e, c, u) in enumerate(ALL_EXTENSIONS))


@query("classify_all_extensions", "C7 J12", f"""
    SELECT f.file_id, v.extension, CASE WHEN v.extension IN ('.tmp', '.temp') THEN 'system' WHEN v.extension IN ('.cache', '.log', '.trace')
           THEN 'system' ELSE v.category END AS file_category, CASE WHEN v.extension IN ('.tmp', '.temp') THEN 'temp_files'
           WHEN v.extension IN ('.cache', '.log', '.trace') THEN 'logs' ELSE v.sub END AS file_subcategory
    FROM fx_files f JOIN (VALUES {TAXONOMY_VALUES}) v(i, extension, category, sub) ON f.doc_id % {len(ALL_EXTENSIONS)} = v.i""")
def _(t: Tables):
    """Every extension of the table in turn."""
    ext = F.element_at(F.array(*[F.lit(e) for e, _, _ in ALL_EXTENSIONS]), (F.col("doc_id") % len(ALL_EXTENSIONS) + 1).cast("int"))
    files = t.files.withColumn("extension", ext).withColumn("name", F.concat(F.lit("f"), F.col("doc_id"), F.col("extension")))
    return categories.with_category(files).select("file_id", "extension", "file_category", "file_subcategory")


@query("classify_category_by_mime", "C7 X9", """
    SELECT file_id, CASE WHEN extension IN ('.tmp', '.log') THEN 'system' WHEN extension IN ('.txt', '.md', '.py', '.pdf')
           THEN 'documents' WHEN extension = '.jpg' THEN 'media' WHEN extension = '.zip' THEN 'archives' ELSE 'other' END
           AS file_category FROM fx_files""")
def _(t: Tables):
    # with an empty taxonomy the MIME prefix decides
    known = categories.with_mime_type(t.files)
    return categories.with_category(known, {("none", "none"): ".none"}, "mime_type").select("file_id", "file_category")


KEYWORD_BEST = rs.best(
    [(rs.hits("low", words), f"{rs.text(kind)} AS kind", "") for words, kind in tables.KEYWORD_GROUPS],
    "(SELECT file_id, extension, lower(text) AS low FROM fx_files)", "file_id")
KEYWORD_EXT = rs.case([(f"extension = '{e}'", rs.text(k)) for e, k in tables.KEYWORD_EXTENSIONS.items()])


@query("classify_keywords", "C8", f"""
    SELECT f.file_id, CASE WHEN b.score >= 2 THEN b.kind ELSE coalesce({KEYWORD_EXT}, 'unknown') END AS predicted_category,
           CASE WHEN b.score >= 2 THEN least(round(0.5 + b.score * CAST(0.1 AS DOUBLE), 6), CAST(0.8 AS DOUBLE))
                WHEN {KEYWORD_EXT} IS NOT NULL THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS confidence
    FROM fx_files f JOIN ({KEYWORD_BEST}) b ON f.file_id = b.file_id""")
def _(t: Tables):
    return classify.with_keyword_type(t.files).select("file_id", "predicted_category", "confidence")


def content_best(source: str, key: str) -> str:
    entries = []
    for name, words, required, kind, confidence in tables.CONTENT_RULES:
        h = rs.hits("low", words)
        score = f"CASE WHEN {h} >= {required} THEN {h} / CAST({len(words)} AS DOUBLE) END"
        payload = (f"{rs.text(kind)} AS document_type, round(CAST({confidence} AS DOUBLE) * ({h} / CAST({len(words)} AS DOUBLE)), 6) "
                   f"AS confidence, {rs.text(name)} AS matched_rule, CAST({h} AS BIGINT) AS keywords_matched")
        entries.append((score, payload, ""))
    return rs.best(entries, source, key)


CONTENT_DOCS = "(SELECT file_id, lower(text || ' ' || name) AS low FROM fx_files)"


@query("classify_content", "C9", f"""
    SELECT f.file_id, b.document_type, b.confidence, b.matched_rule, b.keywords_matched
    FROM fx_files f LEFT JOIN ({content_best('(SELECT file_id, lower(text) AS low FROM fx_files)', 'file_id')}) b
    ON f.file_id = b.file_id""")
def _(t: Tables):
    return classify.with_content_type(t.files).select(
        "file_id", "document_type", "confidence", "matched_rule", "keywords_matched")


MONEY = f"len(regexp_extract_all(text, {rs.text(AMOUNT)}))"
DATES = f"(len(regexp_extract_all(text, {rs.text(NUMERIC_DATE)})) + len(regexp_extract_all(text, {rs.text(MONTH_DATE)})))"


def name_rule(field: str) -> str:
    return rs.name_rules(tables.COMPREHENSIVE_RULES, field, "name")


DECISION_SQL = f"""
    SELECT file_id,
           CASE WHEN nc >= 0.9 THEN nk WHEN ck IS NOT NULL THEN ck WHEN feature THEN 'financial_invoice'
                WHEN nk IS NOT NULL THEN nk ELSE 'general_document' END AS document_type,
           CASE WHEN nc >= 0.9 THEN nc WHEN ck IS NOT NULL THEN cc WHEN feature THEN CAST(0.6 AS DOUBLE)
                WHEN nk IS NOT NULL THEN nc ELSE CAST(0.5 AS DOUBLE) END AS confidence,
           CASE WHEN nc >= 0.9 THEN 'filename_pattern' WHEN ck IS NOT NULL THEN 'content_keywords'
                WHEN feature THEN 'text_analysis' WHEN nk IS NOT NULL THEN 'filename_fallback' ELSE 'fallback' END AS method
    FROM (
        SELECT f.file_id, {name_rule('document_type')} AS nk, {name_rule('confidence')} AS nc,
               CASE WHEN extension = '.pdf' THEN b.document_type END AS ck, b.confidence AS cc,
               extension = '.pdf' AND {MONEY} > 3 AND {DATES} > 2 AS feature
        FROM fx_files f LEFT JOIN ({content_best('(SELECT file_id, lower(text) AS low FROM fx_files)', 'file_id')}) b
        ON f.file_id = b.file_id)"""


@query("classify_decision", "C10 T5", DECISION_SQL)
def _(t: Tables):
    return classify.document_decision(t.files).select("file_id", "document_type", "confidence", "method")


def phrase_sql() -> str:
    known = {
        "money2": f"{MONEY} >= 2", "dates3": f"{DATES} >= 3", "date": f"{DATES} > 0", "irs": "contains(low, 'irs')",
        "email": f"({rs.has_any('low', LETTER_PHRASES)} AND contains(text, '@') AND contains(low, 'from:'))",
        "letter": f"({rs.has_any('low', LETTER_PHRASES)} AND NOT (contains(text, '@') AND contains(low, 'from:')))",
        "boxes": "greatest(length(low) - length(replace(low, '☐', '')), (length(low) - length(replace(low, '[ ]', ''))) // 3) > 5",
        "lesson_with_date": f"({rs.has_any('low', LESSON_PHRASES)} AND {DATES} > 0)",
        "quote_with_money": f"({rs.has_any('low', QUOTE_PHRASES)} AND {MONEY} > 0)",
        "biography": f"({rs.has_any('nlow', BIOGRAPHY_NAMES)} AND {rs.has_any('low', BIOGRAPHY_PHRASES)})",
    }
    names = {}
    for place, (kind, marks, points) in enumerate(NAME_SCORES):
        hit = rs.has_any("nlow", marks)
        if kind == "technical_documentation":
            hit = f"({hit} AND {rs.has_any('nlow', DOCUMENTATION_WORDS)})"
        names[kind] = (hit, points, place)
    content = {k for k, _, _ in SCORED_TYPES}
    rows = [(k, f"CASE WHEN {h} THEN {p} END", str(place)) for k, (h, p, place) in names.items() if k not in content]
    for place, (kind, threshold, parts) in enumerate(SCORED_TYPES, start=len(NAME_SCORES)):
        total = " + ".join(
            f"CASE WHEN {known[p] if isinstance(p, str) else rs.has_any('low', p)} THEN {n} ELSE 0 END" for n, p in parts)
        score, position = f"CASE WHEN {total} >= {threshold} THEN {total} END", str(place)
        if kind in names:
            hit, points, early = names[kind]
            score = f"coalesce({score}, CASE WHEN {hit} THEN {points} END)"
            position = f"CASE WHEN {hit} THEN {early} ELSE {place} END"
        rows.append((kind, score, position))
    entries = ", ".join(f"{{'k': {rs.text(k)}, 's': {s}, 'p': {p}}}" for k, s, p in rows)
    return f"""
        WITH d AS (SELECT file_id, text, lower(text) AS low, lower(name) AS nlow FROM fx_files),
        scored AS (SELECT file_id, text, unnest([{entries}]) AS e FROM d),
        top AS (SELECT file_id, arg_min(e.k, -1000 * e.s + e.p) AS kind FROM scored WHERE e.s IS NOT NULL GROUP BY file_id)
        SELECT d.file_id, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 10 THEN 'unknown'
               ELSE coalesce(kind, CASE WHEN length(text) < 500 THEN 'general_document_short' ELSE 'general_document' END) END
               AS inferred_type FROM d LEFT JOIN top ON d.file_id = top.file_id"""


@query("classify_phrases", "C11 T7", phrase_sql())
def _(t: Tables):
    return classify.with_phrase_type(t.files).select("file_id", "inferred_type")


REGISTRY_PARTS = """SELECT *, lower(file_name) AS low, regexp_extract(original_path, '(\\.[^.]+)$', 1) AS extension,
    ltrim(regexp_extract(lower(original_path), '(\\.[^.]+)$', 1), '.') AS ext,
    lower(left(file_name, length(file_name) - length(regexp_extract(original_path, '(\\.[^.]+)$', 1)))) AS stem FROM fx_registry"""


@query("reclassify_null", "C12 X7", f"""
    SELECT file_id, document_type AS old_type, confidence AS old_confidence, {path_type('document_type')} AS new_type,
           {path_type('confidence')} AS new_confidence, {path_type('method')} AS method FROM ({REGISTRY_PARTS})
    WHERE document_type IS NULL AND {path_type('document_type')} IS NOT NULL""")
def _(t: Tables):
    return classify.reclassify_unlabelled(t.registry, "null")


@query("reclassify_unknown", "C12", f"""
    SELECT file_id, document_type AS old_type, confidence AS old_confidence, {path_type('document_type')} AS new_type,
           {path_type('confidence')} AS new_confidence, {path_type('method')} AS method FROM ({REGISTRY_PARTS})
    WHERE document_type = 'unknown' AND {path_type('document_type')} IS NOT NULL""")
def _(t: Tables):
    return classify.reclassify_unlabelled(t.registry, "unknown")


ML = "CASE WHEN file_id % 5 = 0 THEN 'medical' END AS ml_type, CAST(file_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS ml_confidence"


def with_ml(df):
    return df.selectExpr("*", "case when file_id % 5 = 0 then 'medical' end ml_type",
                         "cast(file_id % 100 as double) / cast(100 as double) ml_confidence")


@query("reclassify_all", "C12", f"""
    SELECT * FROM (SELECT file_id, document_type AS old_type, confidence AS old_confidence,
           coalesce({path_type('document_type')}, ml_type) AS new_type,
           CASE WHEN {path_type('document_type')} IS NOT NULL THEN {path_type('confidence')} ELSE ml_confidence END AS new_confidence,
           CASE WHEN {path_type('document_type')} IS NOT NULL THEN {path_type('method')} ELSE 'ml_model' END AS method
        FROM (SELECT *, {ML} FROM ({REGISTRY_PARTS}))) WHERE new_type IS NOT NULL AND new_type IS DISTINCT FROM old_type""")
def _(t: Tables):
    return classify.reclassify_unlabelled(with_ml(t.registry), "all")


STORED = rs.stored_rules(tables.STORED_RULES, "document_type", "low")


@query("classify_pending", "C13", f"""
    SELECT file_id, coalesce(CASE WHEN ml THEN ml_type END, sk, 'general_document') AS document_type,
           CASE WHEN ml THEN ml_confidence WHEN sk IS NOT NULL THEN CAST(0.95 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence,
           CASE WHEN ml THEN 'ml_model' WHEN sk IS NOT NULL THEN 'pattern' ELSE 'fallback' END AS classification_method,
           NOT ml AND sk IS NULL AS requires_review FROM (
        SELECT file_id, ml_type, ml_confidence, ml_type IS NOT NULL AND ml_confidence >= 0.7 AS ml, {STORED} AS sk
        FROM (SELECT *, {ML} FROM ({REGISTRY_PARTS}) WHERE canonical_state = 'pending'))""")
def _(t: Tables):
    return classify.classify_pending(with_ml(t.registry))


@query("reclassify_organised", "C14 F14", f"""
    SELECT file_id, document_type AS old_type, new_type, new_confidence, method FROM (
        SELECT file_id, document_type, coalesce({STORED}, 'general_document') AS new_type,
               CASE WHEN {STORED} IS NOT NULL THEN CAST(0.95 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS new_confidence,
               CASE WHEN {STORED} IS NOT NULL THEN 'pattern' ELSE 'fallback' END AS method FROM ({REGISTRY_PARTS})
        WHERE canonical_state = 'organized' AND (confidence < 0.7 OR classification_method IN ('fallback', 'pattern')))
    WHERE new_type IS DISTINCT FROM document_type""")
def _(t: Tables):
    return classify.reclassify_organised(t.registry)


SIMPLE_TYPE = "CASE WHEN low LIKE '%api%' THEN 'technical_api' WHEN low LIKE '%invoice%' THEN 'financial_invoice' END"
GATE_RULES = [
    rules.NameRule("api name", "technical_api", 0.9, ("api",)), rules.NameRule("invoice name", "financial_invoice", 0.6, ("invoice",)),
    *tables.COMPREHENSIVE_RULES,
]


def gate(field: str) -> str:
    return rs.name_rules(sorted(GATE_RULES, key=lambda r: r.order), field, "file_name")


GATE_SQL = f"""
    SELECT file_id, document_type AS old_type, {gate('document_type')} AS new_type, {gate('confidence')} AS new_confidence,
           {gate('name')} AS reason FROM fx_registry WHERE document_type IS NOT NULL AND {gate('document_type')} IS NOT NULL
           AND {gate('document_type')} <> document_type AND {gate('confidence')} >= coalesce(confidence, 0)"""


@query("reclassify_gate", "F13 C5", GATE_SQL)
def _(t: Tables):
    return classify.reclassify_by_name(t.registry, rule_list=GATE_RULES)


@query("classify_null_types", "C19", f"""
    SELECT file_id, coalesce({rs.name_rules(tables.COMPREHENSIVE_RULES, 'document_type', 'file_name')}, 'general_document')
           AS document_type, coalesce({rs.name_rules(tables.COMPREHENSIVE_RULES, 'confidence', 'file_name')}, CAST(0.5 AS DOUBLE))
           AS confidence FROM fx_registry WHERE document_type IS NULL""")
def _(t: Tables):
    return classify.classify_null_types(t.registry)


DOMAIN_BEST = rs.best(
    [(f"{rs.hits('low', words)} / CAST({len(words)} AS DOUBLE)", f"{rs.text(d)} AS domain", "")
     for d, words in tables.DOMAIN_KEYWORDS.items()],
    "(SELECT file_id, lower(text) AS low FROM fx_files)", "file_id")
REFINED = """CASE domain
    WHEN 'automotive' THEN CASE WHEN contains(low, 'service') OR contains(low, 'carfax') THEN 'automotive_service' ELSE 'automotive_technical' END
    WHEN 'financial' THEN CASE WHEN contains(low, 'statement') THEN 'financial_statement' WHEN contains(low, 'receipt') THEN 'financial_receipt' ELSE 'financial_invoice' END
    WHEN 'legal' THEN CASE WHEN contains(low, 'court') THEN 'legal_court' WHEN contains(low, 'agreement') THEN 'legal_agreement' ELSE 'legal_contract' END
    WHEN 'medical' THEN 'medical' WHEN 'personal' THEN 'personal_career' WHEN 'technical' THEN 'technical_documentation' END"""


@query("classify_domain_keywords", "C16", f"""
    SELECT b.file_id, b.domain, round(b.score, 6) AS domain_score, CASE WHEN b.score > 0.15 THEN {REFINED} END AS new_type,
           CASE WHEN b.score > 0.15 THEN round(least(CAST(0.8 AS DOUBLE), round(b.score, 6) * 0.5), 6) END AS new_confidence
    FROM ({DOMAIN_BEST}) b JOIN (SELECT file_id, lower(text) AS low FROM fx_files) d ON b.file_id = d.file_id""")
def _(t: Tables):
    return classify.with_domain_type(t.files).select("file_id", "domain", "domain_score", "new_type", "new_confidence")


@query("classify_descriptions", "C20", f"""
    SELECT file_id, {rs.case([(rs.has_any('low', w), rs.text(k)) for w, k, _ in tables.DESCRIPTION_TYPES])} AS document_type,
           {rs.case([(rs.has_any('low', w), f'CAST({c} AS DOUBLE)') for w, _, c in tables.DESCRIPTION_TYPES], 'CAST(0 AS DOUBLE)')}
           AS confidence FROM (SELECT file_id, lower(text) AS low FROM fx_files)""")
def _(t: Tables):
    return t.files.select("file_id", classify.description_type(F.col("text")).alias("r")).select(
        "file_id", "r.document_type", "r.confidence")


def indicator_sql(domain: str) -> str:
    found = tables.DOMAIN_INDICATORS[domain]
    tests = [f"regexp_matches(name, {rs.text(p)})" for p in found["name"]]
    tests += [f"regexp_matches(text, {rs.text(p)})" for p in found["content"]]
    return "CAST(" + " + ".join(f"CAST({x} AS INTEGER)" for x in tests) + f" AS BIGINT) AS {domain}_hits"


@query("category_hints", "C21", f"""
    SELECT file_id, {', '.join(indicator_sql(d) for d in tables.DOMAIN_INDICATORS)} FROM fx_files""")
def _(t: Tables):
    return classify.with_indicators(t.files).select("file_id", *[f"{d}_hits" for d in tables.DOMAIN_INDICATORS])
