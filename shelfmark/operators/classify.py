"""Document type decisions that combine rules, content and model results.

A model result, where one takes part, is a pair of columns
(``ml_type``, ``ml_confidence``) joined in by the caller; NULL means no answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths, phrases, rules
from shelfmark.functions import rule_tables as tables
from shelfmark.functions import text as tx
from shelfmark.functions.names import real_name

def decision(kind, confidence, method) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        col(kind).cast("string").alias("document_type"),
        col(confidence).cast("double").alias("confidence"),
        col(method).alias("method"),
    )


def with_pattern_type(files: DataFrame, path_col: str = "path", rule_list=None) -> DataFrame:
    """Adds the first-match path rule result as flat columns."""
    return rules.with_path_rule(files.drop(*rules.RESULT), F.col(path_col), rule_list or tables.PATTERN_RULES)


def with_stored_rule_type(files: DataFrame, path_col: str = "path", rule_list=None) -> DataFrame:
    return _flat(files, rules.classify_by_table(F.col(path_col), rule_list or tables.STORED_RULES))


def with_name_rule_type(files: DataFrame, name_col: str = "name", rule_list=None) -> DataFrame:
    """Adds the comprehensive name rules; unmatched rows get NULL columns."""
    return rules.with_name_rule(files.drop(*rules.RESULT), F.col(name_col), rule_list or tables.COMPREHENSIVE_RULES)


def _flat(df: DataFrame, result: Column) -> DataFrame:
    kept = df.drop(*rules.RESULT)
    return rules.with_struct(kept, result, rules.RESULT)


def with_keyword_type(docs: DataFrame, text_col: str = "text", path_col: str = "path") -> DataFrame:
    low = docs.withColumn("_low", F.lower(text_col))
    return rules.with_keyword_category(
        low, F.col("_low"), paths.extension(F.col(path_col)), tables.KEYWORD_GROUPS, tables.KEYWORD_EXTENSIONS
    ).drop("_low")


def with_content_type(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the best content rule (NULL columns when none qualifies)."""
    low = docs.withColumn("_low", F.lower(text_col))
    return rules.with_struct(low, rules.classify_content(F.col("_low"), tables.CONTENT_RULES), rules.CONTENT_RESULT).drop("_low")


def with_phrase_type(docs: DataFrame, text_col: str = "text", name_col: str = "name") -> DataFrame:
    """Adds inferred_type: weighted phrases; texts under ten characters are unknown."""
    return phrases.with_inferred_type(docs, text_col, name_col)


def document_decision(
    docs: DataFrame,
    text_col: str = "text",
    name_col: str = "name",
    read_extensions: Sequence[str] = (".pdf",),
    strong: float = 0.90,
) -> DataFrame:
    """Strong name rule, content keywords, text features, weak name rule, general.

    Content is consulted only for ``read_extensions``, as each ``when`` guards the next.
    """
    text = F.col(text_col)
    readable = paths.extension(F.col(name_col)).isin(*read_extensions) & (F.length(text) > 0)
    named = rules.with_name_rule(
        docs, F.col(name_col), tables.COMPREHENSIVE_RULES, ["_nk", "_nc", "_nm", "_nr"]
    ).withColumn("_low", F.lower(text_col))
    # content is read only where the name alone did not settle the type
    open_row = readable & ~F.coalesce(F.col("_nc") >= strong, F.lit(False))
    staged = rules.with_struct(
        named, F.when(open_row, rules.classify_content(F.col("_low"), tables.CONTENT_RULES)), ["_ck", "_cc", "_cr", "_cn"]
    )
    features = readable & (tx.money_count(text) > 3) & (tx.date_count(text) > 2)
    chosen = (
        F.when(F.col("_nc") >= strong, decision(F.col("_nk"), F.col("_nc"), "filename_pattern"))
        .when(F.col("_ck").isNotNull(), decision(F.col("_ck"), F.col("_cc"), "content_keywords"))
        .when(features, decision("financial_invoice", 0.60, "text_analysis"))
        .when(F.col("_nk").isNotNull(), decision(F.col("_nk"), F.col("_nc"), "filename_fallback"))
        .otherwise(decision("general_document", 0.50, "fallback"))
    )
    helpers = ["_nk", "_nc", "_nm", "_nr", "_low", "_ck", "_cc", "_cr", "_cn"]
    return rules.with_struct(staged, chosen, ["document_type", "confidence", "method"]).drop(*helpers)


def reclassify_unlabelled(registry: DataFrame, scope: str = "unknown", model_threshold: float = 0.70) -> DataFrame:
    """Updates for rows of one scope: path rules on the real name, else the model.

    ``null``: rows without a type, model answers need the threshold; ``unknown``: path
    rules only; ``all``: every row, any model answer.
    """
    kind = F.col("document_type")
    rows = {"null": registry.where(kind.isNull()), "unknown": registry.where(kind == "unknown"), "all": registry}[scope]
    source = F.col("original_path") if scope == "unknown" else real_name(F.col("original_path"))
    staged = rules.with_path_rule(rows, source, tables.PATTERN_RULES, ["_rk", "_rc", "_rm", "_rr"])
    use_model = F.lit(False)
    if scope != "unknown" and "ml_type" in registry.columns:
        use_model = F.col("ml_type").isNotNull()
        if scope == "null":
            use_model = use_model & (F.col("ml_confidence") >= model_threshold)
    else:
        staged = with_model_columns(staged)
    by_rule = F.col("_rk").isNotNull()
    updates = staged.where(by_rule | use_model).select(
        "file_id",
        kind.alias("old_type"),
        F.col("confidence").alias("old_confidence"),
        F.coalesce("_rk", "ml_type").alias("new_type"),
        F.when(by_rule, F.col("_rc")).otherwise(F.col("ml_confidence")).alias("new_confidence"),
        F.when(by_rule, F.col("_rm")).otherwise("ml_model").alias("method"),
    )
    return updates.where(~F.col("new_type").eqNullSafe(F.col("old_type"))) if scope == "all" else updates


def with_pending_decision(
    df: DataFrame, threshold: float = 0.70, stored_rules=None, path_col: str = "original_path"
) -> DataFrame:
    """Adds new_type, new_confidence, new_method: the model at or above the threshold,
    else stored rules, else the fallback type."""
    ruled = rules.with_struct(
        with_model_columns(df),
        rules.classify_by_table(F.col(path_col), stored_rules or tables.STORED_RULES),
        ["_rk", "_rc", "_rm", "_rr"],
    )
    model_ok = F.col("ml_type").isNotNull() & (F.col("ml_confidence") >= threshold)
    chosen = (
        F.when(model_ok, decision(F.col("ml_type"), F.col("ml_confidence"), "ml_model"))
        .when(F.col("_rk").isNotNull(), decision(F.col("_rk"), F.col("_rc"), F.col("_rm")))
        .otherwise(decision("general_document", 0.0, "fallback"))
    )
    return rules.with_struct(ruled, chosen, ["new_type", "new_confidence", "new_method"]).drop("_rk", "_rc", "_rm", "_rr")


def with_model_columns(df: DataFrame) -> DataFrame:
    """Adds empty model columns when no model took part."""
    if "ml_type" not in df.columns:
        df = df.withColumn("ml_type", F.lit(None).cast("string")).withColumn("ml_confidence", F.lit(None).cast("double"))
    return df


def classify_pending(registry: DataFrame, threshold: float = 0.70, stored_rules=None) -> DataFrame:
    """New type, confidence, method and review flag of every pending row."""
    pending = registry.where(F.col("canonical_state") == "pending")
    return with_pending_decision(pending, threshold, stored_rules).select(
        "file_id",
        F.col("new_type").alias("document_type"),
        F.col("new_confidence").alias("confidence"),
        F.col("new_method").alias("classification_method"),
        (F.col("new_method") == "fallback").alias("requires_review"),
    )


def reclassify_organised(
    registry: DataFrame, threshold: float = 0.70, everything: bool = False, stored_rules=None
) -> DataFrame:
    """Changed types among organised rows (doubtful or rule-made ones by default)."""
    rows = registry.where(F.col("canonical_state") == "organized")
    if not everything:
        rows = rows.where(
            (F.col("confidence") < threshold) | F.col("classification_method").isin("fallback", "pattern")
        )
    decided = with_pending_decision(rows, threshold, stored_rules, "canonical_path")
    return decided.where(~F.col("new_type").eqNullSafe(F.col("document_type"))).select(
        "file_id",
        F.col("document_type").alias("old_type"),
        "new_type",
        "new_confidence",
        F.col("new_method").alias("method"),
    )


def reclassify_by_name(
    registry: DataFrame, name_col: str = "file_name", rule_list=None
) -> DataFrame:
    """Typed rows whose name rule gives another type at no less confidence."""
    typed = registry.where(F.col("document_type").isNotNull())
    rule_list = rule_list or tables.COMPREHENSIVE_RULES
    return (
        rules.with_name_rule(typed, F.col(name_col), rule_list, ["_rk", "_rc", "_rm", "_rr"])
        .where((F.col("_rk") != F.col("document_type")) & (F.col("_rc") >= F.coalesce("confidence", F.lit(0.0))))
        .select(
            "file_id",
            F.col("document_type").alias("old_type"),
            F.col("_rk").alias("new_type"),
            F.col("_rc").alias("new_confidence"),
            F.col("_rr").alias("reason"),
        )
    )


def classify_null_types(registry: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Rows without a type: name rules, else general_document at 0.50."""
    untyped = registry.where(F.col("document_type").isNull())
    return rules.with_name_rule(untyped, F.col(name_col), tables.COMPREHENSIVE_RULES, ["_rk", "_rc", "_rm", "_rr"]).select(
        "file_id",
        F.coalesce("_rk", F.lit("general_document")).alias("document_type"),
        F.coalesce("_rc", F.lit(0.50)).alias("confidence"),
    )


def domain_scores(low: Column, keywords: Mapping[str, Sequence[str]] = tables.DOMAIN_KEYWORDS) -> Column:
    """struct(score, rank, payload): the domain with the largest share of its keywords."""
    return rules.best_of(
        [(tx.phrase_hits(low, words) / F.lit(float(len(words))), F.lit(d)) for d, words in keywords.items()]
    )


def domain_type(domain: Column, low: Column) -> Column:
    """Document type of a domain, refined by words of the context."""
    def has(*words: str) -> Column:
        return tx.any_phrase(low, words)

    return (
        F.when(domain == "automotive",
               F.when(has("service", "carfax"), "automotive_service").otherwise("automotive_technical"))
        .when(domain == "financial",
              F.when(has("statement"), "financial_statement").when(has("receipt"), "financial_receipt")
              .otherwise("financial_invoice"))
        .when(domain == "legal",
              F.when(has("court"), "legal_court").when(has("agreement"), "legal_agreement").otherwise("legal_contract"))
        .when(domain == "medical", "medical")
        .when(domain == "personal", "personal_career")
        .when(domain == "technical", "technical_documentation")
        .otherwise("unknown")
    )


def with_domain_type(docs: DataFrame, text_col: str = "text", confidence_col: str | None = None, min_score: float = 0.15) -> DataFrame:
    """Adds domain, its score and, above ``min_score``, the refined type and confidence."""
    base = F.coalesce(F.col(confidence_col), F.lit(0.0)) if confidence_col else F.lit(0.0)
    low = F.col("_low")
    staged = rules.with_struct(
        docs.withColumn("_low", F.lower(text_col)), domain_scores(low), ["_score", "_rank", "domain"]
    )
    clear = F.col("_score") > min_score
    score = F.round("_score", 6)
    return (
        staged.withColumn("domain_score", score)
        .withColumn("new_type", F.when(clear, domain_type(F.col("domain"), low)))
        .withColumn("new_confidence", F.when(clear, F.round(F.least(F.lit(0.80), base + score * 0.5), 6)))
        .drop("_score", "_rank", "_low")
    )


def description_type(description: Column) -> Column:
    """struct(document_type, confidence) for an image description; NULL type when unclear."""
    low = F.lower(description)
    chain = F
    for words, kind, confidence in tables.DESCRIPTION_TYPES:
        chain = chain.when(
            tx.any_phrase(low, words),
            F.struct(F.lit(kind).alias("document_type"), F.lit(confidence).alias("confidence")),
        )
    return chain.otherwise(
        F.struct(F.lit(None).cast("string").alias("document_type"), F.lit(0.0).alias("confidence"))
    )


def indicator_hits(name: Column, content: Column, domain: str) -> Column:
    """How many name and content indicators of a domain hold (a model feature)."""
    found = tables.DOMAIN_INDICATORS[domain]
    hits = F.lit(0)
    for pattern in found["name"]:
        hits = hits + name.rlike(pattern).cast("int")
    for pattern in found["content"]:
        hits = hits + content.rlike(pattern).cast("int")
    return hits


def with_indicators(docs: DataFrame, name_col: str = "name", text_col: str = "text") -> DataFrame:
    for domain in tables.DOMAIN_INDICATORS:
        docs = docs.withColumn(f"{domain}_hits", indicator_hits(F.col(name_col), F.col(text_col), domain).cast("long"))
    return docs


def rule_statistics(spark, rule_list=None) -> DataFrame:
    """Rules and document types per priority band, from the rule configuration."""
    from shelfmark.functions.lookups import config_table

    rows = [(r.name, r.document_type, r.priority) for r in rule_list or tables.PATTERN_RULES]
    band = (
        F.when(F.col("priority") >= 90, "high (90+)").when(F.col("priority") >= 70, "medium (70-89)").otherwise("low (<70)")
    )
    return config_table(spark, ["name", "document_type", "priority"], rows).groupBy(band.alias("band")).agg(
        F.count("*").alias("rules"), F.count_distinct("document_type").alias("document_types")
    )
