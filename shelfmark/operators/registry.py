"""Reports, look-ups and review queues over the file registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.rule_tables import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from shelfmark.functions.scale import share_of_total, top_rows

# Generic types that always deserve a look.
GENERIC_TYPES = ("unknown", "general_document", "general_document_short", "form")


def bands(confidence: Column, cuts: list[tuple[float, str]], lowest: str, null_label: str | None = None) -> Column:
    """Label of the first cut the value reaches."""
    chain = F.when(confidence.isNull(), F.lit(null_label)) if null_label else F
    for cut, label in cuts:
        chain = chain.when(confidence >= cut, F.lit(label))
    return chain.otherwise(lowest)


def overview(registry: DataFrame) -> DataFrame:
    known = F.col("document_type").isNotNull() & (F.col("document_type") != "unknown")
    return registry.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size_bytes"),
        F.count_if(known).alias("classified"),
        F.count_if(F.col("document_type").isNull()).alias("null_type"),
        F.count_if(F.col("document_type") == "unknown").alias("unknown_type"),
        F.round(F.coalesce(F.try_divide(F.count_if(known), F.count("*")), F.lit(0.0)), 6).alias("classification_rate"),
    )


def by_type(registry: DataFrame, n: int = 50) -> DataFrame:
    grouped = registry.groupBy(F.coalesce("document_type", F.lit("NULL")).alias("document_type")).agg(
        F.count("*").alias("count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size")
    )
    return top_rows(grouped, [F.desc("count"), F.asc("document_type")], n)


def by_path_extension(registry: DataFrame, n: int = 50) -> DataFrame:
    """By the text after the first dot of the whole path."""
    grouped = (
        registry.where(F.contains(F.col("original_path"), F.lit(".")))
        .groupBy(paths.first_dot_extension(F.col("original_path")).alias("extension"))
        .agg(F.count("*").alias("count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))
    )
    return top_rows(grouped, [F.desc("count"), F.asc("extension")], n)


def by_method(registry: DataFrame) -> DataFrame:
    return (
        registry.where(F.col("classification_method").isNotNull())
        .groupBy(F.col("classification_method").alias("method"))
        .agg(F.count("*").alias("count"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    )


def confidence_histogram(registry: DataFrame) -> DataFrame:
    label = bands(
        F.col("confidence"),
        [(0.9, "very_high (90%+)"), (0.7, "high (70-90%)"), (0.5, "medium (50-70%)"), (0.3, "low (30-50%)")],
        "very_low (<30%)",
        "null",
    )
    return registry.groupBy(label.alias("bucket")).agg(F.count("*").alias("count"))


def confidence_bands(registry: DataFrame) -> DataFrame:
    """Bands of known confidences with their share of ALL rows."""
    label = bands(
        F.col("confidence"),
        [(0.90, "Very High (>=90%)"), (0.75, "High (75-90%)"), (0.50, "Medium (50-75%)"), (0.25, "Low (25-50%)")],
        "Very Low (<25%)",
        "none",
    )
    counted = registry.groupBy(label.alias("conf_level")).agg(F.count("*").alias("count"))
    return share_of_total(counted, "count", "percentage").where(F.col("conf_level") != "none")


def model_confidence_bands(registry: DataFrame, method: str = "ml_model") -> DataFrame:
    label = bands(F.col("confidence"), [(0.90, "high"), (0.70, "medium"), (0.50, "low")], "very_low")
    return (
        registry.where(F.col("classification_method") == method)
        .groupBy(label.alias("confidence_bucket"))
        .agg(F.count("*").alias("count"))
    )


def model_statistics(classifications: DataFrame) -> DataFrame:
    """Per model: rows, average confidence, confident and doubtful rows."""
    return classifications.groupBy("model_name").agg(
        F.count("*").alias("total"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.count_if(F.col("confidence") >= 0.7).alias("high_confidence"),
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence"),
    )


def category_distribution(classifications: DataFrame, n: int = 10) -> DataFrame:
    grouped = classifications.groupBy("predicted_category").agg(F.count("*").alias("count"))
    return top_rows(grouped, [F.desc("count"), F.asc("predicted_category")], n)


def classifications_with_files(classifications: DataFrame, files: DataFrame) -> DataFrame:
    return classifications.join(files.select("file_id", "path", "name"), "file_id")


def dashboard(registry: DataFrame, top_types: int = 15) -> DataFrame:
    """State, type and method counts with totals as (section, key, count) rows.

    One pass over the registry: grouping sets for the three keys and the grand total.
    """
    keys = ["canonical_state", "document_type", "classification_method"]
    grouped = registry.groupingSets([*[[k] for k in keys], []], *keys).agg(
        F.count("*").alias("n"),
        F.count_if("is_duplicate").alias("dup"),
        F.count_if((F.col("confidence") < 0.70) & (F.col("confidence") > 0)).alias("low"),
        F.grouping_id().alias("g"),
    )

    def row(level: int, section: str, key: Column, count: str = "n") -> Column:
        cells = F.struct(F.lit(section).alias("section"), key.alias("key"), F.col(count).alias("count"))
        return F.when(F.col("g") == level, cells)

    everything = F.lit("all")
    cells = F.array_compact(
        F.array(
            row(7, "total", everything),
            row(3, "state", F.col("canonical_state")),
            row(5, "type", F.col("document_type")),
            row(6, "method", F.col("classification_method")),
            row(7, "duplicates", everything, "dup"),
            row(7, "low_confidence", everything, "low"),
        )
    )
    rows = grouped.select(F.inline(cells)).where(F.col("key").isNotNull() | (F.col("section") == "state"))
    # a few rows per section by now
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("count"), F.asc("key")))
    ranked = rows.withColumn("rank", place)
    return ranked.where((F.col("section") != "type") | (F.col("rank") <= top_types)).drop("rank")


def run_statistics(results: DataFrame, threshold: float = 0.70, old_type: str | None = None) -> DataFrame:
    """Totals of a classification run over (document_type, confidence, method) rows."""
    done = F.col("document_type").isNotNull()
    aggregates = [
        F.count("*").alias("total"),
        F.count_if(done).alias("classified"),
        F.count_if(done & (F.col("confidence") >= threshold)).alias("high_confidence"),
        F.count_if(done & (F.col("confidence") < threshold)).alias("low_confidence"),
        F.count_if(~done).alias("failed"),
        F.round(F.try_divide(F.count_if(done), F.count("*")), 6).alias("success_rate"),
        F.round(
            F.coalesce(F.try_divide(F.count_if(done & (F.col("confidence") >= threshold)), F.count_if(done)), F.lit(0.0)), 6
        ).alias("high_confidence_rate"),
    ]
    if old_type:
        known = done & F.col(old_type).isNotNull()
        aggregates += [
            F.count_if(known & (F.col("document_type") != F.col(old_type))).alias("changed"),
            F.count_if(known & (F.col("document_type") == F.col(old_type))).alias("unchanged"),
        ]
    return results.agg(*aggregates)


def run_breakdown(results: DataFrame) -> DataFrame:
    """Classified rows by type and by method as (dimension, key, count)."""
    done = results.where(F.col("document_type").isNotNull())
    return (
        done.groupingSets([["document_type"], ["method"]], "document_type", "method")
        .agg(F.count("*").alias("count"), F.grouping("document_type").alias("g"))
        .select(
            F.when(F.col("g") == 0, "type").otherwise("method").alias("dimension"),
            F.coalesce("document_type", "method").alias("key"),
            "count",
        )
    )


def inbox_breakdown(registry: DataFrame, prefix: str) -> DataFrame:
    """Types of the documents below one path."""
    return registry.where(F.startswith(F.col("original_path"), F.lit(prefix))).groupBy(
        F.coalesce("document_type", F.lit("unclassified")).alias("document_type")
    ).agg(F.count("*").alias("count"))


def quick_statistics(registry: DataFrame, text_col: str) -> DataFrame:
    has_text = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    def pct(c: Column) -> Column:
        return F.round(F.try_divide(F.lit(100.0) * c, F.count("*")), 4)

    specific = F.count_if(F.col("document_type") != "general_document")
    return registry.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("confidence") >= 0.90).alias("high"),
        F.count_if(F.col("confidence") >= 0.75).alias("medium"),
        pct(F.count_if(has_text)).alias("has_text_pct"),
        specific.alias("specific"),
        pct(specific).alias("specific_pct"),
    )


def media_split(files: DataFrame) -> DataFrame:
    """image / video / document per extension."""
    ext = F.lower("extension")
    kind = F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("document")
    return files.groupBy(kind.alias("media_kind"), ext.alias("ext")).agg(F.count("*").alias("count"))


def name_keywords(files: DataFrame, n: int = 50, min_length: int = 3) -> DataFrame:
    """Most frequent name parts, the review prefix removed."""
    stem = paths.stem(F.col("path"))
    bare = F.regexp_replace(stem, r"^\d{4}-\d{2}-\d{2}_review_", "")
    words = files.select(F.explode(F.split(F.lower(bare), r"[_\[\]\s-]")).alias("keyword"))
    counted = words.where(F.length("keyword") >= min_length).groupBy("keyword").agg(F.count("*").alias("count"))
    return top_rows(counted, [F.desc("count"), F.asc("keyword")], n)


# --- look-ups ---------------------------------------------------------------


def unknown_rows(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("document_type").isNull() | (F.col("document_type") == "unknown"))


def low_confidence(registry: DataFrame, threshold: float = 0.5, n: int | None = 100) -> DataFrame:
    """Least confident rows first; rows without a confidence are not candidates."""
    rows = registry.where(F.col("confidence") < threshold)
    return rows if n is None else top_rows(rows, [F.asc("confidence"), F.asc("file_id")], n)


def review_window(registry: DataFrame, low: float = 0.0, high: float = 0.70) -> DataFrame:
    return registry.where((F.col("confidence") > low) & (F.col("confidence") < high))


def search(
    registry: DataFrame,
    document_type: str | None = None,
    min_confidence: float | None = None,
    max_confidence: float | None = None,
    name_pattern: str | None = None,
    n: int = 50,
) -> DataFrame:
    """Ad-hoc document query; patterns are case-insensitive LIKE."""
    keep = F.lit(True)
    if document_type:
        keep = keep & (F.col("document_type") == document_type)
    if min_confidence is not None:
        keep = keep & (F.col("confidence") >= min_confidence)
    if max_confidence is not None:
        keep = keep & (F.col("confidence") <= max_confidence)
    if name_pattern:
        keep = keep & F.col("file_name").ilike(name_pattern)
    return top_rows(registry.where(keep), [F.asc_nulls_first("confidence"), F.asc("file_id")], n)


def search_names(registry: DataFrame, term: str, n: int = 50, min_length: int = 3) -> DataFrame:
    """Substring search over names, newest ids first; short terms find nothing."""
    if len(term) < min_length:
        return registry.limit(0)
    hit = F.contains(F.lower("file_name"), F.lit(term.lower()))
    return top_rows(registry.where(hit), [F.desc("file_id")], n)


def page(registry: DataFrame, page_no: int = 1, per_page: int = 50, document_type=None, state=None) -> DataFrame:
    """One page, newest ids first."""
    return (
        _filtered(registry, document_type, state)
        .orderBy(F.desc("file_id"))
        .offset((page_no - 1) * per_page)
        .limit(per_page)
    )


def page_after(registry: DataFrame, last_id=None, per_page: int = 50, document_type=None, state=None) -> DataFrame:
    """The page after the id the last one ended with: an ordered limit, so no row is sorted only to be skipped."""
    rows = _filtered(registry, document_type, state)
    if last_id is not None:
        rows = rows.where(F.col("file_id") < last_id)
    return top_rows(rows, [F.desc("file_id")], per_page)


def page_total(registry: DataFrame, document_type=None, state=None) -> DataFrame:
    return _filtered(registry, document_type, state).agg(F.count("*").alias("total"))


def _filtered(registry: DataFrame, document_type, state) -> DataFrame:
    if document_type:
        registry = registry.where(F.col("document_type") == document_type)
    if state:
        registry = registry.where(F.col("canonical_state") == state)
    return registry


def by_id(df: DataFrame, value, column: str = "file_id") -> DataFrame:
    return df.where(F.col(column) == value)


def by_hash(files: DataFrame, digest: str, kind: str = "quick") -> DataFrame:
    return files.where(F.col(f"hash_{kind}") == digest)


def active(config: DataFrame, flag: str = "active", order: str = "priority") -> DataFrame:
    """Enabled rules, categories or sources, highest priority first."""
    return config.where(F.col(flag)).orderBy(F.desc(order))


# --- review queues ------------------------------------------------------------


def review_candidates(registry: DataFrame, priority: str = "critical", n: int | None = 20) -> DataFrame:
    """Rows needing review; a missing confidence never counts as low."""
    cut, generic = {
        "critical": (0.50, ("unknown",)),
        "high": (0.75, ("unknown", "general_document")),
        "all": (0.75, ("unknown", "general_document", "form")),
    }[priority]
    rows = registry.where((F.col("confidence") < cut) | F.col("document_type").isin(*generic))
    return rows if n is None else top_rows(rows, [F.asc_nulls_first("confidence"), F.asc("file_id")], n)


def misclassified(priority: str = "all") -> Column:
    """Known bad combinations of type and name."""
    kind, name = F.col("document_type"), F.col("file_name")
    resume = name.ilike("%resume%") | name.ilike("%CL.%" if priority == "critical" else "%yoga%")
    tools = name.ilike("%calculator%") | name.ilike("%estimator%")
    return (
        ((kind == "medical") & name.ilike("%vehicle%"))
        | ((kind == "hr_resume") & resume)
        | ((kind == "financial_invoice") & tools)
    )


def needs_review(priority: str = "all") -> Column:
    low, kind = F.col("confidence"), F.col("document_type")
    if priority == "critical":
        return (low < 0.50) | (kind == "unknown") | misclassified("critical")
    generic = (low < 0.75) | kind.isin(*GENERIC_TYPES)
    return generic if priority == "high" else generic | misclassified()


def review_order() -> list[Column]:
    """Priority class, then confidence (missing first), then name."""
    low = F.col("confidence")
    rank = (
        F.when(low < 0.50, 1).when(F.col("document_type") == "unknown", 2).when(low < 0.75, 3).otherwise(4)
    )
    return [rank.asc(), F.asc_nulls_first("confidence"), F.asc("file_name")]


# Suggestion families (name pattern, types that need none, exclusion, text).
SUGGESTIONS = (
    (r"(bmw|vehicle|diagnostic|carfax|vin|automotive|engine|repair)",
     ("automotive_technical", "automotive_service"), None, "automotive_technical OR automotive_service"),
    (r"(resume|cv|cover.?letter|cl\.|%resume)",
     ("personal_career", "hr_resume"), None, "personal_career (if yours) OR hr_resume (if applicant)"),
    (r"(yoga|meditation|patanjali|journal|chapter|essay)",
     ("personal_journal", "personal_essay"), None, "personal_journal OR personal_essay"),
    (r"(calculator|estimator|tool|planner|template)",
     ("personal_career_tool", "personal_finance_tool"), None, "personal_career_tool OR personal_finance_tool"),
    (r"(invoice|receipt|statement|bill)", ("financial*",), None,
     "financial_invoice OR financial_statement OR financial_receipt"),
    (r"(contract|agreement|legal|court|settlement)", ("legal*",), None,
     "legal_contract OR legal_agreement OR legal_court"),
    (r"(medical|patient|doctor|hospital|prescription)", ("medical", "medical_bill"),
     r"(vehicle|bmw|diagnostic.report|vin)", "medical OR medical_bill"),
    (r"(tax|1040|w-?2|1099|irs)", ("tax*",), None, "tax_document OR tax_form OR tax_return"),
    (r"(screenshot|screen.?shot|capture)", ("screenshot",), None, "screenshot"),
)

# Type + name combinations that point to another type.
LIKELY = (
    ("medical", r"(vehicle|diagnostic|bmw|vin)", "LIKELY automotive, not medical"),
    ("hr_resume", r"(%resume|cl\.|cover.?letter)", "LIKELY personal career, not HR recruiting"),
    ("financial_invoice", r"(calculator|estimator|tool)", "LIKELY tool, not invoice"),
    ("hr_resume", r"(yoga|meditation|journal|chapter)", "LIKELY personal journal, not resume"),
)


def _texts(conditions: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in conditions]))


def suggested_types(name: Column, kind: Column) -> Column:
    """Alternative types a name hints at, joined by `` | ``."""
    conditions = []
    for pattern, settled, exclusion, label in SUGGESTIONS:
        fits = F.lit(False)
        for value in settled:
            fits = fits | (F.startswith(kind, F.lit(value[:-1])) if value.endswith("*") else kind == value)
        hit = name.rlike(f"(?i){pattern}") & ~F.coalesce(fits, F.lit(False))
        if exclusion:
            hit = hit & ~name.rlike(f"(?i){exclusion}")
        conditions.append((hit, label))
    return F.array_join(_texts(conditions), " | ")


def review_reason(kind: Column, confidence: Column, name: Column) -> Column:
    """Why a row needs review; several reasons joined by ``; ``."""
    c = F.coalesce(confidence, F.lit(0.0))
    conditions = [
        (c < 0.50, "VERY LOW confidence"),
        ((c >= 0.50) & (c < 0.75), "Low confidence"),
        (kind.isin(*GENERIC_TYPES), "Generic classification"),
    ]
    conditions += [((kind == t) & name.rlike(f"(?i){p}"), label) for t, p, label in LIKELY]
    conditions += [
        (name.rlike(r"^file-[A-Za-z0-9]{22}-[A-F0-9]{8}-"), "Cryptic filename - needs content review"),
        (name.rlike(r"cco_\d{6}"), "Generic CCO file - needs context"),
    ]
    return F.coalesce(F.nullif(F.array_join(_texts(conditions), "; "), F.lit("")), F.lit("Flagged for review"))


def review_list(registry: DataFrame, priority: str = "all") -> DataFrame:
    """Rows to review with suggestions and reasons (order with ``review_order``)."""
    name, kind = F.col("file_name"), F.col("document_type")
    return registry.where(needs_review(priority)).select(
        "file_id",
        "file_name",
        "document_type",
        "confidence",
        suggested_types(name, kind).alias("suggested_types"),
        review_reason(kind, F.col("confidence"), name).alias("reason"),
    )


def review_statistics(review: DataFrame) -> DataFrame:
    """Rows per current type and per single reason."""
    types = review.groupBy(F.col("document_type").alias("key")).agg(F.count("*").alias("count"))
    reasons = review.select(F.explode(F.split("reason", "; ")).alias("key")).groupBy("key").agg(F.count("*").alias("count"))
    return types.select(F.lit("type").alias("dimension"), "key", "count").unionByName(
        reasons.select(F.lit("reason").alias("dimension"), "key", "count")
    )
