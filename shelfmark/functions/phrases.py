"""Weighted phrase scoring of a document into one of about 35 types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.functions.rules import with_struct
from shelfmark.functions.text import any_phrase

# What a file name alone says (type, name parts, score), in order.
NAME_SCORES = (
    ("technical_config", (".json", ".xml", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf"), 95),
    ("technical_code", (".py", ".js", ".java", ".cpp", ".c", ".h", ".cs", ".go", ".rs"), 95),
    ("technical_documentation", (".md", ".rst", ".txt"), 90),
    ("hr_resume", ("resume", "cv", "curriculum"), 85),
    ("financial_invoice", ("invoice", "bill", "receipt"), 80),
)
DOCUMENTATION_WORDS = ("readme", "doc", "guide", "manual")

# Content scores.  (type, threshold, ((points, phrases), ...)); a type
# counts once its points reach the threshold.  Entries naming "money2", "dates3",
# "date", "irs" or "boxes" add points for counted signals instead of phrases.
SCORED_TYPES = (
    ("financial_invoice", 40, (
        (40, ("invoice number", "bill to", "invoice date", "due date")),
        (20, "money2"),
        (20, ("amount due", "total amount", "subtotal", "tax amount")),
        (10, ("payment terms", "pay by", "remit to")))),
    ("financial_statement", 40, (
        (40, ("account number", "statement period", "beginning balance", "ending balance")),
        (20, ("transaction", "deposit", "withdrawal", "debit", "credit")),
        (10, "dates3"))),
    ("legal_contract", 40, (
        (40, ("this agreement", "parties agree", "hereby", "whereas")),
        (20, ("terms and conditions", "effective date", "termination")))),
    ("legal_court", 40, (
        (40, ("plaintiff", "defendant", "case number", "court")),
        (20, ("motion", "hearing", "order", "judgment")))),
    ("medical", 40, (
        (40, ("patient", "diagnosis", "treatment", "prescription")),
        (20, ("medical history", "symptoms", "medication", "doctor")),
        (5, "date"))),
    ("hr_resume", 40, (
        (30, ("professional experience", "work experience", "employment history")),
        (20, ("education", "degree", "university", "graduated")),
        (15, ("skills", "proficient", "expertise")),
        (15, ("resume", "curriculum vitae", "cv")))),
    ("tax_document", 40, (
        (50, ("1099", "w-2", "w2", "1040", "tax return")),
        (20, ("tax year", "taxable income", "withholding")),
        (10, "irs"))),
    ("communication_email", 60, ((60, "email"),)),
    ("communication_letter", 55, ((55, "letter"),)),
    ("form", 30, (
        (30, ("application form", "please fill", "signature required")),
        (20, "boxes"))),
    ("technical_manual", 60, ((60, ("user manual", "installation guide", "troubleshooting", "specifications")),)),
    ("report", 50, ((50, ("executive summary", "findings", "recommendations", "analysis")),)),
    ("automotive_technical", 40, (
        (30, ("parts diagram", "engine", "cylinder", "transmission", "suspension")),
        (20, ("bmw", "mercedes", "audi", "volkswagen", "parts", "repair")),
        (15, ("diagnostic", "torque", "oil", "brake", "clutch")))),
    ("automotive_service", 65, ((65, ("service manual", "repair instructions", "maintenance", "oil change")),)),
    ("realestate_listing", 60, (
        (60, ("property", "real estate", "listing", "bedroom", "bathroom", "square feet")),)),
    ("realestate_contract", 70, ((70, ("lease agreement", "rental agreement", "property purchase", "escrow")),)),
    ("product_manual", 35, (
        (30, ("user manual", "product guide", "instructions", "installation")),
        (20, ("specifications", "features", "warranty", "model number")))),
    ("product_catalog", 55, ((55, ("catalog", "product line", "collection", "available in")),)),
    ("educational_material", 60, ((60, "lesson_with_date"),)),
    ("educational_guide", 55, ((55, ("how to", "step by step", "tutorial", "guide to", "getting started")),)),
    ("business_marketing", 60, ((60, ("marketing plan", "sales strategy", "campaign", "target audience")),)),
    ("business_proposal", 65, ((65, "quote_with_money"),)),
    ("insurance_document", 70, ((70, ("insurance policy", "coverage", "premium", "deductible", "claim")),)),
    ("travel_document", 65, ((65, ("itinerary", "flight", "hotel", "reservation", "booking confirmation")),)),
    ("recipe", 60, ((60, ("recipe", "ingredients", "instructions", "serves", "cooking time")),)),
    ("personal_biography", 60, ((60, "biography"),)),
    ("scientific_report", 65, ((65, ("experiment", "hypothesis", "results", "discussion", "conclusion")),)),
)

# Phrase lists behind the combined signals above.
LETTER_PHRASES = ("dear", "sincerely", "regards", "best regards")
LESSON_PHRASES = ("chapter", "lesson", "exercise", "quiz", "homework")
QUOTE_PHRASES = ("proposal", "quote", "estimate", "scope of work", "deliverables")
BIOGRAPHY_PHRASES = ("born", "education", "career", "achievements")
BIOGRAPHY_NAMES = ("bio", "about")


def signals(text: Column, low: Column, name_low: Column) -> dict[str, Column]:
    """Counted or combined signals.  Money and dates are regex counts; persons are
    not recognised, so types that need several authors are never proposed."""
    money, dates = F.col("_money"), F.col("_dates")
    letter = any_phrase(low, LETTER_PHRASES)
    mail = F.contains(text, F.lit("@")) & F.contains(low, F.lit("from:"))
    boxes = F.greatest(F.regexp_count(low, F.lit("☐")), F.regexp_count(low, F.lit(r"\[ \]")))
    return {
        "money2": money >= 2,
        "dates3": dates >= 3,
        "date": dates > 0,
        "irs": F.contains(low, F.lit("irs")),
        "email": letter & mail,
        "letter": letter & ~mail,
        "boxes": boxes > 5,
        "lesson_with_date": any_phrase(low, LESSON_PHRASES) & (dates > 0),
        "quote_with_money": any_phrase(low, QUOTE_PHRASES) & (money > 0),
        "biography": any_phrase(name_low, BIOGRAPHY_NAMES) & any_phrase(low, BIOGRAPHY_PHRASES),
    }


def score_table(text: Column) -> list[tuple[str, Column, Column]]:
    """(type, score, tie position) per type; score is NULL when the type is not proposed.

    A content score replaces the score the file name gave, but a type first proposed
    by its name keeps that earlier position among equal scores.
    """
    low, name_low = F.col("_low"), F.col("_nlow")
    known = signals(text, low, name_low)
    by_name = {}
    for place, (kind, marks, points) in enumerate(NAME_SCORES):
        hit = any_phrase(name_low, marks)
        if kind == "technical_documentation":
            hit = hit & any_phrase(name_low, DOCUMENTATION_WORDS)
        by_name[kind] = (F.when(hit, F.lit(points)), hit, place)
    table = []
    content = {kind for kind, _, _ in SCORED_TYPES}
    for kind, (points, _, place) in by_name.items():
        if kind not in content:
            table.append((kind, points, F.lit(place)))
    for place, (kind, threshold, parts) in enumerate(SCORED_TYPES, start=len(NAME_SCORES)):
        points = reduce(
            lambda a, b: a + b,
            [F.when(known[p] if isinstance(p, str) else any_phrase(low, p), n).otherwise(0) for n, p in parts],
        )
        score, position = F.when(points >= threshold, points), F.lit(place)
        if kind in by_name:
            name_points, hit, early = by_name[kind]
            score = F.coalesce(score, name_points)
            position = F.when(hit, F.lit(early)).otherwise(position)
        table.append((kind, score, position))
    return table


def best_type(text: Column) -> Column:
    """struct(score, rank, kind) of the highest scoring type; NULL when nothing scores."""
    entries = F.array(
        *[
            F.struct(score.cast("int").alias("score"), (-place).alias("rank"), F.lit(kind).alias("kind"))
            for kind, score, place in score_table(text)
        ]
    )
    return F.array_max(F.filter(entries, lambda e: e["score"].isNotNull()))


def with_inferred_type(docs: DataFrame, text_col: str, name_col: str, short_below: int = 500) -> DataFrame:
    """Adds inferred_type; general types when nothing scores, unknown for blank texts.

    Lower-cased texts and counted signals are columns first, so each is computed once
    and not once per phrase list.
    """
    text = F.col(text_col)
    staged = docs.withColumns(
        {
            "_low": F.lower(text_col),
            "_nlow": F.lower(name_col),
            "_money": tx.money_count(text),
            "_dates": tx.date_count(text),
        }
    )
    scored = with_struct(staged, best_type(text), ["_score", "_rank", "_kind"])
    general = F.when(F.length(text) < short_below, "general_document_short").otherwise("general_document")
    return scored.withColumn(
        "inferred_type", F.when(tx.is_blank(text), "unknown").otherwise(F.coalesce("_kind", general))
    ).drop("_low", "_nlow", "_money", "_dates", "_score", "_rank", "_kind")
