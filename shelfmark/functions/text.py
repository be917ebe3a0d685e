"""Expressions over document text; always the whole text, never a prefix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

# Fallback stop-word list.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for")

# Sentiment word sets.
POSITIVE_WORDS = ("good", "great", "excellent", "success", "approved", "congratulations")
NEGATIVE_WORDS = ("bad", "error", "failure", "denied", "rejected", "urgent", "overdue")

# Text patterns.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
# one character class ($-_ holds the percent sign): an alternation inside a repeated group recurses with the length of the address
URL = r"http[s]?://[a-zA-Z0-9$-_@.&+!*\\(),]+"
NUMERIC_DATE = r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"
AMOUNT = r"\$\s?([\d,]+\.?\d{0,2})"
INVOICE_NUMBER = r"(?i)(?:invoice|inv|bill)[\s#:]*([A-Z0-9-]+)"
VIN = r"\b([A-HJ-NPR-Z0-9]{17})\b"
MILEAGE = r"(?i)(\d{1,3},?\d{3,6})\s*(?:miles|km|mi)"
CASE_NUMBER = r"(?i)(?:case|docket)[\s#:]*([A-Z0-9-]+)"
MONTH_DATE = r"(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b"

# Identifiers that mark a text as sensitive.
SENSITIVE = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{16}\b",
    "record_id": r"(?i)\b(?:patient|account|policy)[_\s]?(?:id|number)\b",
}

# Configured extraction patterns per metadata field, first match wins.
DOMAIN_PATTERNS = {
    "date": (
        r"(\d{4}-\d{2}-\d{2})",
        r"(\d{2}/\d{2}/\d{4})",
        r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4})\b",
    ),
    "invoice_number": (r"(?i)(?:Invoice|INV|Order|#)\s*:?\s*([A-Z0-9-]+)",),
    "amount": (r"\$([\d,]+\.\d{2})",),
    "case_number": (r"(?i)(?:Case|Docket)\s*#?\s*:?\s*([A-Z0-9-]+)",),
    "vin": (r"\b([A-HJ-NPR-Z0-9]{17})\b",),
    "vehicle_model": (r"\b((?:BMW|Mercedes|Audi|Ford|Toyota|Honda)\s+[A-Z0-9]+)\b",),
    "part_number": (r"(?:Part|P/N)\s*:?\s*([A-Z0-9-]+)",),
}


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def any_phrase(low: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def phrase_hits(low: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur at least once."""
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in phrases])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def ratio(over: Column, under: Column) -> Column:
    """``over / under`` of numbers that are not negative; by zero it is infinite, 0 / 0 is NaN, as in SQL on doubles."""
    by_zero = F.when(over > 0, F.lit(float("inf"))).when(over == 0, F.lit(float("nan")))
    return F.when(under == 0, by_zero).otherwise(F.try_divide(over, under))


def is_blank(text: Column, min_chars: int = 10) -> Column:
    """True for texts too short to analyse (fewer than ten characters stripped)."""
    return F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))) < min_chars


def statistics(text: Column) -> Column:
    """struct of character, word, sentence and distinct-word counts."""
    words = tokens(text)
    n = F.size(words)
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    letters = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w))
    sentences = F.regexp_count(text, F.lit(r"[.!?]+(?:\s|$)"))
    return F.struct(
        F.length(text).cast("long").alias("char_count"),
        n.cast("long").alias("word_count"),
        F.greatest(sentences, F.lit(1)).cast("long").alias("sentence_count"),
        F.size(F.array_distinct(kept)).cast("long").alias("unique_words"),
        F.round(F.coalesce(F.try_divide(letters, n), F.lit(0.0)), 6).alias("avg_word_length"),
    )


def sentiment(low: Column) -> Column:
    good, bad = phrase_hits(low, POSITIVE_WORDS), phrase_hits(low, NEGATIVE_WORDS)
    return F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")


def money_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(AMOUNT))


def date_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NUMERIC_DATE)) + F.regexp_count(text, F.lit(MONTH_DATE))


def key_entities(text: Column, n: int = 3) -> Column:
    """First distinct entities, dates before amounts."""
    found = F.concat(find_all(text, NUMERIC_DATE), find_all(text, MONTH_DATE), find_all(text, AMOUNT, 0))
    return F.slice(F.array_distinct(found), 1, n)


def summary(text: Column) -> Column:
    """First sentence, at most 200 characters, then the key entities found."""
    trimmed = F.ltrim(text)
    first = F.nullif(F.regexp_extract(trimmed, r"(?s)^(.*?[.!?])(?:\s|$)", 1), F.lit(""))
    entities = key_entities(text)
    tail = F.when(F.size(entities) > 0, F.concat(F.lit(" | Key entities: "), F.array_join(entities, ", ")))
    return F.concat(F.left(F.coalesce(first, trimmed), F.lit(200)), F.coalesce(tail, F.lit("")))


def is_sensitive(value: Column) -> Column:
    flag = {k: p if p.startswith("(?i)") else "(?i)" + p for k, p in SENSITIVE.items()}
    return reduce(lambda a, b: a | b, [value.rlike(p) for p in flag.values()])


def metadata_by_type(text: Column, document_type: Column) -> Column:
    """map of field -> values; which fields apply depends on the document type."""
    def clip(pattern: str, n: int) -> Column:
        return F.slice(find_all(text, pattern), 1, n)

    kind = (
        F.when(F.contains(document_type, F.lit("financial")), "financial")
        .when(F.contains(document_type, F.lit("automotive")), "automotive")
        .when(F.contains(document_type, F.lit("legal")), "legal")
    )
    empty = F.array().cast("array<string>")

    def only(name: str, value: Column) -> Column:
        return F.when(kind == name, value).otherwise(empty)

    entries = F.array(
        F.struct(F.lit("dates").alias("key"), clip(NUMERIC_DATE, 5).alias("value")),
        F.struct(F.lit("amounts").alias("key"), only("financial", clip(AMOUNT, 3)).alias("value")),
        F.struct(F.lit("invoice_numbers").alias("key"), only("financial", clip(INVOICE_NUMBER, 2)).alias("value")),
        F.struct(F.lit("vin").alias("key"), only("automotive", clip(VIN, 1)).alias("value")),
        F.struct(F.lit("mileage").alias("key"), only("automotive", clip(MILEAGE, 1)).alias("value")),
        F.struct(F.lit("case_numbers").alias("key"), only("legal", clip(CASE_NUMBER, 2)).alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def domain_field(text: Column, field: str, patterns: dict = DOMAIN_PATTERNS) -> Column:
    """First configured pattern that matches, NULL when none does."""
    tries = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns[field]]
    return F.coalesce(*tries)


# The named entities unescaped after tags are dropped.
HTML_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&amp;", "&"),
)


def html_to_text(html: Column) -> Column:
    """Visible text of a page, one line per text run."""
    bare = html
    for element in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?is)<{element}\b.*?</{element}\s*>", "")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", "")
    lines = F.regexp_replace(bare, r"<[^>]*>", "\n")
    for entity, char in HTML_ENTITIES:
        lines = F.replace(lines, F.lit(entity), F.lit(char))
    squeezed = F.regexp_replace(F.regexp_replace(lines, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(squeezed, F.lit(" \n"))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def whitespace_word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
