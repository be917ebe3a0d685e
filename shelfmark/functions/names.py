"""File-name cleaning, naming conventions and metadata read out of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths

# Suffix patterns removed, in this order, before names are compared.
COPY_MARKERS = (
    r"\s*\(\d+\)",
    r"\s*-\s*Copy\s*\d*",
    r"\s*_copy\s*\d*",
    r"\s*-\s*copy\s*\d*",
    r"\s*_backup\s*\d*",
    r"\s*\d{4}-\d{2}-\d{2}",
    r"\s*\d{8}",
    r"\s*_v\d+",
    r"\s*v\d+",
    r"\s*_final\s*",
    r"\s*_FINAL\s*",
    r"\s*\(final\)",
)

# Version spellings, tried in order.
VERSION_PATTERNS = (r"_v(\d+)", r"v(\d+)", r"version[\s_-]?(\d+)", r"\(v?(\d+)\)")

# English month abbreviations used in file names.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Patterns for dates, vendors, invoice and case numbers in names.
DATE_YMD = r"(\d{4})[_-](\d{2})[_-](\d{2})"
DATE_MDY = r"(\d{2})[/_-](\d{2})[/_-](\d{4})"
DATE_MONTH = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{1,2}),?\s+(\d{4})\b"
DATE_COMPACT = r"(\d{8})"
VENDOR_AFTER_DATE = r"^(\d{4}-\d{2}-\d{2})_([^_]+?)_"
VENDOR_AT_START = r"^([A-Z][a-zA-Z\s&]+?)[-_]"
INVOICE_PATTERNS = (
    r"(?i)(?:Invoice|INV|invoice)[#\s_-]*:?\s*([A-Z0-9_-]+)",
    r"(?i)\b(INV[0-9]+)\b",
    r"(?i)#(\d{5,})",
)
CASE_PATTERNS = (r"(?i)(?:Case|Docket|case)[#\s_-]*:?\s*([A-Z0-9_-]+)",)
VEHICLE = r"(?i)(BMW|Mercedes|Audi|VW|Volkswagen)\s*([A-Z0-9]+)"

FINANCIAL_TYPES = ("financial_invoice", "financial_statement", "financial_receipt")
LEGAL_TYPES = ("legal_contract", "legal_court", "legal_agreement")
AUTOMOTIVE_TYPES = ("automotive_technical", "automotive_service")
CAREER_TYPES = ("personal_career", "hr_resume")


def extracted(value: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that answers NULL, not empty, when nothing matches."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def first_extracted(value: Column, patterns, group: int = 1) -> Column:
    return F.coalesce(*[extracted(value, p, group) for p in patterns])


def sanitize(value: Column) -> Column:
    """Drop characters no file system takes, spaces to one underscore, trim them."""
    cleaned = F.regexp_replace(value, r'[<>:"/\\|?*]', "")
    return F.btrim(F.regexp_replace(cleaned, r"\s+", "_"), F.lit("_"))


def normalize(file_name: Column) -> Column:
    """Comparison form: copy, backup, date and version marks removed, lower case."""
    bare = reduce(lambda c, p: F.regexp_replace(c, f"(?i){p}", ""), COPY_MARKERS, file_name)
    return F.btrim(F.lower(bare), F.lit(" \t\n\r\x0b\x0c"))


def version(file_name: Column) -> Column:
    """``vNN`` of the first version spelling found, else NULL."""
    digits = first_extracted(file_name, [f"(?i){p}" for p in VERSION_PATTERNS])
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.concat(F.lit("v"), F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain))


def conventional_name(date: Column, project: Column, kind: Column, ver: Column, ext: Column) -> Column:
    """date_project_type_version.ext with empty components skipped."""
    body = F.concat_ws(
        "_",
        F.nullif(date, F.lit("")),
        F.nullif(sanitize(project), F.lit("")),
        F.nullif(sanitize(kind), F.lit("")),
        F.nullif(ver, F.lit("")),
    )
    dotted = F.when((ext != "") & ~F.startswith(ext, F.lit(".")), F.concat(F.lit("."), ext)).otherwise(ext)
    return F.concat(body, F.coalesce(dotted, F.lit("")))


def real_name(path: Column) -> Column:
    """Name behind a ``YYYY-MM-DD_{placeholder}_`` prefix, else the name itself."""
    n = paths.name(path)
    return F.coalesce(extracted(n, r"^\d{4}-\d{2}-\d{2}_(?:\{[^}]+\}_)*(.+)$"), n)


def date_in_name(value: Column) -> Column:
    """First date found as YYYY-MM-DD; patterns are tried in a fixed order."""
    def group(pattern: str, g: int) -> Column:
        return F.regexp_extract(value, pattern, g)

    month = F.lpad(
        F.array_position(F.array(*[F.lit(m) for m in MONTHS]), group(DATE_MONTH, 1)).cast("string"), 2, "0"
    )
    compact = group(DATE_COMPACT, 1)
    return (
        F.when(value.rlike(DATE_YMD), F.concat_ws("-", *[group(DATE_YMD, g) for g in (1, 2, 3)]))
        .when(value.rlike(DATE_MDY), F.concat_ws("-", *[group(DATE_MDY, g) for g in (3, 1, 2)]))
        .when(
            value.rlike(DATE_MONTH),
            F.concat_ws("-", group(DATE_MONTH, 3), month, F.lpad(group(DATE_MONTH, 2), 2, "0")),
        )
        .when(
            compact != "",
            F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2)),
        )
    )


def vendor_in_name(value: Column) -> Column:
    """Company at the start of a name, or after its date; at most 30 characters."""
    raw = F.coalesce(extracted(value, VENDOR_AFTER_DATE, 2), extracted(value, VENDOR_AT_START, 1))
    spaced = F.btrim(F.regexp_replace(raw, r"[_-]+", " "))
    return F.left(F.regexp_replace(spaced, r"\s+", "_"), F.lit(30))


def invoice_in_name(value: Column) -> Column:
    return F.left(first_extracted(value, INVOICE_PATTERNS), F.lit(20))


def case_in_name(value: Column) -> Column:
    return F.left(first_extracted(value, CASE_PATTERNS), F.lit(20))


def component(value: Column) -> Column:
    """Name component: separators collapse to one underscore, ends trimmed."""
    cleaned = F.regexp_replace(value, r'[<>:"/\\|?*]', "")
    return F.btrim(F.regexp_replace(cleaned, r"[\s_-]+", "_"), F.lit("_-"))


def distinct_ignoring_case(items: Column) -> Column:
    """Keep the first spelling of each item, compared in lower case."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def with_enhanced_name(
    df: DataFrame, name_col: str = "file_name", type_col: str = "document_type", out: str = "new_name"
) -> DataFrame:
    """Adds a name led by what could be read from it, or NULL when nothing could.

    Names that already start with a date are left alone.
    """
    name, kind = F.col(name_col), F.col(type_col)
    none = F.lit(None).cast("string")
    staged = df.withColumns(
        {
            "_vendor": F.nullif(vendor_in_name(name), F.lit("")),
            "_ext": F.regexp_extract(name, r"^.*[^.].*?(\.[^.]*)$", 1),
            "_vehicle": F.when(
                name.rlike(VEHICLE),
                F.concat_ws("_", F.regexp_extract(name, VEHICLE, 1), F.regexp_extract(name, VEHICLE, 2)),
            ),
        }
    )
    specific = (
        F.when(
            kind.isin(*FINANCIAL_TYPES), F.nullif(F.concat_ws("_", F.col("_vendor"), invoice_in_name(name)), F.lit(""))
        )
        .when(kind.isin(*LEGAL_TYPES), F.coalesce(case_in_name(name), F.col("_vendor")))
        .when(kind.isin(*AUTOMOTIVE_TYPES), F.col("_vehicle"))
        .when(kind.isin(*CAREER_TYPES), F.concat(F.lit("v"), extracted(name, r"(?i)v(\d+)")))
        .otherwise(none)
    )
    lead = F.nullif(F.concat_ws("_", date_in_name(name), specific), F.lit(""))
    base = F.left(name, F.length(name) - F.length("_ext"))
    led = staged.withColumn("_lead", F.when(~name.rlike(r"^\d{4}-\d{2}-\d{2}_"), lead))
    parts = F.split(F.concat_ws("_", F.col("_lead"), F.nullif(F.left(component(base), F.lit(50)), F.lit(""))), "_")
    # generated columns: the lambda below reads them once per row instead of rebuilding them
    staged = led.select("*", F.inline(F.array(F.struct(parts.alias("p")))).alias("_parts"))
    unique = F.array_join(distinct_ignoring_case(F.col("_parts")), "_")
    return staged.withColumn(
        out, F.when(F.col("_lead").isNotNull(), F.concat(component(unique), F.col("_ext")))
    ).drop("_vendor", "_ext", "_vehicle", "_lead", "_parts")


def safe_path_part(value: Column) -> Column:
    """Folder-name sanitising used while templates are filled."""
    marked = F.regexp_replace(value, r'[<>:"|?*]', "_")
    return F.btrim(F.regexp_replace(marked, r"[\\/]", "-"))


def safe_file_name(value: Column, max_length: int = 200) -> Column:
    """File-name sanitising; over-long names are cut before the extension."""
    marked = F.regexp_replace(value, r'[<>:"|?*\\/]', "_")
    clean = F.regexp_replace(F.regexp_replace(marked, r"[\x00-\x1f]", ""), r"[_\s]+", "_")
    clean = F.btrim(clean, F.lit("_. "))
    ext = F.substring_index(clean, ".", -1)
    body = F.left(clean, F.length(clean) - F.length(ext) - 1)
    cut = F.concat(F.left(body, F.lit(max_length) - F.length(ext) - 1), F.lit("."), ext)
    return F.when(F.length(clean) > max_length, cut).otherwise(clean)


def subtype_label(document_type: Column) -> Column:
    """``financial_invoice_paid`` -> ``Invoice Paid``; one word -> itself, capitalised."""
    rest = F.when(F.instr(document_type, "_") > 0, F.substr(document_type, F.instr(document_type, "_") + 1)).otherwise(
        document_type
    )
    return F.initcap(F.replace(rest, F.lit("_"), F.lit(" ")))


def name_fields(file_name: Column, as_of: Column) -> Column:
    """struct of date parts, invoice number, vendor and VIN read from a name.

    A full date fixes all three date parts; without any year the clock supplies them.
    """
    dashed = F.replace(extracted(file_name, r"(\d{4}[-_]\d{2}[-_]\d{2})"), F.lit("_"), F.lit("-"))
    parsed = F.try_to_timestamp(dashed, F.lit("yyyy-MM-dd")).cast("date")
    year = extracted(file_name, r"(\d{4})")
    month, day = extracted(file_name, r"[-_](\d{2})[-_]"), extracted(file_name, r"[-_](\d{2})(?:\D|$)")

    def pick(fmt: str, loose: Column) -> Column:
        return (
            F.when(parsed.isNotNull(), F.date_format(parsed, fmt))
            .when(year.isNotNull(), loose)
            .otherwise(F.date_format(as_of, fmt))
        )

    return F.struct(
        F.when(parsed.isNotNull(), dashed).otherwise(
            F.when(year.isNull(), F.date_format(as_of, "yyyy-MM-dd"))
        ).alias("date"),
        pick("yyyy", year).alias("yyyy"),
        pick("MM", month).alias("mm"),
        pick("dd", day).alias("dd"),
        extracted(file_name, r"(?i)(?:invoice|inv|#)[\s_-]*([A-Z0-9\-]+)").alias("invoice_number"),
        extracted(file_name, r"^([A-Za-z]+)_").alias("vendor_name"),
        extracted(file_name, r"(?i)\b([A-HJ-NPR-Z0-9]{17})\b").alias("vin"),
    )


def search_terms(file_name: Column) -> Column:
    """Query text for a name: identifiers and topic phrases, else its first five words.

    NULL for names that carry identifiers nobody should send out.
    """
    from shelfmark.functions.text import is_sensitive

    base = F.left(file_name, F.length(file_name) - F.length(paths.suffix_of_name(file_name)))
    low = F.lower(base)

    def any_of(*terms: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms])

    found = F.concat_ws(
        " ",
        F.concat(F.lit("VIN "), extracted(base, r"\b([A-HJ-NPR-Z0-9]{17})\b")),
        F.when(base.rlike(VEHICLE), F.concat_ws(" ", F.regexp_extract(base, VEHICLE, 1), F.regexp_extract(base, VEHICLE, 2))),
        extracted(base, r"\b((?:ST|P|SKU|PN)\d{4,})\b"),
        F.when(F.contains(base, F.lit("CARFAX")), F.lit("CARFAX vehicle history")),
        F.when(
            any_of("diagnostic"),
            F.when(any_of("vehicle", "car", "bmw", "automotive"), F.lit("vehicle diagnostic report")).when(
                any_of("patient", "medical", "doctor"), F.lit("medical diagnostic report")
            ),
        ),
        F.when(base.rlike(r"(?i)(training|module|course)"), F.lit("technical training module")),
    )
    plain = F.regexp_replace(F.regexp_replace(base, r"(?i)^(file|document|scan|img)[_-]", ""), r"[A-Za-z0-9]{22,}", "")
    words = F.array_join(F.slice(F.regexp_extract_all(plain, F.lit(r"\b([A-Za-z]{3,})\b")), 1, 5), " ")
    return F.when(~is_sensitive(file_name), F.coalesce(F.nullif(found, F.lit("")), F.nullif(words, F.lit(""))))
