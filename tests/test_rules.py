"""Rule tables and decisions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import rule_tables as tables
from shelfmark.functions import rules
from shelfmark.operators import categories, classify, registry

CASES = {
    "script.py": "technical_script", "main.js": "technical_script", "build.sh": "technical_script", "lib.rs": "technical_script",
    "config.json": "technical_config", "settings.yml": "technical_config", ".env": "technical_config", ".env.local": "technical_config",
    "report.pdf": "document_pdf", "document.docx": "document_word", "notes.txt": "document_text", "slides.pptx": "business_presentation",
    "my_resume_2024.pdf": "personal_career", "invoice_12345.pdf": "financial_document", "video.mp4": "media_video", "song.mp3": "media_audio",
    "screenshot_2024-01-15.png": "media_screenshot", "company_logo.png": "media_graphic", "README.txt": "technical_documentation",
    "LICENSE.txt": "technical_documentation", "cover_letter_google.pdf": "personal_career", "model.dwg": "design_cad",
    "design.psd": "design_photoshop", "icon.svg": "design_vector", "data.db": "technical_database", "backup.tar.gz": "archive",
    "font.woff2": "web_font", "bmw service notes.md": None, "bmw guide.md": "technical_documentation", "mystery.qqq": None,
    "user manual.pdf": "technical_documentation", "export.html": "web_bookmark", "obd setup.exe": None, "page.htm": "web_page",
}


def test_path_rules(spark):
    rows = spark.createDataFrame([(n,) for n in CASES], "path string")
    got = {r.path: r.document_type for r in classify.with_pattern_type(rows).collect()}
    assert got == CASES


def test_method_follows_priority(spark):
    rows = spark.createDataFrame([("a.py",), ("a.pdf",), ("a.qqq",)], "path string")
    got = {r.path: (r.method, r.matched_rule) for r in classify.with_pattern_type(rows).collect()}
    assert got == {"a.py": ("pattern_override", "script_files"), "a.pdf": ("pattern_extension", "pdf_general"), "a.qqq": ("no_match", None)}


def test_custom_rules_and_config_entries(spark):
    extra = rules.rules_from_config([{"name": "x", "document_type": "special", "confidence": 0.5, "file_pattern": "zz", "priority": 99}])
    rows = spark.createDataFrame([("azz.py",), ("b.py",)], "path string")
    got = {r.path: r.document_type for r in classify.with_pattern_type(rows, rule_list=extra + tables.PATTERN_RULES).collect()}
    assert got == {"azz.py": "special", "b.py": "technical_script"}


def test_priority_bands():
    bands = rules.priority_bands(tables.PATTERN_RULES)
    assert sum(bands.values()) == len(tables.PATTERN_RULES) and bands["high (90+)"] == 6 and bands["low (<70)"] == 1


def test_rule_statistics(spark):
    got = {r.band: r.rules for r in classify.rule_statistics(spark).collect()}
    assert got == rules.priority_bands(tables.PATTERN_RULES)


@pytest.mark.parametrize(
    "name,expected",
    [
        ("3' E92 328i manual.pdf", "automotive_technical"), ("CARFAX 2020.pdf", "automotive_service"),
        ("Chapter 1 Yoga brake.pdf", "personal_journal"), ("mortgage_calculator.xlsx", "personal_finance_tool"),
        ("Order R289686309.pdf", "financial_invoice"), ("statement_20240101_20240131.pdf", "financial_statement"),
        ("2024-01-01_review_cco_123456.pdf", "unknown"), ("Screenshot 2024-01-01.png", "screenshot"), ("zzz.qq", None),
    ],
)
def test_name_rules(spark, name, expected):
    row = spark.createDataFrame([(name,)], "name string")
    assert classify.with_name_rule_type(row).collect()[0].document_type == expected


def test_keyword_fallbacks(spark):
    rows = spark.createDataFrame([("Invoice total tax amount", "/a.txt"), ("nothing here", "/a.py"), ("nothing here", "/a.qq")], "text string, path string")
    got = [(r.predicted_category, r.confidence) for r in classify.with_keyword_type(rows).collect()]
    assert got == [("financial_document", 0.8), ("technical_script", 0.3), ("unknown", 0.1)]


def test_content_rules(spark):
    rows = spark.createDataFrame([("Invoice. Bill to: x. Amount due 5",), ("court docket plaintiff defendant",), ("hello",)], "text string")
    got = [(r.document_type, r.confidence, r.keywords_matched) for r in classify.with_content_type(rows).collect()]
    assert got == [("financial_invoice", 0.57, 3), ("legal_court", 0.613333, 4), (None, None, None)]


def test_decision_order(spark):
    rows = spark.createDataFrame(
        [("CARFAX.pdf", "x"), ("brochure.pdf", "invoice bill to amount due"), ("brochure.pdf", "nothing"), ("a.txt", "invoice bill to amount due")],
        "name string, text string")
    got = [(r.document_type, r.method) for r in classify.document_decision(rows).collect()]
    assert got == [("automotive_service", "filename_pattern"), ("financial_invoice", "content_keywords"),
                   ("technical_documentation", "filename_fallback"), ("general_document", "fallback")]


def test_phrase_types(spark):
    rows = spark.createDataFrame(
        [("Dear sir, best regards, from: a@b.c, thank you", "x"), ("patient diagnosis and symptoms listed", "x"),
         ("plain words without any topic at all", "notes"), ("short", "x"), ("The plaintiff and defendant in court", "resume.pdf")],
        "text string, name string")
    got = [r.inferred_type for r in classify.with_phrase_type(rows).collect()]
    assert got == ["communication_email", "medical", "general_document_short", "unknown", "hr_resume"]


def test_category_special_names_win(spark):
    rows = spark.createDataFrame([("a.log", ".log"), ("~$a.docx", ".docx"), ("k.key", ".key"), ("a.zzz", ".zzz"), ("x.exe", ".exe")], "name string, extension string")
    got = {r.name: (r.file_category, r.file_subcategory) for r in categories.with_category(rows).collect()}
    assert got == {"a.log": ("system", "logs"), "~$a.docx": ("system", "temp_files"), "k.key": ("security", "keys"),
                   "a.zzz": ("other", "unknown"), "x.exe": ("executables", "installers")}


def test_review_texts(spark):
    rows = spark.createDataFrame(
        [("vehicle report.pdf", "medical", 0.9), ("x.pdf", "unknown", None), ("tool invoice.pdf", "financial_invoice", 0.6)],
        "file_name string, document_type string, confidence double")
    got = rows.select(registry.review_reason(F.col("document_type"), F.col("confidence"), F.col("file_name")).alias("r"),
                      registry.suggested_types(F.col("file_name"), F.col("document_type")).alias("s")).collect()
    assert got[0].r == "LIKELY automotive, not medical"
    assert got[0].s == "automotive_technical OR automotive_service"
    assert got[1].r == "VERY LOW confidence; Generic classification"
    assert got[2].r == "Low confidence; LIKELY tool, not invoice"


def test_missing_confidence_is_never_low(spark):
    rows = spark.createDataFrame([(1, "medical", None), (2, "medical", 0.1)], "file_id int, document_type string, confidence double")
    assert [r.file_id for r in registry.review_candidates(rows).collect()] == [2]


def test_patterns_are_searched_only_where_their_words_occur(spark):
    """every pattern was searched in every text."""
    assert rules.needed_words(r"(?:service|repair).*(?:manual|guide)") == [{"service", "repair"}, {"manual", "guide"}]
    assert rules.needed_words(r"vehicle\s+diagnostic\s+report") == [{"vehicle"}, {"diagnostic"}, {"report"}]
    assert rules.needed_words(r"parts?\s+x") == [{"part"}] and rules.needed_words(r"(?:ac|oil).*\d{4}") == []
    assert rules.needed_words(r"(?:abc)?def|ghi") == [{"def", "ghi"}]
    rng = random.Random(3)
    words = sorted({w for r in tables.COMPREHENSIVE_RULES for p in (*r.patterns, *r.exclude) for s in rules.needed_words(rules.lower_pattern(p)) for w in s})
    texts = [" ".join(rng.choices([*words, "12345678", "2024-01-02", "e46", "-", "_", ".json", "x"], k=4)) for _ in range(3000)]
    for r in tables.COMPREHENSIVE_RULES:
        for p in map(rules.lower_pattern, (*r.patterns, *r.exclude)):
            needs = rules.needed_words(p)
            assert all(all(any(w in t for w in s) for s in needs) for t in texts if re.search(p, t))
    assert rules.needed_words(r"transmission") and "contains" in rules.with_name_rule(
        spark.createDataFrame([("a",)], "name string"), F.col("name"), tables.COMPREHENSIVE_RULES)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_an_accented_letter_ends_a_word(spark):
    """As in the SQL: 17 plain characters between accented letters are a word of their own."""
    rows = spark.createDataFrame([("\u00e91hgcm82633a004352\u00e9",)], "name string")
    assert rules.with_name_rule(rows, F.col("name"), tables.COMPREHENSIVE_RULES).first().document_type == "automotive_service"
