"""Paths, names, globs, templates, hashes, text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import globs, hashing, names, paths, templates
from shelfmark.functions import text as tx

C = F.col


@pytest.mark.parametrize(
    "path,name,ext,stem,parent",
    [
        ("/a/b/c.tar.gz", "c.tar.gz", ".gz", "c.tar", "/a/b"),
        ("/a/.env", ".env", "", ".env", "/a"),
        ("C:\\Docs\\Old\\File.PDF", "File.PDF", ".pdf", "File", "C:/Docs/Old"),
        ("plain", "plain", "", "plain", ""),
        ("/x/a.", "a.", "", "a.", "/x"),
    ],
)
def test_path_parts(value, path, name, ext, stem, parent):
    got = value(F.array(paths.name(C("p")), paths.extension(C("p")), paths.stem(C("p")), paths.parent(C("p"))), p=path)
    assert got == [name, ext, stem, parent]


def test_ancestors_and_depth(value):
    assert value(paths.ancestors(C("p")), p="/a/b/c") == ["/a", "/a/b", "/a/b/c"]
    assert value(paths.ancestors(C("p")), p="") == []
    assert value(paths.folder_depth(C("p")), p="/a/b") == 3
    assert value(paths.top_level(C("p")), p="C:/Users/me") == "Users"
    assert value(paths.bare_extension(C("p")), p="/a/x.PDF") == "pdf"


def test_project_skips_trailing_marker(value):
    assert value(paths.project(C("p")), p="/home/Projects/My App/x.py") == "My_App"
    assert value(paths.project(C("p")), p="/home/work") is None


@pytest.mark.parametrize(
    "name,expected",
    [
        ("Test_File.pdf", "test_file.pdf"),
        ("report (1).pdf", "report.pdf"),
        ("report - Copy.pdf", "report.pdf"),
        ("plan_v2_final.docx", "plan.docx"),
        ("scan 2024-01-05.pdf", "scan.pdf"),
        ("quarterly_report_2024_backup.pdf", "quarterly_report_2024.pdf"),
    ],
)
def test_normalize(value, name, expected):
    assert value(names.normalize(C("n")), n=name) == expected


def test_sanitize_and_version(value):
    assert value(names.sanitize(C("n")), n="file<name>.txt ") == "filename.txt"
    assert value(names.version(C("n")), n="doc_v7.txt") == "v07"
    assert value(names.version(C("n")), n="doc_v0123.txt") == "v123"
    assert value(names.version(C("n")), n="doc.txt") is None


def test_conventional_name(value):
    made = names.conventional_name(F.lit("2024-01-02"), C("p"), F.lit("docs"), F.lit("v01"), F.lit("pdf"))
    assert value(made, p="My App") == "2024-01-02_My_App_docs_v01.pdf"
    assert value(made, p="") == "2024-01-02_docs_v01.pdf"


def test_real_name(value):
    assert value(names.real_name(C("p")), p="/x/2025-11-28_{vehicle}_{service}_Front_axle.pdf") == "Front_axle.pdf"
    assert value(names.real_name(C("p")), p="D:\\x\\plain.pdf") == "plain.pdf"


@pytest.mark.parametrize(
    "name,expected",
    [
        ("a 2024_03_01 b", "2024-03-01"),
        ("a 03-01-2024 b", "2024-03-01"),
        ("a March 5, 2024 b", "2024-03-05"),
        ("a 20240305 b", "2024-03-05"),
        ("nothing", None),
    ],
)
def test_date_in_name(value, name, expected):
    assert value(names.date_in_name(C("n")), n=name) == expected


def test_enhanced_name(spark):
    rows = spark.createDataFrame(
        [("Acme-Invoice INV2231 20240105.pdf", "financial_invoice"), ("2024-01-05_ready.pdf", "financial_invoice"),
         ("notes.txt", "personal_career"), ("Cv v3.docx", "personal_career"), ("BMW M3 parts.pdf", "automotive_service")],
        ["file_name", "document_type"])
    got = {r.file_name: r.new_name for r in names.with_enhanced_name(rows).collect()}
    assert got["2024-01-05_ready.pdf"] is None and got["notes.txt"] is None
    assert got["Acme-Invoice INV2231 20240105.pdf"].startswith("2024_01_05_Acme")
    assert got["Cv v3.docx"] == "v3_Cv.docx"
    assert got["BMW M3 parts.pdf"] == "BMW_M3_parts.pdf"


def test_safe_file_name_cuts_before_extension(value):
    assert value(names.safe_file_name(C("n"), 10), n="abcdefghijkl.pdf") == "abcdef.pdf"
    assert value(names.safe_file_name(C("n")), n='a/b:"c".pdf') == "a_b_c_.pdf"


def test_search_terms(value):
    assert value(names.search_terms(C("n")), n="BMW M3 diagnostic.pdf") == "BMW M3 vehicle diagnostic report"
    assert value(names.search_terms(C("n")), n="scan_The quick brown fox jumps over.pdf") == "The quick brown fox jumps"
    assert value(names.search_terms(C("n")), n="patient id 1.pdf") is None


@pytest.mark.parametrize(
    "pattern,text,hit",
    [("*.tmp", "a.tmp", True), ("~$*", "~$doc.docx", True), ("a?c", "abc", True), ("a?c", "abbc", False),
     ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("**/cache/**", "x/y/cache/z", True), ("**/cache/**", "cache/z", True)],
)
def test_globs(value, pattern, text, hit):
    assert value(globs.matches_any(C("t"), [pattern], False), t=text) is hit


def test_template_dialects(value):
    assert templates.pieces("a/{x}/{YYYY-MM}.b") == [("text", "a/"), ("key", "x"), ("text", "/"), ("key", "YYYY-MM"), ("text", ".b")]
    keep = templates.render("{a}_{b}", {"a": C("a")})
    assert value(keep, a="1") == "1_{b}"
    assert value(templates.render_or("{a}/{zzz}", {"a": C("a")}, F.lit("else")), a="1") == "else"
    assert value(templates.render_with_words("{vendor}__{odd}_{a}", {"a": C("a")}), a="x:y") == "VENDOR_UNKNOWN_x_y"


def test_quick_and_full_hash(spark):
    big = b"x" * (1 << 20) + b"tail"
    row = spark.createDataFrame([(bytearray(big),)], "content binary")
    got = row.select(hashing.quick_hash(C("content")).alias("q"), hashing.full_hash(C("content")).alias("f"),
                     hashing.adaptive_hashes(C("content"), F.length("content")).alias("a")).collect()[0]
    assert got.q == hashlib.sha256(big[: 1 << 20]).hexdigest()
    assert got.f == hashlib.sha256(big).hexdigest()
    assert got.a.hash_quick == got.q and got.a.hash_full is None


def test_text_helpers(value):
    text = "Invoice #A-17 due 2024-01-05. Pay $1,200.50 now! Contact me@x.org"
    stats = value(tx.statistics(C("t")), t=text)
    assert stats.sentence_count == 2 and stats.char_count == len(text)
    meta = value(tx.metadata_by_type(C("t"), F.lit("financial_invoice")), t=text)
    assert meta == {"dates": ["2024-01-05"], "amounts": ["1,200.50"], "invoice_numbers": ["A-17"]}
    assert value(tx.summary(C("t")), t=text).startswith("Invoice #A-17 due 2024-01-05. | Key entities: 2024-01-05, $1,200.50")
    assert value(tx.html_to_text(C("t")), t="<p>a &amp; b</p><script>x()</script><br>c") == "a & b\nc"
    assert value(tx.is_sensitive(C("t")), t="ssn 123-45-6789") is True
    assert value(tx.is_blank(C("t")), t="  short ") is True
