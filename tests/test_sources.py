"""Tree scans, hashes, text extraction, CSV and JSON."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import dedup, registry, transitions
from shelfmark.sources import files, tabular


def write(base, relative, data):
    path = os.path.join(base, relative)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(data)
    return path


def tree(tmp_path):
    base = str(tmp_path / "tree")
    write(base, "docs/readme.txt", b"hello")
    write(base, "docs/work/report.pdf", b"pdf data")
    write(base, "images/photo.JPG", b"img")
    write(base, "code/script.py", b"print(1)")
    write(base, "node_modules/x/lib.js", b"skip")
    write(base, "docs/~$draft.docx", b"skip")
    write(base, "docs/a.TMP", b"skip")
    return base


def test_scan_lists_files_without_excluded_ones(spark, tmp_path):
    base = tree(tmp_path)
    got = {r.path[len(base):]: (r.extension, r.size_bytes) for r in files.scan(spark, base).collect()}
    assert got == {"/docs/readme.txt": (".txt", 5), "/docs/work/report.pdf": (".pdf", 8), "/images/photo.JPG": (".jpg", 3),
                   "/code/script.py": (".py", 8)}


def test_scan_reads_no_content_and_respects_size(spark, tmp_path):
    base = tree(tmp_path)
    df = files.scan(spark, base, max_size=5)
    assert df.count() == 2
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_scan_with_priority_and_listing(spark, tmp_path):
    base = tree(tmp_path)
    both = files.scan_with_priority(spark, [(base + "/docs", "docs", 9), (base + "/code", "code", 1)])
    assert {(r.source, r.priority) for r in both.collect()} == {("docs", 9), ("code", 1)}
    assert [r.name for r in files.listing(files.scan(spark, base), base + "/docs").collect()] == ["readme.txt"]


def test_progressive_hashes_open_only_candidates(spark, tmp_path):
    base = str(tmp_path / "big")
    head = os.urandom(1 << 20)
    write(base, "a.bin", head + b"one")
    write(base, "b.bin", head + b"one")
    write(base, "c.bin", head + b"two")
    write(base, "d.bin", b"unique size" * 200)
    write(base, "e.txt", b"x" * 2000)
    write(base, "f.txt", b"x" * 2000)
    catalog = files.scan(spark, base)
    got = {os.path.basename(r.path): r.hash_full for r in files.progressive_hashes(catalog).collect()}
    assert set(got) == {"a.bin", "b.bin", "c.bin", "e.txt", "f.txt"}
    assert got["a.bin"] == got["b.bin"] == hashlib.sha256(head + b"one").hexdigest() != got["c.bin"]
    hashed = files.progressive_hashes(catalog).withColumn("access_count", F.lit(0))
    assert dedup.exact_groups(hashed).count() == 2


def test_unreadable_files_get_null(spark):
    rows = spark.createDataFrame([("/no/such/file",)], "path string")
    assert files.hash_by_path(rows, "h").collect()[0].h is None


def test_text_extraction_encodings(spark, tmp_path):
    base = str(tmp_path / "text")
    write(base, "u8.txt", "héllo wörld\nline two".encode())
    write(base, "u16.txt", "héllo".encode("utf-16"))
    write(base, "latin.txt", "caf\xe9".encode("latin-1"))
    got = {os.path.basename(r.path): r for r in files.extract_text(files.read_contents(spark, base), max_chars=5).collect()}
    assert got["u8.txt"].content == "héllo" and got["u8.txt"].char_count == 20 and got["u8.txt"].line_count == 2
    assert got["u8.txt"].word_count == 4
    assert got["u16.txt"].content == "héllo" and got["latin.txt"].content == "café"


def test_drop_registration(spark, tmp_path):
    base = str(tmp_path / "drop")
    write(base, "a.txt", b"same")
    write(base, "b.txt", b"same")
    write(base, "c.txt", b"other")
    write(base, ".hidden", b"no")
    known = spark.createDataFrame([("k1", hashlib.sha256(b"other").hexdigest())], "file_id string, content_hash string")
    got = {os.path.basename(r.original_path): r for r in transitions.register_batch(files.drop_rows(spark, base), known).collect()}
    assert set(got) == {"a.txt", "b.txt", "c.txt"}
    assert got["a.txt"].canonical_state == "pending" and got["b.txt"].duplicate_of == got["a.txt"].file_id
    assert got["c.txt"].duplicate_of == "k1"


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.pdf", "unknown", None, "", "r")],
                                 "file_id int, file_name string, document_type string, confidence double, suggested_types string, reason string")
    tabular.write_review_csv(rows, str(tmp_path / "review"))
    back = spark.read.option("header", True).csv(str(tmp_path / "review"))
    assert tuple(back.columns) == tabular.REVIEW_COLUMNS and back.collect()[0].confidence == "0.00"
    (tmp_path / "answers.csv").write_text("file_id,correct_type\n1,medical\n2,  \n3,\n")
    assert tabular.read_corrections(spark, str(tmp_path / "answers.csv")).count() == 1
    tabular.write_training_csv(rows, str(tmp_path / "training"))
    assert spark.read.option("header", True).csv(str(tmp_path / "training")).columns == ["file_name", "document_type", "confidence"]


def test_json_report_and_snapshots(spark, tmp_path):
    rows = spark.range(3)
    tabular.write_report({"ids": rows}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "ids")).count() == 3
    tabular.write_snapshot(rows, str(tmp_path / "table"), 1)
    try:
        tabular.write_snapshot(rows, str(tmp_path / "table"), 1)
        raise AssertionError("a version was overwritten")
    except Exception as error:
        assert "EXISTS" in str(error).upper()


def test_catalog_partitions_by_session(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1", "h"), ("b", "s2", "g")], "file_id string, scan_session_id string, hash_full string")
    tabular.write_catalog(rows, str(tmp_path / "cat"))
    back = spark.read.parquet(str(tmp_path / "cat"))
    pruned = back.where("scan_session_id = 's1'")
    assert pruned.count() == 1
    assert "PartitionFilters: [isnotnull(scan_session_id" in pruned._jdf.queryExecution().executedPlan().toString()


def test_configuration_files(tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"name": "r", "document_type": "t", "confidence": 1.0, "file_pattern": "x"}]}))
    assert tabular.read_rules(str(tmp_path / "rules.json"))[0].file == "x"
    (tmp_path / "cats.json").write_text(json.dumps({"categories": {"c": {"subcategories": {"s": {"extensions": [".q"]}}}}}))
    assert tabular.read_taxonomy(str(tmp_path / "cats.json")) == {("c", "s"): [".q"]}


def test_schema_conform_and_sessions(spark):
    rows = schemas.conform(spark.createDataFrame([("a", 5)], "file_id string, extra int"), schemas.FILES)
    assert rows.columns[-1] == "extra" and rows.schema["size_bytes"].dataType.typeName() == "long"
    import datetime as dt

    opened = schemas.open_session(spark, "s1", dt.datetime(2024, 1, 1), ["/a"], {"k": "v"})
    later = schemas.open_session(spark, "s2", dt.datetime(2024, 2, 1), ["/a"], {})
    assert [r.session_id for r in schemas.sessions_newest_first(opened.unionByName(later)).collect()] == ["s2", "s1"]
    assert registry.active(opened.selectExpr("session_id", "true active", "1 priority")).count() == 1


def test_a_tree_of_documents_has_one_file_a_row_and_few_folders(spark):
    from shelfmark.plans import file_queries
    from shelfmark.plans.fixtures import Tables

    docs = Tables(spark, "/root/testdata/sf0.001")
    folder = file_queries.tree(docs)
    found = [(base, name) for base, _, names in os.walk(folder) for name in names if name.endswith(".txt")]
    rows = docs.read("documents").count()
    assert len(found) == rows and len({base for base, _ in found}) <= spark.sparkContext.defaultParallelism < rows
