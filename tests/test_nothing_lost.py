"""Rows that earlier slipped away: remote paths, old files, late changes, large sizes, repeated keys, long addresses."""

import os
import subprocess
import sys
import time

from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import compare, transitions
from shelfmark.schemas import CHANGES
from shelfmark.sources import files
from shelfmark.streaming import changes, inbox


def test_paths_no_executor_can_open_keep_their_rows_with_a_reason(spark):
    rows = spark.createDataFrame(
        [("hdfs://nowhere:1/a.txt", 2000, ".txt"), ("hdfs://nowhere:1/b.txt", 2000, ".txt"), ("/no/such", 2000, ".txt")], "path string, size_bytes long, extension string"
    )
    got = files.progressive_hashes(rows).collect()
    assert len(got) == 3 and all(r.hash_quick is None and r.hash_full is None and r.hash_error for r in got)


def test_null_extensions_form_a_block(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(b"x" * 1500)
    rows = spark.createDataFrame([(str(tmp_path / n), 1500, None) for n in "ab"], "path string, size_bytes long, extension string")
    assert files.progressive_hashes(rows).select("hash_full").distinct().count() == 1


def test_large_files_are_listed_and_hashed(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(b"z" * 5000)
    (tmp_path / "small.bin").write_bytes(b"z" * 10)
    got = {os.path.basename(r.path): r.content for r in files.read_contents(spark, str(tmp_path), max_length=1000).collect()}
    assert got["big.bin"] is None and bytes(got["small.bin"]) == b"z" * 10
    assert files.drop_rows(spark, str(tmp_path)).where("content_hash is not null and hash_error is null").count() == 2
    assert files.scan(spark, str(tmp_path)).count() == 2


def test_a_file_with_an_old_modification_time_is_seen(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    seen = []
    stream = inbox.watch(spark, str(box))
    for name, age in (("new.txt", 0), ("old.txt", 3 * 86400)):
        path = box / name
        path.write_text(name)
        os.utime(path, (time.time() - age, time.time() - age))
        changes.run_to_end(stream, str(tmp_path / "cp"), lambda b, i: seen.extend(os.path.basename(r.original_path) for r in b.collect()))
    assert sorted(seen) == ["new.txt", "old.txt"]


def test_a_change_that_comes_days_late_is_kept_and_its_repeat_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    seen = []
    schema = spark.createDataFrame([], CHANGES).schema
    names = schema.names

    def put(event, day):
        row = {n: None for n in names} | {"event_id": event, "path": f"/p{event}", "change_type": "modified"}
        df = spark.createDataFrame([tuple(row[n] for n in names)], schema).withColumn("modified_at", F.lit(f"2024-01-{day:02d}").cast("timestamp"))
        df.select(*names).coalesce(1).write.mode("append").parquet(folder)
        stream = changes.distinct_changes(changes.change_stream(spark, folder))
        changes.run_to_end(stream, str(tmp_path / "cp"), lambda b, i: seen.extend(r.event_id for r in b.collect()))

    ids = (1, 2) if schema["event_id"].dataType.simpleString() != "string" else ("1", "2")
    put(ids[0], 20)
    put(ids[1], 2)
    put(ids[1], 2)
    assert seen == list(ids)


def test_an_address_of_a_million_characters(spark):
    long = "http://" + "a" * 1_000_000
    rows = spark.createDataFrame([(long,), ("https://x.org",), ("http://%zz",), ("http:// x",)], "t string")
    assert [r.v for r in rows.select(F.col("t").rlike(tx.URL).alias("v")).collect()] == [True, True, True, False]


def test_one_row_a_key(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1), (None, "d", 1)], "k int, v string, at int")
    none = spark.createDataFrame([], "k int, v string, at int")
    assert sorted(r.v for r in transitions.upsert(none, rows, "k", ["at"]).collect()) == ["b", "c", "d"]
    assert sorted(r.v for r in transitions.insert_absent(none, rows, "k", ["at"]).collect()) == ["a", "c", "d"]


def test_every_registry_row_of_a_content_gets_a_status(spark):
    disk = spark.createDataFrame([("h", "/a"), ("h", "/c"), ("n", "/n")], "content_hash string, path string")
    known = spark.createDataFrame([("1", "h", "/a"), ("2", "h", "/b"), ("3", "g", "/g")], "file_id string, content_hash string, canonical_path string")
    got = {r.file_id: (r.status, r.disk_path) for r in compare.reconcile(disk, known).collect()}
    assert got == {"1": ("in_place", "/a"), "2": ("moved", "/c"), "3": ("missing", None), None: ("new", "/n")}


def test_python_functions_reach_executors_without_the_package(tmp_path):
    """The package is on the driver's path only; workers get it from the session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "f.txt").write_bytes(b"x" * 2000)
    code = f"""
import sys; sys.path.insert(0, {root!r})
from shelfmark.session import build_session
from shelfmark.sources import files
spark = build_session("t", "local[2]", 2, **{{"spark.ui.enabled": "false"}})
assert files.hash_by_path(files.scan(spark, {str(tmp_path)!r}), "h").where("h is not null").count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, capture_output=True)
