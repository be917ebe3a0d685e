"""Inbox stream, retrain watch, repeated batches."""

import os

import pytest
from pyspark.sql import functions as F

from shelfmark.schemas import REGISTRY
from shelfmark.streaming import changes, inbox


def put(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as handle:
        handle.write(data)


def test_inbox_registers_classifies_and_places(spark, tmp_path):
    box, base, out = str(tmp_path / "box"), str(tmp_path / "registry"), str(tmp_path / "out")
    spark.createDataFrame([], REGISTRY).write.parquet(base)
    put(box, "invoice_1.pdf", b"first")
    put(box, "copy_of_invoice.pdf", b"first")
    put(box, ".hidden", b"no")
    put(box, "~lock.docx", b"no")
    run = inbox.batch_processor(base, out, as_of="2024-01-31")
    changes.run_to_end(inbox.watch(spark, box), str(tmp_path / "cp"), run)
    first = {os.path.basename(r.original_path): r for r in spark.read.parquet(out).collect()}
    assert set(first) == {"invoice_1.pdf", "copy_of_invoice.pdf"}
    assert sorted(r.canonical_state for r in first.values()) == ["classified", "duplicate"]
    kept = next(r for r in first.values() if r.canonical_state == "classified")
    assert kept.document_type == "financial_invoice" and kept.target_path.startswith("/Canonical/Financial/")
    # a later batch knows what the first one registered
    put(box, "again.pdf", b"first")
    changes.run_to_end(inbox.watch(spark, box), str(tmp_path / "cp"), run)
    again = [r for r in spark.read.parquet(out).collect() if r.original_path.endswith("again.pdf")]
    assert [r.canonical_state for r in again] == ["duplicate"] and again[0].duplicate_of == kept.file_id


def test_repeating_a_batch_gives_the_same_rows(spark, tmp_path):
    base, out = str(tmp_path / "registry"), str(tmp_path / "out")
    spark.createDataFrame([], REGISTRY).write.parquet(base)
    batch = spark.createDataFrame([("/in/a.pdf", "h", 1)], "original_path string, content_hash string, file_size long")
    run = inbox.batch_processor(base, out, as_of="2024-01-31")
    run(batch, 0)
    once = spark.read.parquet(out).collect()
    run(batch, 0)
    assert spark.read.parquet(out).collect() == once and once[0].canonical_state == "classified"


def test_retrain_watch(spark, tmp_path):
    store, out = str(tmp_path / "feedback"), str(tmp_path / "trigger")
    spark.range(120).select(F.col("id").alias("document_id"), F.lit(False).alias("was_correct"),
                            F.lit("2024-01-01").cast("timestamp").alias("feedback_timestamp"), F.lit(False).alias("processed")).write.parquet(store)
    inbox.retrain_watch(store, out, "2024-01-31")(spark.range(1), 0)
    row = spark.read.json(out).collect()[0]
    assert row.should_retrain and "High incorrect count: 120" in row.reasons


def test_work_folders_follow_the_cluster_setting(spark):
    from types import SimpleNamespace

    from shelfmark.session import shared_folder

    assert shared_folder(spark, "x").startswith("/tmp/")

    def session(setting, master):
        conf = SimpleNamespace(get=lambda key, default: setting if key == "spark.checkpoint.dir" and setting else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    cluster = session("hdfs://shared/cp", "yarn")
    first, second = shared_folder(cluster, "x"), shared_folder(cluster, "x")
    assert first.startswith("hdfs://shared/cp/") and first != second
    with pytest.raises(ValueError):
        shared_folder(session("", "yarn"), "x")


def test_trailing_limits_as_the_batch_form(spark, tmp_path):
    """Files out of order, a restart between them, and an event behind the watermark."""
    import random

    from shelfmark.streaming import limits, windows

    rng = random.Random(12)
    start = 1_704_067_200_000_000
    rows = [(i, f"u{rng.choice([1, 1, 1, 2, 3])}", start + rng.randrange(0, 4 * 3600) * 1_000_000 + rng.randrange(3)) for i in range(900)]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 500) * 1_000_000)  # within the lateness of ten minutes
    rows += [(900 + k, "u1", rows[-1][2]) for k in range(5)]  # at one instant
    late = (1000, "u1", start)
    box, schema = str(tmp_path / "events"), "event_id long, user_id string, at long"
    frame = lambda part: spark.createDataFrame(part, schema).selectExpr("event_id", "user_id", "timestamp_micros(at) ts")

    def run():
        stream = spark.readStream.schema("event_id long, user_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(box)
        limited = limits.rate_limited_stream(stream, per_minute=3, per_hour=60)
        with limits.state_on_disk(spark):
            changes.run_to_end(limited, str(tmp_path / "cp"), changes.snapshot_writer(str(tmp_path / "out")))

    for k in range(6):
        part = rows[k * 151 : (k + 1) * 151] + ([late] if k == 5 else [])
        frame(part).coalesce(1).write.mode("append").parquet(box)
        if k in (2, 5):
            run()
    newest = max(r[2] for r in rows)
    settled = frame(rows).where(F.unix_micros("ts") < (newest // 1000 - 600_000) * 1000)
    want = windows.rate_limited(settled, per_minute=3, per_hour=60)
    columns = ["user_id", "event_id", "last_minute", "last_hour", "retry_after"]
    got = spark.read.parquet(str(tmp_path / "out") + "/*").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert want.count() > 100


def test_change_state_is_compacted_while_it_is_read(spark, tmp_path):
    from shelfmark.operators import sync
    from shelfmark.schemas import CHANGES
    from shelfmark.streaming.state_table import ChangeStateTable

    table = ChangeStateTable(spark, str(tmp_path / "state"), fan=3, retain=2)
    rows, batches, held = [], [], {}
    for b in range(10):
        kind = ["created", "modified", "deleted", "renamed"][b % 4]
        part = [(b * 10 + k, f"/p{(b + k) % 7}", kind, None, b * 10 + k, f"/p{k}" if kind == "renamed" else None, None, None) for k in range(6)]
        batch = spark.createDataFrame(part, CHANGES).withColumn("modified_at", F.timestamp_micros(F.col("event_id") * 7 % 50))
        batches.append(batch)
        rows += part
        table.append(batch, b)
        if b == 6:
            held = {g: table.read(g) for g in table.generations()}  # readers of now
            before = {g: sorted(map(tuple, df.collect())) for g, df in held.items()}
        if b == 7:  # the newest generation of then still has its segments
            assert sorted(map(tuple, held[6].collect())) == before[6]
        levels = [level for _, level in table.manifest()["segments"]]
        assert max(levels.count(x) for x in levels) < 3
        assert len(table._names("segments")) <= 3 * 6 and len(table.generations()) <= 3
    whole = batches[0]
    for batch in batches[1:]:
        whole = whole.unionByName(batch)
    want = sorted(map(tuple, sync.latest_state(whole).collect()))
    assert sorted(map(tuple, table.read().collect())) == want
    table.append(batches[-1], 9)  # the stream starts again and repeats its last batch
    assert sorted(map(tuple, table.read().collect())) == want
    assert sorted(map(tuple, ChangeStateTable(spark, str(tmp_path / "state")).read().collect())) == want
    assert ChangeStateTable(spark, str(tmp_path / "none")).read().count() == 0


def test_a_failed_batch_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    from shelfmark.schemas import CHANGES
    from shelfmark.streaming.state_table import ChangeStateTable

    table = ChangeStateTable(spark, str(tmp_path / "state"))
    batch = lambda k: spark.createDataFrame([(k, f"/p{k}", "created", None, 1, None, None, None)], CHANGES)
    table.append(batch(0), 0)
    write = table._write

    def broken(*args):
        write(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(table, "_write", broken)
    with pytest.raises(RuntimeError):
        table.append(batch(1), 1)
    monkeypatch.undo()
    assert [r.path for r in table.read().collect()] == ["/p0"]
    table.append(batch(1), 1)
    assert sorted(r.path for r in table.read().collect()) == ["/p0", "/p1"]


def test_registered_rows_are_placed_in_one_pass(spark):
    """classifying and placing a batch took a join with itself, in each branch of the registration."""
    rows = [("a", "/in/invoice_1.pdf", "h1", 1, "pending", False, None), ("b", "/in/b.pdf", "h1", 1, "duplicate", True, "a"), ("c", "/in/c.pdf", None, 1, "error", False, None)]
    registered = spark.createDataFrame(rows, "file_id string, original_path string, content_hash string, file_size long, canonical_state string, is_duplicate boolean, duplicate_of string")
    placed = inbox.place(registered, as_of="2024-01-31")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    got = {r.file_id: r for r in placed.collect()}
    assert {k: r.canonical_state for k, r in got.items()} == {"a": "classified", "b": "duplicate", "c": "error"}
    assert got["a"].document_type and got["a"].target_path and got["a"].requires_review is not None
    assert all(got[k][c] is None for k in "bc" for c in ("document_type", "confidence", "classification_method", "requires_review", "target_path"))


def test_listing_setting_is_put_back(spark):
    before = spark.conf.get(inbox.LISTING, None)
    with inbox.few_listing_tasks(spark):
        assert spark.conf.get(inbox.LISTING) == str(inbox.LISTING_TASKS)
    assert spark.conf.get(inbox.LISTING, None) == before
