"""Planning properties."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfmark.operators import compare, organise, planning, quality, storage, sync, transitions
from shelfmark.plans.fixtures import REGISTRY_CLOCK, Tables

SMALL = "/root/testdata/sf0.001"


def test_resolved_names_are_unique_and_free(spark):
    actions = spark.createDataFrame(
        [(f"a{i}", t) for i, t in enumerate(["/t/x.pdf"] * 4 + ["/t/x_1.pdf", "/t/y.pdf", "/t/y.pdf"])], "action_id string, target_path string")
    on_disk = spark.createDataFrame([("/t/y.pdf",), ("/t/y_1.pdf",)], "path string")
    for floor in (1, 100_000):
        got = [r.resolved_path for r in planning.resolve_names(actions, on_disk, floor=floor).collect()]
        assert len(set(got)) == len(actions.collect()) == len(got)
        assert not set(got) & {"/t/y.pdf", "/t/y_1.pdf"}
        assert "/t/x.pdf" in got and "/t/x_2.pdf" in got and "/t/x_1.pdf" in got


def test_replanning_an_executed_plan_changes_nothing(spark):
    docs = Tables(spark, SMALL).registry
    planned = organise.canonical_plan(docs, as_of=REGISTRY_CLOCK)
    executed = planned.withColumn("canonical_path", F.col("target_path")).drop("target_path", "domain", "changes")
    assert organise.replan(executed, as_of=REGISTRY_CLOCK).count() == 0


def test_function_plan_skips_files_in_place_and_reports_unknown_types(spark):
    docs = spark.createDataFrame(
        [("a.pdf", "medical", "/Organized/Medical/Records/a.pdf"), ("b.pdf", "medical", "\\x\\b.pdf"), ("c.pdf", "odd", "/c.pdf")],
        "file_name string, document_type string, file_path string")
    moves, unknown = organise.function_plan(docs)
    assert [r.file_name for r in moves.collect()] == ["b.pdf"] and [r.file_name for r in unknown.collect()] == ["c.pdf"]


def test_target_path_from_template(spark):
    row = spark.createDataFrame([("f", "/in/a.pdf", "a.pdf", ".pdf", "documents", dt.datetime(2024, 3, 5))],
                                "file_id string, path string, name string, extension string, file_category string, modified_at timestamp")
    target = planning.category_targets("/r", {"documents": "Active/Documents/{YYYY}/{MM}"})
    assert row.select(target.alias("t")).collect()[0].t == "/r/Active/Documents/2024/03/a.pdf"
    broken = planning.category_targets("/r", {"documents": "Active/{nobody_knows}"})
    assert row.select(broken.alias("t")).collect()[0].t == "/r/Active/documents/a.pdf"


def test_conflict_policies(spark):
    actions = spark.createDataFrame(
        [("a", "/t/x", 1, dt.datetime(2024, 1, 1), None), ("b", "/t/x", 9, dt.datetime(2023, 1, 1), None)],
        "action_id string, target_path string, file_size long, modified_at timestamp, conflict_type string")
    def kept(policy):
        return sorted(r.action_id for r in planning.apply_conflict_policy(actions, policy).collect())

    assert kept("newest") == ["a"] and kept("largest") == ["b"] and kept("skip") == ["a"] and kept("replace") == ["b"]
    assert kept("rename") == ["a", "b"] and kept("ask") == ["a", "b"]


def test_plan_states(spark):
    events = spark.createDataFrame(
        [("p", 1, "draft"), ("p", 2, "staged"), ("p", 3, "validated"), ("q", 1, "draft"), ("q", 2, "committed")],
        "plan_id string, seq int, status string")
    got = {r.plan_id: (r.status, r.is_valid) for r in planning.plan_status(events).collect()}
    assert got == {"p": ("validated", True), "q": ("committed", False)}
    plans = spark.createDataFrame([("p", True, None), ("q", False, None)], "plan_id string, approved boolean, executed_at timestamp")
    assert [r.plan_id for r in planning.executable_plans(plans).collect()] == ["p"]


def test_staging_validation_fails_on_missing_sources_and_space(spark):
    actions = spark.createDataFrame([("/a", "/t/a", None, None), ("/gone", "/t/b", "existing_file", None)],
                                    "source_path string, target_path string, conflict_type string, resolution_strategy string")
    inventory = spark.createDataFrame([("/a", 100)], "path string, size_bytes long")
    row = planning.validate_staging(actions, inventory, capacity_bytes=105).collect()[0]
    assert (row.unreadable_sources, row.required_bytes, row.unresolved_conflicts, row.space_ok, row.passed) == (1, 100, 1, False, False)
    fine = planning.validate_staging(actions.where("source_path = '/a'"), inventory, 1000).collect()[0]
    assert fine.passed


def test_histograms_keep_every_row(spark):
    t = Tables(spark, SMALL)
    assert storage.size_histogram(t.files).agg(F.sum("count")).collect()[0][0] == t.files.count()
    assert storage.size_histogram(t.files).count() == 6


def test_folders_do_not_absorb_siblings_with_a_common_prefix(spark):
    files = spark.createDataFrame([("1", "/a/b/x.txt", 1), ("2", "/a/bc/y.txt", 2)], "file_id string, path string, size_bytes long")
    assert {r.path: r.total_size for r in storage.folders(files).collect()} == {"/a": 3, "/a/b": 1, "/a/bc": 2}


def test_empty_inputs(spark):
    t = Tables(spark, SMALL)
    none = t.registry.where("file_id < 0")
    assert quality.stability(none).collect()[0].stability == 1.0
    assert storage.proposal(t.catalog.where("doc_id < 0")).count() == 0
    assert compare.compare_roots(t.roots.where("size_bytes < 0"), "F", "O").collect()[0].sync_score == 100.0
    assert quality.retrain_trigger(
        spark.createDataFrame([], "document_id long, was_correct boolean, feedback_timestamp timestamp, processed boolean"), REGISTRY_CLOCK
    ).collect()[0].should_retrain is False


def test_reconcile_covers_both_sides(spark):
    disk = spark.createDataFrame([("n", "/new"), ("m", "/moved"), ("h", "/home"), ("h", "/also")], "content_hash string, path string")
    known = spark.createDataFrame([("1", "m", "/old"), ("2", "h", "/home"), ("3", "g", "/gone")], "file_id string, content_hash string, canonical_path string")
    got = {r.content_hash: r.status for r in compare.reconcile(disk, known).collect()}
    assert got == {"n": "new", "m": "moved", "h": "in_place", "g": "missing"}
    fixed = transitions.mark_missing_and_moved(known, compare.reconcile(disk, known))
    assert {r.file_id: (r.is_missing, r.canonical_path) for r in fixed.collect()} == {
        "1": (False, "/moved"), "2": (False, "/home"), "3": (True, "/gone")}


def test_conflict_callback_and_dry_run(spark):
    now, later = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    changes = spark.createDataFrame([(1, "/a.txt", "modified", now, 5), (2, "/b.txt", "deleted", now, 5)],
                                    "event_id int, path string, change_type string, modified_at timestamp, size long")
    local = spark.createDataFrame([("/a.txt", later), ("/b.txt", later)], "path string, local_modified timestamp")
    def actions(**options):
        return {r.path: r.action for r in sync.sync_decisions(changes, local, **options).collect()}

    assert actions(policy=lambda remote, mine: F.lit("keep_both"), delete_orphans=True) == {"/a.txt": "keep_both", "/b.txt": "delete"}
    assert actions(dry_run=True) == {"/a.txt": "skip_dry_run", "/b.txt": "skip_dry_run"}
    assert actions(policy="remote_wins") == {"/a.txt": "download", "/b.txt": "ignore"}


def test_correction_matches_either_path_once(spark):
    registry = spark.createDataFrame(
        [("1", "/p", "/p", "unknown", 0.1, "pattern", True)],
        "file_id string, original_path string, canonical_path string, document_type string, confidence double, classification_method string, requires_review boolean")
    wanted = spark.createDataFrame([("/p", "medical")], "path string, correct_type string")
    nxt, log = transitions.correct_types(registry, wanted, REGISTRY_CLOCK)
    assert nxt.collect()[0].document_type == "medical" and log.count() == 1


def test_taken_numbers_stay_rows(spark, monkeypatch):
    """Hot names with many taken numbers: ranked in ranges, met in buckets of claimants, never one array a name."""
    monkeypatch.setattr(planning, "NUMBERS_A_RANGE", 5)
    monkeypatch.setattr(planning, "TURNS_A_BUCKET", 4)
    rng = random.Random(3)
    claims = {"/a/x.pdf": 40, "/a/y.pdf": 30, "/a/z": 25, "/a/w.txt": 1, "/a/v.txt": 3}
    disk = {f"/a/x_{n}.pdf" for n in rng.sample(range(1, 90), 45)} | {f"/a/y_{n}.pdf" for n in range(1, 21)} | {"/a/x.pdf", "/a/z", "/a/w.txt"}
    disk |= {f"/a/z_{n}" for n in (1, 2, 3, 11, 12, 30, 999999999)} | {"/a/nobody_7.pdf"}
    rows = [(f"{name}#{i}", name) for name, n in claims.items() for i in range(n)]
    actions = spark.createDataFrame([*rows, ("null", None)], "action_id string, target_path string")
    inventory = spark.createDataFrame([(x,) for x in sorted(disk)] * 2, "path string")
    for on_disk in (inventory, None):
        out = planning.resolve_names(actions, on_disk)
        assert "collect_set" not in out._jdf.queryExecution().toString()
        got = out.collect()
        taken = disk if on_disk is not None else set()
        for name, n in claims.items():
            stem, dot, ext = name.partition(".")
            free = [x for x in [name, *(f"{stem}_{k}{dot}{ext}" for k in range(1, 200))] if x not in taken]
            assert sorted(r.resolved_path for r in got if r.target_path == name) == sorted(free[:n])
        assert len(got) == len(rows) + 1
