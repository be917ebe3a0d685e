"""Exact groups, keeper choice, flags, fuzzy names."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import dedup, flags, fuzzy

FILE = ("file_id string, path string, name string, extension string, size_bytes long, hash_quick string, hash_full string, "
        "modified_at timestamp, access_count long")
OLD, NEW = dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 1)


def make(spark, *rows):
    """Rows of (id, path, size, hash, modified, accesses)."""
    return spark.createDataFrame(
        [(i, p, p.split("/")[-1], "." + p.split(".")[-1], s, h, h, m, a) for i, p, s, h, m, a in rows], FILE)


def keeper(files, **options):
    return [r.canonical_file for r in dedup.exact_groups(files, min_size=1, **options).collect()]


def test_equal_size_extension_hash_is_one_group(spark):
    files = make(spark, *[(f"f{i}", f"/t/a{i}.txt", 1000, "h", NEW, 0) for i in range(3)])
    group = dedup.exact_groups(files, min_size=1).collect()
    assert len(group) == 1 and group[0].member_count == 3 and group[0].space_wasted == 2000


def test_size_difference_or_minimum_size_prevents_a_group(spark):
    files = make(spark, ("a", "/t/a.txt", 1000, "h", NEW, 0), ("b", "/t/b.txt", 2000, "h", NEW, 0))
    assert keeper(files) == []
    small = make(spark, ("a", "/t/a.txt", 50, "h", NEW, 0), ("b", "/t/b.txt", 50, "h", NEW, 0))
    assert dedup.exact_groups(small, min_size=100).count() == 0


@pytest.mark.parametrize(
    "rows,preferred,expected",
    [
        ([("old", "/test/old.txt", OLD, 0), ("new", "/test/new.txt", NEW, 0)], (), "new"),
        ([("backup", "/backup/file.txt", NEW, 0), ("canonical", "/Canonical/file.txt", NEW, 0)], ("/Canonical",), "canonical"),
        ([("z_deep", "/a/b/c/d/e/f/g/h/i/j/k/l/m/n/file.txt", OLD, 0), ("shallow", "/a/file.txt", OLD, 0)], (), "shallow"),
        ([("unused", "/test/unused.txt", NEW, 0), ("active", "/test/active.txt", NEW, 20)], (), "active"),
        ([("g", "/test/file (1).txt", OLD, 0), ("h", "/test/quarterly.txt", OLD, 9)], (), "h"),
    ],
)
def test_keeper_choice(spark, rows, preferred, expected):
    files = make(spark, *[(i, p, 500, "h", m, a) for i, p, m, a in rows])
    assert keeper(files, preferred_paths=preferred) == [expected]


def test_keeper_equals_scoring_every_member(spark):
    rng = random.Random(5)
    rows = [(f"f{i:03d}", "/" + "/".join("d" * rng.randint(1, 2) for _ in range(rng.randint(1, 12))) + f"/n{i}{rng.choice(['', ' copy'])}.txt",
             10, f"h{rng.randint(0, 20)}", dt.datetime(2024, 1, rng.randint(1, 4)), rng.randint(0, 20)) for i in range(200)]
    want = {}
    for h in {r[3] for r in rows}:
        group = sorted(r for r in rows if r[3] == h)
        if len(group) < 2:
            continue
        newest = min(group, key=lambda r: (-r[4].timestamp(), r[0]))[0]
        def score(r):
            return (10 * (r[0] == newest) + max(0, 10 - r[1].count("/")) + (0 if "copy" in r[1] else 5) + min(15, r[5]))
        want[h] = min(group, key=lambda r: (-score(r), r[0]))[0]
    got = {r.hash_full: r.canonical_file for r in dedup.exact_groups(make(spark, *rows), min_size=1).collect()}
    assert got == want


def test_flags_mark_keeper_and_copies(spark):
    files = make(spark, ("a", "/a.txt", 9000, "h", OLD, 0), ("b", "/b.txt", 9000, "h", NEW, 0), ("c", "/c.txt", 9000, "x", NEW, 0))
    flagged = dedup.with_duplicate_flags(files, dedup.exact_members(files, dedup.exact_groups(files)))
    got = {r.file_id: (r.is_duplicate, r.is_canonical) for r in flagged.collect()}
    assert got == {"a": (True, False), "b": (True, True), "c": (False, False)}


def test_stale_and_temp_flags(spark):
    files = make(spark, ("a", "/a.tmp", 1, "h", OLD, 0), ("b", "/b.BAK", 1, "h", OLD, 0), ("c", "/c.txt", 1, "h", OLD, 0)).withColumn(
        "accessed_at", F.col("modified_at"))
    got = {r.file_id: (r.is_temp, r.is_orphaned) for r in flags.with_stale_flag(flags.with_temp_flag(files), as_of="2024-02-01").collect()}
    assert got == {"a": (True, True), "b": (True, True), "c": (False, True)}
    fresh = flags.with_stale_flag(files, as_of="2023-02-01")
    assert fresh.where("is_orphaned").count() == 0


def linked(pairs):
    """Connected sets of a list of pairs."""
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    return {x: find(x) for x in parent}


def random_names(n, seed):
    rng = random.Random(seed)
    words = ["report", "invoice", "draft", "aaaa", "abab"]
    out = []
    for _ in range(n):
        base = list(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))))
        for _ in range(rng.randint(0, 3)):
            spot = rng.randrange(len(base) + 1)
            if rng.random() < 0.5 or not base:
                base.insert(spot, rng.choice("abxyz "))
            elif spot < len(base):
                del base[spot]
        out.append("".join(base).strip() + rng.choice(["", "", " (1)", " - Copy"]) + ".pdf")
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.9, 0.75])
@pytest.mark.parametrize("measure", ["ratio", "levenshtein"])
def test_fuzzy_pairs_find_every_pair_brute_force_finds(spark, threshold, measure):
    from shelfmark.functions.names import normalize

    rng = random.Random(3)
    rows = [(f"f{i:03d}", f"/folder{rng.randint(0, 1)}/{n}", rng.choice([5000, 5100, 2000, 2040]), "h", NEW, 0)
            for i, n in enumerate(random_names(260, 11))]
    files = make(spark, *rows)
    norm = {r.file_id: r.n for r in files.select("file_id", normalize(F.col("name")).alias("n")).collect()}
    def similarity(a, b):
        if measure == "ratio":
            return SequenceMatcher(None, norm[a], norm[b]).ratio()
        return 1 - levenshtein(norm[a], norm[b]) / max(len(norm[a]), len(norm[b]), 1)
    rep = {}
    for i, p, s, *_ in rows:
        key = (p.rsplit("/", 1)[0], s, norm[i])
        rep[key] = min(rep.get(key, i), i)
    profiles = [(i, *k) for k, i in rep.items()]
    want = set()
    for i, folder, size, name in profiles:
        for j, folder2, size2, name2 in profiles:
            if i < j and folder == folder2 and size // 1024 == size2 // 1024 and abs(size - size2) <= size * 0.1:
                if abs(len(name) - len(name2)) <= max(len(name), len(name2)) * (1 - threshold) + 1e-9 and similarity(i, j) >= threshold:
                    want.add((i, j))
    pairs = fuzzy.fuzzy_pairs(files, threshold=threshold, measure=measure).collect()
    got = {(r.file_a, r.file_b) for r in pairs if r.relation == "similar_name"}
    assert got == want and len(want) >= 10
    same = {(r.file_a, r.file_b) for r in pairs if r.relation == "same_name"}
    assert same == {(rep[(p.rsplit("/", 1)[0], s, norm[i])], i) for i, p, s, *_ in rows if rep[(p.rsplit("/", 1)[0], s, norm[i])] != i}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def test_fuzzy_examples(spark):
    def related(*named):
        files = make(spark, *[(f"f{i}", f"/d/{n}", 5000, "h", NEW, 0) for i, n in enumerate(named)])
        return fuzzy.fuzzy_pairs(files).count()

    assert related("quarterly_report_2024.pdf", "quarterly_report_2024_copy.pdf") == 1
    assert related("report.pdf", "invoice.pdf") == 0
    assert related("same.pdf", "same.docx") == 0


def test_copies_of_one_name_grow_linearly(spark):
    files = make(spark, *[(f"f{i:03d}", f"/d/photo ({i}).jpg", 5000, "h", NEW, 0) for i in range(100)])
    assert fuzzy.fuzzy_pairs(files).count() == 99


def test_consolidation_keeps_highest_priority(spark):
    rows = spark.createDataFrame([("/b", "h", 1), ("/a", "h", 1), ("/low", "h", 0), ("/z", "x", 0)], "path string, content_hash string, priority int")
    got = {r.path: (r.is_original, r.duplicate_of) for r in dedup.consolidate(rows).collect()}
    assert got == {"/a": (True, None), "/b": (False, "/a"), "/low": (False, "/a"), "/z": (True, None)}


def test_names_are_cleaned_once_and_copies_need_no_rounds(spark, monkeypatch):
    """every branch cleaned all names again, and all copies went through the rounds of the components."""
    names = ["alpha.pdf", "alpha (1).pdf", "alpha - Copy.pdf", "alphb.pdf", "alphb (1).pdf", "solitary name.pdf", "twin.pdf", "twin (1).pdf"]
    files = spark.createDataFrame([(f"f{i}", f"/d/{n}", n, ".pdf", 5000) for i, n in enumerate(names)], "file_id string, path string, name string, extension string, size_bytes long")
    pairs = fuzzy.fuzzy_pairs(files, threshold=0.7, measure="levenshtein")
    assert "regexp_replace" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    edges = []
    whole = fuzzy.star_components
    monkeypatch.setattr(fuzzy, "star_components", lambda e, a, b: (edges.append(e.count()), whole(e, a, b))[1])
    got = {r.file_id: r.group_id for r in fuzzy.linked_groups(pairs).collect()}
    assert got == {**{f"f{i}": "f0" for i in range(5)}, "f6": "f6", "f7": "f6"}
    assert edges == [1]
