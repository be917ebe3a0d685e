"""Look-ups and searches against scans."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import keyed


def files_read(df):
    """Files the scan of a plan without shuffles opens."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numFiles").value()


def test_by_key_reads_one_part(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.sha2((F.col("id") % 9_000).cast("string"), 256).alias("h"), F.lit("x").alias("_other"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, "x")], "id long, h string, _other string"))
    folder = str(tmp_path / "keyed")
    keyed.write_keyed(rows, folder, "h", "id")
    assert spark.read.parquet(folder).count() == 20_001
    for value in ("17", "8999", "none"):
        digest = rows.where(F.col("id") == int(value)).first().h if value != "none" else "none"
        got = keyed.by_key(spark, folder, "h", digest)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.where(F.col("h") == digest).collect())
        assert got.columns == ["id", "h", "_other"]
        assert files_read(got) <= keyed.FILES_PER_PART  # of some 800
    assert keyed.by_key(spark, folder, "h", None).count() == 0


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rng = random.Random(4)
    parts = ["Report", "report_final", "100%", "a_b", "In", "İnvoice", "ß", "aaa", "aaaa", ".pdf", " ", "\\x", "日本語", "\n", "No"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for i in range(1500)] + [(2000, None), (1, "a second Report of id 1"), (None, "report")]
    df = spark.createDataFrame(rows, "file_id long, file_name string")
    folder = str(tmp_path_factory.mktemp("names"))
    keyed.write_names(df, folder, "file_id", "file_name", parts=13)
    return df, folder


PATTERNS = ["%report%", "report%", "%.PDF", "%100\\%%", "a\\_b%", "%a_b%", "%aaaa%", "%no%", "in", "%", "", "_eport", "%rep%fin%.pdf", "%日本語%", "%i̇nv%", "%\\\\x%", "%zzz%"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_like_as_the_scan(spark, names, pattern):
    df, folder = names
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(map(tuple, keyed.search(spark, folder, pattern, parts=13).collect()), key=key)
    assert got == sorted(map(tuple, df.where(F.col("file_name").ilike(pattern)).collect()), key=key)


@pytest.mark.parametrize("term", ["Report", "eport", "aaaa", "100%", "a_b", "no", "\\x", "zzz"])
def test_terms_as_the_scan(spark, names, term):
    df, folder = names
    hits = df.where(F.contains(F.lower("file_name"), F.lit(term.lower())))
    assert keyed.search(spark, folder, term, like=False, parts=13).count() == hits.count()
    got = [r.id for r in keyed.search(spark, folder, term, 20, like=False, parts=13).collect()]
    assert got == [r.file_id for r in hits.orderBy(F.desc("file_id")).limit(20).collect()]


def test_a_term_is_found_in_the_postings_alone(spark, names):
    _, folder = names
    plan = keyed.holding(spark, folder, "report", 13)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "gram" in plan
    assert keyed.literal_runs("%ab\\%c_D%") == ["ab%c", "d"]
