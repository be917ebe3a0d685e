"""The pipeline's stages on awkward documents, and every query of the subpackage against its SQL."""

import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from shelfmark.llm import queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stage_names_and_columns(spark, awkward, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "encoding"]
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward, no_docs):
            out = stage(spark, docs, SF)
            n = out.count()
            if name != "encoding":
                assert out.columns == docs.columns
            if docs is no_docs:
                assert n == 0


def test_language_stage_rejects_only_what_has_no_language(spark, make_docs):
    docs = make_docs(["the cat and the dog went home to sleep for the night", "12345 !!!", None, "der hund und die katze gingen nach hause"] * 30)
    kept = corpus_pipeline.language_stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [i for i in range(120) if i % 4 in (0, 3)]


def test_one_of_each_group_stays(spark, make_docs):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words[:50], "x", *words[51:]]), " ".join(words), "other words stand here alone now", "", None]
    docs = make_docs(texts)
    docs = docs.union(docs.where("doc_id in (0, 3)"))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 4, 5]


def test_mix_repeats_and_cuts_rows(spark, make_docs):
    docs = make_docs([f"word{i} and {'more ' * (i % 5)}text" for i in range(200)])
    docs = docs.union(docs.where("doc_id < 3"))
    from shelfmark.llm import mixing

    want = {r.source: r.target for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.mixing_stage(spark, docs, SF).withColumn("w", mixing.words())
    got = {r.source: r.w for r in out.groupBy("source").sum("w").toDF("source", "w").collect()}
    assert got == {s: int(t) for s, t in want.items()}
    assert out.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_as_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    want, got = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got) and all((want[c].to_numpy() == got[c].to_numpy()).all() for c in cols)


def test_thirteen_queries_and_the_pipeline_are_registered():
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    names = eval(out)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
