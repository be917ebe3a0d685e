"""Small cases of the findings of the fourth round."""

import math

import duckdb

from shelfmark.plans.registry import load_all

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, folder, rows):
    """A folder of tables with these rows as ``documents``."""
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_array_and_math_divides_by_the_length_of_an_empty_text(spark, tmp_path):
    """an empty text has no length to divide by; the row stays, with what the SQL says."""
    rows = [(1, "", "en", "s", 0), (2, "", "en", "s", 7), (3, "the a the", "en", "s", 9), (4, None, "en", "s", 3), (5, "", "en", "s", None)]
    q = load_all()["array_and_math"]
    folder = documents(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in q.run(spark, folder).collect())
    want = sorted(con.execute(q.sql).fetchall())
    plain = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
    assert [plain(r) for r in got] == [plain(r) for r in want] and len(got) == 5
    assert math.isnan(got[0][2]) and math.isinf(got[1][2])
