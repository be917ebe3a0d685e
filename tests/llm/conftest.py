"""Awkward inputs that every operator must take."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("id", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("key", T.IntegerType()),
        T.StructField("size", T.StringType()),
        T.StructField("ids", T.StringType()),
        T.StructField("k0", T.StringType()),
    ]
)
PROSE = {
    "en": "the quick brown fox and the lazy dog went over the hill while the others were watching the river all day long",
    "de": "der schnelle braune fuchs und der faule hund gingen ueber den huegel waehrend die anderen den fluss beobachteten",
}


def rows_of(texts, start=0):
    out = []
    for i, t in enumerate(texts, start):
        out.append((i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", "y", 1, 2, "z", "q", "w"))
    return out


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda texts, start=0: spark.createDataFrame(rows_of(texts, start), DOCS)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank, odd and long texts, exact repeats of rows and of texts."""
    base = [PROSE["de"], PROSE["en"], "", "   \n\t ", None, "!!! ??? 123", "ÀÉÎ straße Σίσυφος İstanbul İ", "a" * 3000, "日本語" * 700, "x\x00y \x1c z w", "MIT License, the mit license", PROSE["en"] * 60]
    rows = rows_of(base)
    rows += [rows[0], rows[1], (None,) * len(DOCS), (None,) * len(DOCS), (99, PROSE["en"], *rows[0][2:]), (0, "another text with the id of the first", *rows[0][2:])]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make_labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
