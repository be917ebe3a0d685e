"""Small configuration tables as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Above this many rows a configuration table is joined, not broadcast by hint.
BROADCAST_ROWS_MAX = 10_000


def config_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A driver-side table as a local relation; broadcast only while provably small."""
    rows = list(rows)
    arrays = [pa.array([r[i] for r in rows]) for i in range(len(columns))]
    df = spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)))
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS_MAX else df
