"""Sequence similarity, the one scalar Spark has no built-in for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """2M/T with M the characters in matching blocks; left argument first."""
    matcher = SequenceMatcher(None)
    scores = []
    for a, b in zip(left, right):
        if a is None or b is None:
            scores.append(None)
            continue
        matcher.set_seqs(a, b)
        scores.append(matcher.ratio())
    return pd.Series(scores, dtype="float64")


# Declared non-deterministic so that a filter on the score does not make Spark run it
# a second time below the projection that returns the score.
sequence_ratio = _ratio.asNondeterministic()
