"""Lifecycle triggers and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import rule_tables as tables
from shelfmark.functions.lookups import config_table
from shelfmark.operators.flags import clock


def archive_due(files: DataFrame, days: int = 180, as_of=None) -> DataFrame:
    """Not modified for ``days`` and never accessed."""
    idle = F.date_diff(clock(as_of), F.col("modified_at")) >= days
    return files.where(idle & (F.coalesce("access_count", F.lit(0)) == 0))


def quarantine_review_due(actions: DataFrame, days: int = 30, as_of=None, since_col: str = "quarantined_at") -> DataFrame:
    """Quarantined files old enough to decide on."""
    return actions.where(F.date_diff(clock(as_of), F.col(since_col)) >= days)


def retention(docs: DataFrame, archive_days: int = 365, as_of=None, domains=tables.DOMAINS) -> DataFrame:
    """Domain documents with their retention end, and the archive target once idle.

    ``docs`` has domain, created_at, accessed_at and name.
    """
    years = config_table(
        docs.sparkSession, ["domain", "retention_years"], [(d, y) for d, _, _, _, _, y in domains if y]
    )
    now = clock(as_of)
    ends = F.add_months(F.col("created_at"), F.col("retention_years") * 12)
    idle = F.date_diff(now, F.col("accessed_at")) >= archive_days
    target = F.concat_ws("/", F.lit("Archive"), "domain", F.date_format("accessed_at", "yyyy"), "name")
    return (
        docs.join(years, "domain", "left")
        .withColumn("retain_until", ends)
        .withColumn("retention_over", F.coalesce(F.col("retain_until") < now.cast("date"), F.lit(False)))
        .withColumn("archive_target", F.when(idle, target))
    )
