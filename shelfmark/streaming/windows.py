"""Windowed counts over event streams; every function also takes a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marked(events: DataFrame, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, lateness) if events.isStreaming else events


def throughput(events: DataFrame, ts: str = "ts", width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Items and bytes per interval."""
    return (
        marked(events, ts, lateness)
        .groupBy(F.window(ts, width))
        .agg(F.count("*").alias("items"))
        .select(F.col("window.start").alias("window_start"), "items")
    )


def type_counts(
    events: DataFrame, kind: str, ts: str = "ts", width: str = "7 days", slide: str | None = None, lateness: str = "1 day"
) -> DataFrame:
    """Counts per type and window: the rolling input of drift and hourly reports."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        marked(events, ts, lateness)
        .groupBy(w, F.col(kind))
        .agg(F.count("*").alias("count"))
        .select(F.col("window.start").alias("window_start"), kind, "count")
    )


def window_drift(counts: DataFrame, kind: str, days: int = 7, min_change: float = 50.0) -> DataFrame:
    """Windows against the window before, inside foreachBatch or on a batch table."""
    before = counts.select(
        (F.col("window_start") + F.make_dt_interval(days=F.lit(days))).alias("window_start"),
        kind,
        F.col("count").alias("previous"),
    )
    return (
        counts.join(before, ["window_start", kind])
        .withColumn(
            "change_pct", F.round((F.col("count") - F.col("previous")) / F.col("previous") * F.lit(100.0), 6)
        )
        .where(F.abs("change_pct") > min_change)
    )


def activity_runs(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Bursts of activity per key, closed by a gap."""
    return (
        marked(events, ts, lateness)
        .groupBy(F.session_window(ts, gap), F.col(key))
        .agg(F.count("*").alias("events"))
        .select(key, F.col("session_window.start").alias("run_start"), F.col("session_window.end").alias("run_end"), "events")
    )


def rate_limit_windows(
    events: DataFrame,
    key: str = "user_id",
    ts: str = "ts",
    width: str = "1 minute",
    slide: str = "10 seconds",
    limit: int = 60,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Keys at or over a limit in a sliding window (streaming form)."""
    return (
        marked(events, ts, lateness)
        .groupBy(F.window(ts, width, slide), F.col(key))
        .agg(F.count("*").alias("requests"))
        .where(F.col("requests") >= limit)
        .select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests")
    )


def rate_limited(
    events: DataFrame,
    key: str = "user_id",
    ts: str = "ts",
    id_col: str = "event_id",
    per_minute: int = 60,
    per_hour: int = 1000,
    piece_hours: int = 4,
) -> DataFrame:
    """Events that find their key over its minute or hour limit, with retry_after.

    Exact trailing counts of the events before each one.  A key's events are cut into
    pieces of ``piece_hours`` that each carry the last hour of the piece before, so a
    hot key is spread over its pieces instead of filling one task.
    """
    hour, minute = 3_600_000_000, 60_000_000
    at = F.unix_micros(ts)
    piece = F.floor(at / (piece_hours * hour))
    following = F.floor((at + hour) / (piece_hours * hour))
    pieces = F.array_distinct(F.array(piece, following))
    spread = (
        events.select(key, id_col, at.alias("_at"), piece.alias("_home"), pieces.alias("_pieces"))
        .withColumn("_piece", F.explode("_pieces"))
        .drop("_pieces")
    )

    def older_than(micros: int) -> Column:
        # frames that only grow are counted incrementally; a sliding frame is not
        w = Window.partitionBy(key, "_piece").orderBy("_at").rangeBetween(Window.unboundedPreceding, -micros)
        return F.count("*").over(w)

    before = older_than(1)
    counted = (
        spread.withColumn("last_minute", before - older_than(minute))
        .withColumn("last_hour", before - older_than(hour))
        .where(F.col("_piece") == F.col("_home"))
    )
    wait = F.when(F.col("last_minute") >= per_minute, 60).when(F.col("last_hour") >= per_hour, 3600)
    return counted.withColumn("retry_after", wait).where(F.col("retry_after").isNotNull()).select(
        key, id_col, "last_minute", "last_hour", "retry_after"
    )
