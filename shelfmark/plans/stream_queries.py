"""Streams over the events table, run to the end of what is available.

Every stream writes batch folders and the result is read back, so each can be compared
with the batch form of the same computation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import sync
from shelfmark.plans.fixtures import Tables
from shelfmark.plans.registry import query
from shelfmark.session import shared_folder
from shelfmark.streaming import changes, limits, windows
from shelfmark.streaming.state_table import ChangeStateTable


def event_stream(t: Tables) -> DataFrame:
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream to the end and read its batches back."""
    folder = shared_folder(t.spark, "stream")
    changes.run_to_end(stream, f"{folder}/checkpoint", changes.snapshot_writer(f"{folder}/out"), mode)
    return t.spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])).parquet(f"{folder}/out/*")


def newest_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key of an update-mode stream."""
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select(*keys, "s.*")


@query("change_stream", "R3 R4", """
    WITH spread AS (
        SELECT event_id, path, CASE WHEN change_type = 'renamed' THEN 'created' ELSE change_type END AS change_type, modified_at FROM fx_changes
        UNION ALL SELECT event_id, old_path, 'deleted', modified_at FROM fx_changes WHERE change_type = 'renamed')
    SELECT path, arg_max(change_type, (modified_at, event_id)) AS last_change, count(*) AS changes FROM spread GROUP BY path""")
def _(t: Tables):
    state = changes.latest_state_stream(t.changes_of(event_stream(t)))
    return newest_per(drain(t, state, "update"), ["path"]).select("path", "last_change", "changes")


@query("change_state_table", "R4", """
    WITH spread AS (
        SELECT event_id, path, CASE WHEN change_type = 'renamed' THEN 'created' ELSE change_type END AS change_type, modified_at FROM fx_changes
        UNION ALL SELECT event_id, old_path, 'deleted', modified_at FROM fx_changes WHERE change_type = 'renamed')
    SELECT path, arg_max(change_type, (modified_at, event_id)) AS last_change, count(*) AS changes FROM spread GROUP BY path""")
def _(t: Tables):
    folder = shared_folder(t.spark, "state")
    changes.run_to_end(t.changes_of(event_stream(t)), f"{folder}/checkpoint", changes.state_writer(f"{folder}/table"))
    return sync.state_of(t.spark.read.parquet(f"{folder}/table")).select("path", "last_change", "changes")


@query("conflict_stream", "R5 J15", """
    SELECT c.event_id, CASE WHEN change_type = 'deleted' THEN 'ignore' WHEN l.local_modified > c.modified_at THEN 'local_wins'
           ELSE 'download' END AS action FROM fx_changes c LEFT JOIN fx_local l ON c.path = l.path""")
def _(t: Tables):
    decided = changes.conflict_stream(t.changes_of(event_stream(t)), t.local_state, policy=sync.NEWER_WINS)
    return drain(t, decided, "append").select("event_id", "action")


@query("distinct_change_stream", "R1 R3", "SELECT event_id, path FROM fx_changes")
def _(t: Tables):
    once = changes.distinct_changes(t.changes_of(event_stream(t)))
    return drain(t, once, "append").select("event_id", "path")


@query("throughput_stream", "R6", """
    SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS items FROM events GROUP BY 1""")
def _(t: Tables):
    return newest_per(drain(t, windows.throughput(event_stream(t)), "update"), ["window_start"])


@query("window_stream", "R7", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS count FROM events GROUP BY ALL""")
def _(t: Tables):
    hourly = windows.type_counts(event_stream(t), "event_type", width="1 hour")
    return newest_per(drain(t, hourly, "update"), ["window_start", "event_type"])


@query("window_drift", "R7 A39", """
    WITH w AS (SELECT CAST(floor(epoch(ts) / 604800) AS BIGINT) AS k, event_type, count(*) AS count FROM events GROUP BY ALL)
    SELECT a.event_type, a.count, b.count AS previous, round((a.count - b.count) / CAST(b.count AS DOUBLE) * 100, 6) AS change_pct
    FROM w a JOIN w b ON a.event_type = b.event_type AND a.k = b.k + 1
    WHERE abs((a.count - b.count) / CAST(b.count AS DOUBLE) * 100) > 5""")
def _(t: Tables):
    counts = windows.type_counts(t.read("events"), "event_type", width="7 days")
    return windows.window_drift(counts, "event_type", min_change=5.0).select("event_type", "count", "previous", "change_pct")


RUNS = """SELECT user_id, min(ts) AS run_start, max(ts) + INTERVAL 30 MINUTE AS run_end, count(*) AS events FROM (
    SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, TRUE) AS gap FROM events))
    GROUP BY user_id, run"""


@query("activity_runs", "R9", RUNS)
def _(t: Tables):
    return windows.activity_runs(t.read("events"))


@query("activity_run_stream", "R9", f"SELECT count(*) > 0 AS closed_runs, count(DISTINCT user_id) AS users FROM ({RUNS})")
def _(t: Tables):
    closed = drain(t, windows.activity_runs(event_stream(t)), "append")
    return closed.agg((F.count("*") > 0).alias("closed_runs"), F.count_distinct("user_id").alias("users"))


@query("rate_limits", "R10", """
    SELECT user_id, event_id, last_minute, last_hour, CASE WHEN last_minute >= 1 THEN 60 ELSE 3600 END AS retry_after FROM (
        SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING)
               AS last_minute, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING)
               AS last_hour FROM events) WHERE last_minute >= 1 OR last_hour >= 2""")
def _(t: Tables):
    return windows.rate_limited(t.read("events"), per_minute=1, per_hour=2)


@query("rate_limit_stream", "R10", """
    SELECT user_id, s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS requests FROM (
        SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts),
               INTERVAL 30 MINUTE)) AS s FROM events) GROUP BY ALL HAVING count(*) >= 3""")
def _(t: Tables):
    limited = windows.rate_limit_windows(event_stream(t), width="1 hour", slide="30 minutes", limit=3)
    return newest_per(drain(t, limited, "update"), ["user_id", "window_start", "window_end"])


@query("rate_limit_trailing_stream", "R10", """
    SELECT user_id, event_id, last_minute, last_hour, CASE WHEN last_minute >= 1 THEN 60 ELSE 3600 END AS retry_after FROM (
        SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING)
               AS last_minute, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING)
               AS last_hour FROM events)
    WHERE (last_minute >= 1 OR last_hour >= 2) AND epoch_us(ts) < ((SELECT epoch_ms(max(ts)) FROM events) - 600000) * 1000""")
def _(t: Tables):
    limited = limits.rate_limited_stream(event_stream(t), per_minute=1, per_hour=2)
    with limits.state_on_disk(t.spark):
        return drain(t, limited, "append").drop("batch_id")


@query("change_state_compacted", "R3 R4", """
    WITH spread AS (
        SELECT event_id, path, CASE WHEN change_type = 'renamed' THEN 'created' ELSE change_type END AS change_type, modified_at FROM fx_changes
        UNION ALL SELECT event_id, old_path, 'deleted', modified_at FROM fx_changes WHERE change_type = 'renamed')
    SELECT path, arg_max(change_type, (modified_at, event_id)) AS last_change, count(*) AS changes, 2 AS segments FROM spread GROUP BY path""")
def _(t: Tables):
    """The feed as five batches: four merge into one segment, the fifth is one of its own."""
    folder = shared_folder(t.spark, "state")
    feed = t.changes
    feed.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(5))).repartition(5, "part").sortWithinPartitions("part").write.partitionBy("part").parquet(f"{folder}/feed")
    table = ChangeStateTable(t.spark, f"{folder}/table")
    for part in range(5):
        stream = t.spark.readStream.schema(feed.schema).parquet(f"{folder}/feed/part={part}")
        changes.run_to_end(stream, f"{folder}/checkpoint/{part}", lambda batch, _, part=part: table.append(batch, part))
    return table.read().select("path", "last_change", "changes", F.lit(len(table.manifest()["segments"])).alias("segments"))
