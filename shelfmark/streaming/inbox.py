"""Inbox processing as a stream: watch, register, classify, plan, re-check."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import classify, organise, quality, transitions
from shelfmark.schemas import REGISTRY
from shelfmark.session import remove_folder, shared_folder
from shelfmark.sources.files import hash_by_path, plain_path

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 16


def watch(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder tree, hidden and temporary names skipped.

    Producers must move finished files in; there is no settle delay.  The source's own
    checkpoint emits each path once, whatever the file's modification time.  The stream
    holds paths and sizes only, so files of any size pass; ``batch_processor`` hashes them.
    """
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    name = paths.name(F.col("path"))
    return (
        raw.where(~F.startswith(name, F.lit(".")) & ~F.startswith(name, F.lit("~")))
        .select(
            plain_path(F.col("path")).alias("original_path"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("drop_timestamp"),
        )
    )


def process(batch: DataFrame, registry: DataFrame, root: str = "/Canonical", as_of=None) -> DataFrame:
    """Register, classify and place one batch; rows follow the registry schema loosely."""
    return place(transitions.register_batch(batch, registry), root, as_of)


def place(registered: DataFrame, root: str = "/Canonical", as_of=None) -> DataFrame:
    """Type, state and target of registered rows, in one pass: only pending ones are classified."""
    pending = F.col("canonical_state") == "pending"
    decided = classify.with_pending_decision(registered)
    typed = decided.select(
        *[c for c in registered.columns if c != "canonical_state"],
        F.when(pending, F.col("new_type")).alias("document_type"),
        F.when(pending, F.col("new_confidence")).alias("confidence"),
        F.when(pending, F.col("new_method")).alias("classification_method"),
        F.when(pending, F.col("new_method") == "fallback").alias("requires_review"),
        F.when(pending, "classified").otherwise(F.col("canonical_state")).alias("canonical_state"),
    )
    planned = organise.canonical_plan(typed, root, as_of)
    return planned.withColumn(
        "target_path", F.when(F.col("canonical_state") == "classified", F.col("target_path"))
    ).drop("domain", "changes")


@contextmanager
def few_listing_tasks(spark: SparkSession, tasks: int = LISTING_TASKS):
    """Streams started inside list the files of a batch in so many tasks, not in one task a file."""
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, tasks)
    try:
        yield
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)


def batch_processor(registry_path: str, out_path: str, root: str = "/Canonical", as_of=None):
    """foreachBatch function: earlier batches and the base registry are what is known.

    Files without a ``content_hash`` are hashed here, in blocks; one that cannot be read
    gets the state ``error``.

    Output is one table partitioned by ``batch``; a repeated batch overwrites its own
    partition and never counts its own earlier output as known content.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged: list[str] = []

        def stage(df: DataFrame) -> DataFrame:
            staged.append(shared_folder(spark, "batch"))
            df.write.parquet(staged[-1])
            return spark.read.schema(df.schema).parquet(staged[-1])

        if "content_hash" not in batch.columns:
            # each file is opened once, however often the rows are used
            batch = stage(hash_by_path(batch.withColumn("path", F.col("original_path")), "content_hash").drop("path", "hash_error"))
        known = spark.read.schema(REGISTRY).parquet(registry_path).select("file_id", "content_hash", "is_duplicate")
        if batch_id > 0:
            earlier = spark.read.schema("file_id string, content_hash string, is_duplicate boolean, batch long").parquet(out_path)
            known = known.unionByName(earlier.where(F.col("batch") < batch_id).drop("batch"))
        # written first: else each branch of the registration repeats classifying and placing
        registered = stage(transitions.register_batch(batch, known))
        done = place(registered, root, as_of).withColumn("batch", F.lit(batch_id).cast("long"))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path)
        for folder in staged:
            remove_folder(spark, folder)

    return run


def retrain_watch(feedback_path: str, out_path: str, as_of=None):
    """foreachBatch function: evaluate the retraining trigger after new feedback."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store = batch.sparkSession.read.parquet(feedback_path)
        quality.retrain_trigger(store, as_of).write.mode("overwrite").json(f"{out_path}/batch={batch_id}")

    return run
