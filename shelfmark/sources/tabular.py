"""CSV and JSON sources and sinks, snapshots, configuration files."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.functions.rules import Rule, rules_from_config

# Columns of the reviewer CSV, in order.
REVIEW_COLUMNS = ("file_id", "file_name", "document_type", "confidence", "suggested_types", "reason", "correct_type", "notes")


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """Each report section as JSON lines below ``path``."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    """Rows as single JSON documents (registry export)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_review_csv(review: DataFrame, path: str) -> None:
    """Review list with empty answer columns for the reviewer."""
    blank = F.lit("")
    full = review.withColumn("correct_type", blank).withColumn("notes", blank).withColumn(
        "confidence", F.format_number(F.coalesce("confidence", F.lit(0.0)), 2)
    )
    write_csv(full.select(*REVIEW_COLUMNS), path)


def read_corrections(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Reviewer answers: rows whose correct_type is not blank."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.where(F.btrim(F.coalesce(F.col("correct_type"), F.lit(""))) != "")


def write_training_csv(rows: DataFrame, path: str) -> None:
    write_csv(rows.select("file_name", "document_type", "confidence"), path)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write the next version of a table to its own folder; existing versions stay.

    A folder that exists already means another writer was faster, and raises.
    """
    path = f"{base}/v{version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_catalog(df: DataFrame, path: str) -> None:
    """Catalog partitioned by session, rows sorted by hash for row-group skipping."""
    ordered = df.sortWithinPartitions("hash_full") if "hash_full" in df.columns else df
    ordered.write.mode("append").partitionBy("scan_session_id").parquet(path)


def load_config(path: str) -> dict:
    """A JSON or YAML configuration file (small, driver side)."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return json.load(handle)
        try:
            import yaml
        except ImportError as missing:
            raise ImportError("reading YAML configuration needs PyYAML; JSON works without it") from missing
        return yaml.safe_load(handle)


def read_rules(path: str) -> list[Rule]:
    return rules_from_config(load_config(path).get("rules", []))


def read_taxonomy(path: str) -> dict[tuple[str, str], list[str]]:
    """Taxonomy file: categories -> subcategories -> extensions."""
    out = {}
    for category, body in load_config(path).get("categories", {}).items():
        for sub, leaf in body.get("subcategories", {}).items():
            out[(category, sub)] = leaf.get("extensions", [])
    return out


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with zone-less timestamps cast once to timestamps (UTC session)."""
    df = spark.read.parquet(path)
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
