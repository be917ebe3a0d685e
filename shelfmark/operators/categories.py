"""File category and MIME type from names and extensions."""

from __future__ import annotations

import mimetypes
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import rule_tables as tables
from shelfmark.functions.globs import matches_any
from shelfmark.functions.lookups import config_table


def extension_rows(taxonomy: Mapping[tuple[str, str], str | Sequence[str]]) -> list[tuple[str, str, str]]:
    """(extension, category, subcategory); a later definition replaces an earlier one."""
    latest: dict[str, tuple[str, str]] = {}
    for pair, extensions in taxonomy.items():
        words = extensions.split() if isinstance(extensions, str) else extensions
        for ext in words:
            latest[ext.lower()] = pair
    return [(ext, *pair) for ext, pair in latest.items()]


def special_category(name: Column) -> Column:
    """struct decided by the name alone, NULL when no special pattern holds."""
    def pair(category: str, sub: str) -> Column:
        return F.struct(F.lit(category).alias("file_category"), F.lit(sub).alias("file_subcategory"))

    return F.when(matches_any(name, tables.TEMP_NAME_PATTERNS, False), pair("system", "temp_files")).when(
        matches_any(name, tables.LOW_VALUE_NAME_PATTERNS, False), pair("system", "logs")
    )


def mime_category(mime: Column) -> Column:
    chain = F
    for prefix, category in tables.MIME_CATEGORIES:
        chain = chain.when(F.startswith(mime, F.lit(prefix)), F.lit(category))
    return chain


def with_category(
    files: DataFrame,
    taxonomy: Mapping[tuple[str, str], str | Sequence[str]] = tables.TAXONOMY,
    mime_col: str | None = None,
) -> DataFrame:
    """Adds file_category and file_subcategory: special name, extension, MIME, other."""
    known = config_table(
        files.sparkSession, ["_ext", "_category", "_subcategory"], extension_rows(taxonomy)
    )
    special = special_category(F.col("name"))
    by_mime = mime_category(F.col(mime_col)) if mime_col else F.lit(None).cast("string")
    return (
        files.join(known, F.lower("extension") == F.col("_ext"), "left")
        .withColumn("_special", special)
        .withColumn("_mime", by_mime)
        .withColumn(
            "file_category",
            F.coalesce(F.col("_special.file_category"), F.col("_category"), F.col("_mime"), F.lit("other")),
        )
        .withColumn(
            "file_subcategory",
            F.coalesce(
                F.col("_special.file_subcategory"),
                F.col("_subcategory"),
                F.when(F.col("_mime").isNotNull(), F.lit("other")),
                F.lit("unknown"),
            ),
        )
        .drop("_ext", "_category", "_subcategory", "_special", "_mime")
    )


def mime_rows(extensions: Sequence[str]) -> list[tuple[str, str]]:
    """MIME types the standard library knows for the given extensions."""
    guesses = ((ext, mimetypes.guess_type("x" + ext)[0]) for ext in extensions)
    return [(ext, mime) for ext, mime in guesses if mime]


def with_mime_type(files: DataFrame, extensions: Sequence[str] | None = None) -> DataFrame:
    """Adds mime_type by extension; NULL when unknown."""
    extensions = extensions or [row[0] for row in extension_rows(tables.TAXONOMY)]
    known = config_table(files.sparkSession, ["_ext", "mime_type"], mime_rows(extensions))
    return files.join(known, F.lower("extension") == F.col("_ext"), "left").drop("_ext")
