"""Tables written once for look-ups: by a key, and by any part of a name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scale import top_rows

PARTS = 211
# Files a part is written in, so that a key or a gram many rows share is not written by one task.
FILES_PER_PART = 4
GRAM = 3


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


# ---- by key --------------------------------------------------------------------------------------


def write_keyed(df: DataFrame, folder: str, key: str, row_id: str, parts: int = PARTS, rows_per_file: int = 1_000_000) -> None:
    """Write ``df`` for ``by_key``: parts by the hash of the key, sorted, with a Bloom filter on it.

    Rows without a key are kept in a part of their own.
    """
    dealt = df.withColumn("_part", F.coalesce(_part(F.col(key).cast("string"), parts), F.lit(-1)))
    dealt = dealt.repartition("_part", F.pmod(F.xxhash64(row_id), F.lit(FILES_PER_PART))).sortWithinPartitions("_part", key)
    dealt.write.partitionBy("_part").option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_file)
    ).option("parquet.bloom.filter.adaptive.enabled", "true").parquet(folder)


def by_key(spark: SparkSession, folder: str, key: str, value, parts: int = PARTS) -> DataFrame:
    """Rows whose key is ``value``: one part is listed, and its Bloom filters and bounds decide what is read."""
    rows = spark.read.parquet(folder)
    part = _part(F.lit(value).cast("string"), parts)
    return rows.where((F.col("_part") == part) & (F.col(key) == F.lit(value))).drop("_part")


# ---- by part of a name ---------------------------------------------------------------------------


def write_names(df: DataFrame, folder: str, row_id: str, name: str, parts: int = PARTS) -> None:
    """Write ``row_id`` and ``name`` for ``search``: the names by id, and where each gram of three characters stands.

    Grams are those of the lower-cased name.  Names shorter than a gram, and null ones,
    are among the names only.
    """
    names = df.select(F.col(row_id).alias("id"), F.col(name).alias("name"))
    named = names.withColumn("part", F.coalesce(_part(F.col("id").cast("string"), parts), F.lit(-1)))
    named.repartition("part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(f"{folder}/names")
    low = F.lower("name")
    at = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1)))
    # rows that share an id are told apart by their names
    grams = names.select("id", F.xxhash64("name").alias("of"), F.explode(F.transform(at, lambda i: F.struct(F.substr(low, i, F.lit(GRAM)).alias("gram"), i.alias("at")))).alias("g"))
    grams = grams.select("id", "of", "g.gram", "g.at").withColumn("part", _part(F.col("gram"), parts))
    grams = grams.repartition("part", F.pmod(F.xxhash64("id"), F.lit(FILES_PER_PART))).sortWithinPartitions("part", "gram", "id")
    grams.write.partitionBy("part").option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{folder}/grams")


def literal_runs(pattern: str) -> list[str]:
    """Stretches of a LIKE pattern between its wildcards, lower-cased; ``\\`` takes the next character as it is."""
    runs = [""]
    for escaped, plain in re.findall(r"\\(.)|(.)", pattern, re.S):
        if plain and plain in "%_":
            runs.append("")
        else:
            runs[-1] += escaped or plain
    return [r.lower() for r in runs if r]


def holding(spark: SparkSession, folder: str, run: str, parts: int = PARTS) -> DataFrame:
    """``id`` of the names that hold ``run`` (at least three characters, lower case): exact, from postings alone.

    Grams side by side cover the run, the last one flush with its end; a name holds it
    where all stand at their places.
    """
    offsets = sorted({*range(0, len(run) - GRAM + 1, GRAM), len(run) - GRAM})
    wanted: dict[str, list[int]] = {}
    for k in offsets:
        wanted.setdefault(run[k : k + GRAM], []).append(k)
    grams = spark.read.parquet(f"{folder}/grams")
    part = F.col("part").isin([_part(F.lit(g), parts) for g in wanted])
    shift = F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*[F.array(*map(F.lit, ks)) for ks in wanted.values()]))
    hits = grams.where(part & F.col("gram").isin(list(wanted)))
    if len(offsets) == 1:
        return hits.select("id").distinct()
    placed = hits.select("id", "of", F.explode(F.element_at(shift, F.col("gram"))).alias("k"), "at")
    whole = placed.groupBy("id", "of", (F.col("at") - F.col("k")).alias("start")).agg(F.size(F.collect_set("k")).alias("n")).where(F.col("n") == len(offsets))
    return whole.select("id").distinct()


def search(spark: SparkSession, folder: str, pattern: str, n: int | None = None, like: bool = True, parts: int = PARTS) -> DataFrame:
    """``id, name`` of the names that match: a LIKE pattern (case does not matter), or any place of a plain term.

    The longest run between wildcards decides from the postings which names are looked at,
    and those are held against the pattern.  Only where no run has three characters are
    all names read.  With ``n``, the first by falling id.
    """
    names = spark.read.parquet(f"{folder}/names")
    runs = literal_runs(pattern) if like else [pattern.lower()]
    longest = max(runs, key=len, default="")
    test = F.col("name").ilike(pattern) if like else F.contains(F.lower("name"), F.lit(pattern.lower()))
    if len(longest) >= GRAM:
        found = holding(spark, folder, longest, parts)
        if not like and n is not None:  # a run is the whole term: the first ids are known before any name is read
            found = top_rows(found, [F.desc("id")], n)
        found = found.withColumn("part", F.coalesce(_part(F.col("id").cast("string"), parts), F.lit(-1)))
        found = found.withColumnsRenamed({"id": "_id", "part": "_part"})
        names = names.join(found, (F.col("part") == F.col("_part")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    rows = names.where(test).select("id", "name")
    return rows if n is None else top_rows(rows, [F.desc("id")], n)
