"""Corpus pipeline: raw documents to encoded training text, five stages on Spark.

Each stage gets the rows its predecessor kept and returns the columns of documents, but for
the last, which returns what it measured of the encoded rows.  ``run`` writes every
stage's rows to the shared folder and reads them back.

=================  ============================================================================
language           rows go whose text has no letter, or is in a script no learnt language uses
toxicity           rows go that score 0.5 or more
near_duplicates    one row of each group of near copies stays, the one with the smallest doc_id;
                   rows without words or doc_id stay
mixing             rows repeat as often as the mix takes them; the row at a source's cut keeps
                   the words that still fit, and rows the mix does not take go
encoding           token ids, decoded again: counts and digests of both
=================  ============================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, chosen_path, language, mixing, queries, toxicity
from shelfmark.llm.common import fold, read, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = language.learn(docs.where(fold() != 0))
    kept = language.predict(docs, trees, keep=tuple(c for c in docs.columns if c != "doc_id"), prefix="_found_")
    return kept.where(language.worth_keeping("_found_")).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = toxicity.learn(docs.where(fold() != 0), read(spark, sf_dir, "labels").where(fold() != 0))
    scored = toxicity.score(docs, scorer, keep=tuple(c for c in docs.columns if c != "doc_id"), out="_toxic")
    return scored.where("_toxic < 0.5").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = chosen_path.join(docs)
    gone = found.where("class_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():  # rows that share id and text are copies too
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text": F.xxhash64("text")})
    mixed = mixing.mix(keyed, keep=("_id", "_text"))
    # equal rows share what they take
    share = written(mixed.groupBy("_id", "_text", F.col("source").alias("_source")).agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.count("*").alias("_n")).where("_taken > 0"), "shares")
    same = lambda part: keyed.join(
        share.where(part).withColumnsRenamed({"_id": "_i", "_text": "_t"}),
        F.col("_id").eqNullSafe(F.col("_i")) & F.col("_text").eqNullSafe(F.col("_t")) & F.col("source").eqNullSafe(F.col("_source")),
    )
    rows = same("_n = 1")
    if not share.where("_n > 1").isEmpty():
        rows = rows.unionByName(same("_n > 1").dropDuplicates(["_id", "_text", "source"]))
    words_left = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    cut = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), words_left.cast("int")), " ")
    rows = rows.withColumn("_cut", words_left < F.col("_size")).withColumn("text", F.when(F.col("_cut"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.digests(bpe.encode(docs, queries.VOCABULARY))


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# no stage but the mix can be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
