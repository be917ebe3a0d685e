"""The named queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, chosen_path, collocations, hard_negatives, impact, language, licenses, mixing, quality, rabitq, repair, token_counts, toxicity
from shelfmark.llm.common import fold, read
from shelfmark.session import shared_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    out = licenses.scan(docs, licenses.build_index(docs))
    return out.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def op2_rabitq(spark: SparkSession, folder: str) -> DataFrame:
    return rabitq.nearest(read(spark, folder, "embeddings"), "id % 100 = 0")


def op3_repair(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "tokens")
    repair.write(read(spark, folder, "documents"), out, VOCABULARY, end_id=1)
    return repair.read_documents(spark, out)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(bpe.encode(read(spark, folder, "documents"), VOCABULARY))


def op5_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.join(read(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).drop("source")


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    trees = language.learn(docs.where(fold() != 0))
    out = language.predict(docs, trees)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    out = quality.score(docs, quality.learn(docs.where(fold() != 0), labels.where(fold() != 0)))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")


def op9_impact(spark: SparkSession, folder: str) -> DataFrame:
    return impact.top_k(read(spark, folder, "embeddings"), "id % 50 = 0")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    out = toxicity.score(docs, toxicity.learn(docs.where(fold() != 0), labels.where(fold() != 0)))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").withColumn("label", F.col("label").cast("long"))
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", changed), "id % 50 = 0")


def op12_heap(spark: SparkSession, folder: str) -> DataFrame:
    out = token_counts.count(read(spark, folder, "documents"), VOCABULARY)
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op13_tries(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licenses, op2_rabitq, op3_repair, op4_bpe, op5_chosen_path, op6_mixing, op7_language, op8_quality, op9_impact, op10_toxicity, op11_segments, op12_heap, op13_tries)
}

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0 AS cap
  FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM r),
l AS (
  SELECT *, first_value(CASE WHEN cap > own_level * weight THEN own_level END IGNORE NULLS)
              OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level
  FROM f),
t AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target
  FROM l),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d)
SELECT doc_id, size, t.source_size, target,
       (CASE WHEN t.source_size > 0 THEN floor(target)::BIGINT // t.source_size ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN t.source_size > 0 THEN floor(target)::BIGINT % t.source_size ELSE 0 END - ahead)))::BIGINT AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
""",
    "op9_impact": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS no
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.no <> c.no
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5
""",
    "op11_segments": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS no
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.no AS anchor, a.vec_id AS anchor_id, x.no, x.vec_id, x.label = a.label AS same, list_dot_product(a.v, x.v)::BIGINT AS score
  FROM v a JOIN v x ON len(a.v) = len(x.v) AND a.no <> x.no
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, no) AS turn FROM s WHERE same) WHERE turn <= 5),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.turn ORDER BY n.score DESC, n.vec_id) AS rank
  FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same
   AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
""",
    "op13_tries": r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p),
f AS (
  SELECT lang, phrase, count(*) AS a
  FROM (SELECT lang, w[i] AS phrase FROM i
        UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] FROM i WHERE i + 1 <= len(w)
        UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM i WHERE i + 2 <= len(w))
  GROUP BY lang, phrase),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE a >= 10 AND len(string_split(phrase, ' ')) > 1),
k AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE len(w) = 3),
s AS (
  SELECT k.lang, k.phrase, k.a, l.a AS l, r.a AS r, k, (1000000::HUGEINT * k.a * k.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x JOIN f r ON r.lang = k.lang AND r.phrase = k.y),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS turn FROM s) WHERE turn = 1),
inner_pairs AS (
  SELECT lang, phrase, max(a) AS a
  FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE len(w) = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE len(w) = 3)
  GROUP BY lang, phrase),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN inner_pairs i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.a IS NULL OR 100 * i.a < 50 * b.a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
""",
}
