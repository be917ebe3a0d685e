"""Learned classifiers and the cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import flags, models
from shelfmark.plans.classify_queries import KEYWORD_BEST, KEYWORD_EXT
from shelfmark.plans.fixtures import REGISTRY_CLOCK, Tables
from shelfmark.plans.registry import query
from shelfmark.session import shared_folder


def labelled(t: Tables):
    """Confident, typed documents with their text features; the label is the type."""
    rows = flags.trainable(t.registry, min_confidence=0.5).withColumn("label", F.col("document_type"))
    return models.with_text_features(rows).select("file_id", "label", "model_text", "file_name", "text")


@query("stratified_split", "M5", """
    SELECT label, count(*) AS rows, count(*) FILTER (n % 5 = 0) AS test_rows FROM (
        SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(file_id AS VARCHAR)), file_id) AS n FROM (
            SELECT file_id, document_type AS label, count(*) OVER (PARTITION BY document_type) AS c FROM fx_registry
            WHERE document_type <> 'unknown' AND confidence >= 0.5) WHERE c >= 5) GROUP BY label""")
def _(t: Tables):
    train, test = models.stratified_split(labelled(t), "file_id")
    both = train.select("label", F.lit(0).alias("t")).unionByName(test.select("label", F.lit(1).alias("t")))
    return both.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(F.col("t") == 1).alias("test_rows"))


@query("rf_train_predict", "M3 M5 M6")
def _(t: Tables):
    train, test = models.stratified_split(labelled(t), "file_id")
    model = models.fit(models.forest_pipeline(), train)
    scored = models.predict(model, test, "file_id").join(test.select("file_id", "label"), "file_id")
    return models.class_report(scored)


@query("soft_vote", "M4 M6")
def _(t: Tables):
    train, test = models.stratified_split(models.with_structured_features(labelled(t)), "file_id")
    members = models.fit_members(models.voting_pipelines(), train)
    return models.soft_vote(members, test, "file_id", 0.5).select("file_id", "predicted_category", F.round("confidence", 4).alias("confidence"), "method")


@query("cascade_rules_only", "M7 C8", f"""
    SELECT f.file_id, CASE WHEN b.score >= 2 THEN b.kind ELSE coalesce({KEYWORD_EXT}, 'unknown') END AS predicted_category,
           CASE WHEN b.score >= 2 THEN 'rule_based' ELSE 'second_pass' END AS model_used
    FROM fx_files f JOIN ({KEYWORD_BEST}) b ON f.file_id = b.file_id""")
def _(t: Tables):
    stage = models.keyword_stage()
    docs = t.files.select("file_id", "path", "text")
    return models.cascade(docs, [("rule_based", 0.5, stage), ("second_pass", 0.0, stage)], ["file_id"]).select(
        "file_id", "predicted_category", "model_used")


@query("cascade_predict", "M7 M8")
def _(t: Tables):
    model = models.fit(models.forest_pipeline(), labelled(t))
    docs = models.with_text_features(t.files.withColumn("file_name", F.col("name"))).select("file_id", "path", "text", "model_text")
    available = {"forest": models.model_stage(model, "file_id"), "rule_based": models.keyword_stage()}
    return models.model_usage(models.cascade(docs, models.preset("fast", available), ["file_id"]))


@query("predict_with_all", "M8")
def _(t: Tables):
    model = models.fit(models.forest_pipeline(), labelled(t))
    docs = models.with_text_features(t.files.withColumn("file_name", F.col("name"))).select("file_id", "path", "text", "model_text")
    stages = [("forest", models.model_stage(model, "file_id")), ("rule_based", models.keyword_stage())]
    every = models.predict_with_all(docs, stages, "file_id")
    return every.groupBy("model", "predicted_category").agg(F.count("*").alias("rows"))


TESTED = """SELECT label, file_id FROM (
        SELECT label, file_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(file_id AS VARCHAR)), file_id) AS n FROM (
            SELECT file_id, document_type AS label, count(*) OVER (PARTITION BY document_type) AS c FROM fx_registry
            WHERE document_type <> 'unknown' AND confidence >= 0.5) WHERE c >= 5) WHERE n % 5 = 0"""


def checked(scored, labels, members: int = 1):
    """What must hold of every prediction, whatever the model learnt."""
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, b: a + b)
    top = F.array_max(F.map_values("probabilities"))
    return scored.select(
        "file_id",
        (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
        (F.col("predicted_category").isin(labels) & F.col("probabilities")[F.col("predicted_category")].eqNullSafe(top)).alias("best_known_class"),
        (F.col("confidence") == top).alias("confidence_is_best"),
    )


CHECKED = f"SELECT file_id, TRUE AS sums_to_one, TRUE AS best_known_class, TRUE AS confidence_is_best FROM ({TESTED})"


@query("rf_predictions_checked", "M3 M5 M6", CHECKED)
def _(t: Tables):
    train, test = models.stratified_split(labelled(t), "file_id")
    model = models.fit(models.forest_pipeline(), train)
    return checked(models.predict(model, test, "file_id"), models.labels_of(model))


@query("vote_predictions_checked", "M4 M6", CHECKED)
def _(t: Tables):
    train, test = models.stratified_split(models.with_structured_features(labelled(t)), "file_id")
    members = models.fit_members(models.voting_pipelines(), train)
    return checked(models.soft_vote(members, test, "file_id"), models.labels_of(members[0]))


@query("predict_with_all_counts", "M8", """
    SELECT model, count(*) AS rows FROM fx_files, (VALUES ('forest'), ('rule_based')) v(model) GROUP BY 1""")
def _(t: Tables):
    model = models.fit(models.forest_pipeline(), labelled(t))
    docs = models.with_text_features(t.files.withColumn("file_name", F.col("name"))).select("file_id", "path", "text", "model_text")
    stages = [("forest", models.model_stage(model, "file_id")), ("rule_based", models.keyword_stage())]
    return models.predict_with_all(docs, stages, "file_id").groupBy("model").agg(F.count("*").alias("rows"))


@query("cascade_predict_counts", "M7 M8", "SELECT count(*) AS rows, TRUE AS known_models, count(*) AS answered_or_none FROM fx_files")
def _(t: Tables):
    model = models.fit(models.forest_pipeline(), labelled(t))
    docs = models.with_text_features(t.files.withColumn("file_name", F.col("name"))).select("file_id", "path", "text", "model_text")
    available = {"forest": models.model_stage(model, "file_id"), "rule_based": models.keyword_stage()}
    done = models.cascade(docs, models.preset("fast", available), ["file_id"])
    return done.agg(
        F.count("*").alias("rows"),
        F.bool_and(F.col("model_used").isin("forest", "rule_based", "none")).alias("known_models"),
        F.count_if(F.col("success") | (F.col("model_used") == "none")).alias("answered_or_none"))


@query("model_saved_and_loaded", "M11", f"SELECT count(*) AS rows, TRUE AS same FROM ({TESTED})")
def _(t: Tables):
    train, test = models.stratified_split(labelled(t), "file_id")
    model = models.fit(models.forest_pipeline(), train)
    folder = shared_folder(t.spark, "model")
    models.save(model, folder)
    first = models.predict(model, test, "file_id").select("file_id", "predicted_category", F.round("confidence", 9).alias("c"))
    again = models.predict(models.load(folder), test, "file_id").select(
        "file_id", F.col("predicted_category").alias("again"), F.round("confidence", 9).alias("d"))
    same = (F.col("predicted_category") == F.col("again")) & (F.col("c") == F.col("d"))
    return first.join(again, "file_id").agg(F.count("*").alias("rows"), F.bool_and(same).alias("same"))


@query("training_session", "M9", f"""
    SELECT 's1' AS session_id, (SELECT count(*) FROM ({TESTED.replace('n % 5 = 0', 'n % 5 <> 0')})) AS training_size,
           (SELECT count(*) FROM ({TESTED})) AS test_size, TRUE AS accuracy_recomputed, TIMESTAMP '2024-01-31 00:00:00' AS trained_at""")
def _(t: Tables):
    """A forest trained, its record, and the record's accuracy against the predictions counted again."""
    make = lambda: models.forest_pipeline(features=200, trees=20)
    _, scored, record = models.train_session(t.spark, "s1", labelled(t), make, "file_id", REGISTRY_CLOCK)
    again = scored.agg((F.count_if(F.col("label") == F.col("predicted_category")) / F.count("*")).alias("share")).first().share
    same = (F.abs(F.col("accuracy") - F.lit(again)) < 1e-6) & F.col("accuracy").between(0, 1)
    return record.select("session_id", "training_size", "test_size", same.alias("accuracy_recomputed"), "trained_at")


@query("cross_validation", "M5", """
    SELECT CAST(n % 5 AS INTEGER) AS fold, count(*) AS rows, TRUE AS known_classes FROM (
        SELECT row_number() OVER (PARTITION BY label ORDER BY md5(CAST(file_id AS VARCHAR)), file_id) AS n FROM (
            SELECT file_id, document_type AS label, count(*) OVER (PARTITION BY document_type) AS c FROM fx_registry
            WHERE document_type <> 'unknown' AND confidence >= 0.5) WHERE c >= 5) GROUP BY 1""")
def _(t: Tables):
    """Each row predicted by the model of the other folds."""
    folded = models.with_folds(labelled(t), "file_id")
    scored = models.fold_predictions(folded, lambda: models.forest_pipeline(features=200, trees=10), "file_id")
    known = F.bool_and(F.col("probabilities")[F.col("label")].isNotNull() & F.col("predicted_category").isNotNull())
    return scored.groupBy("fold").agg(F.count("*").alias("rows"), known.alias("known_classes"))
