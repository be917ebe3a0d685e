"""Training, persistence, cascade."""

from pyspark.sql import functions as F

from shelfmark.operators import flags, models


def labelled(spark):
    kinds = {"invoice": "amount due total tax payment", "manual": "install configure device cable", "letter": "dear regards sincerely friend"}
    rows = [(f"{k}{i}", k, f"{k}_{i}.txt", f"{words} number {i}") for k, words in kinds.items() for i in range(20)]
    df = spark.createDataFrame(rows, "file_id string, label string, file_name string, text string")
    return models.with_text_features(df)


def test_forest_learns_persists_and_reports(spark, tmp_path):
    train, test = models.stratified_split(labelled(spark), "file_id")
    assert (train.count(), test.count()) == (48, 12)
    model = models.forest_pipeline(features=50, trees=5).fit(train)
    models.save(model, str(tmp_path / "model"))
    again = models.load(str(tmp_path / "model"))
    assert models.model_info(again)["classes"] == ["invoice", "letter", "manual"]
    scored = models.predict(again, test, "file_id").join(test.select("file_id", "label"), "file_id")
    assert models.accuracy(scored).collect()[0].accuracy >= 0.9
    assert {r.category for r in models.class_report(scored).collect()} == {"invoice", "letter", "manual"}
    row = scored.select(models.top_probabilities(F.col("probabilities"), 2).alias("t"), "confidence").collect()[0]
    assert len(row.t) == 2 and abs(row.t[0].p - row.confidence) < 1e-9
    unsure = models.predict(again, test, "file_id", threshold=1.1)
    assert unsure.where("predicted_category is null and method = 'ml_low_confidence'").count() == 12


def test_cross_validation_and_session_record(spark):
    score = models.cross_validated_accuracy(labelled(spark), models.forest_pipeline(features=30, trees=3), folds=2)
    assert score > 0.8
    row = models.session_record(spark, "s1", 48, 12, score, "2024-01-01").collect()[0]
    assert row.training_size == 48 and row.accuracy == score


def test_cascade_stops_at_the_first_sure_stage(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.1), (4, None)], "id int, c double")
    def stage(name, factor):
        return lambda df: df.withColumn("stage_category", F.when(F.col("c").isNotNull(), F.lit(name))).withColumn("stage_confidence", F.col("c") * factor)

    got = {r.id: r for r in models.cascade(rows, [("one", 0.8, stage("one", 1.0)), ("two", 0.7, stage("two", 1.5))]).collect()}
    assert (got[1].model_used, got[1].cascade_path) == ("one", ["one"])
    assert (got[2].predicted_category, got[2].cascade_path) == ("two", ["one", "two"])
    assert got[3].predicted_category == "two" and got[3].success
    assert (got[4].predicted_category, got[4].model_used, got[4].success) == ("unknown", "none", False)
    assert sum(r.rows for r in models.model_usage(models.cascade(rows, [("one", 0.8, stage("one", 1.0))])).collect()) == 4


def test_vocabulary_counts_and_settles_ties_by_bytes(spark):
    from pyspark.ml.feature import CountVectorizer

    rows = spark.createDataFrame([(["b", "a", "c", "c"],), (["a", "b", "d", "e", "e", "e"],), (["d", "z"],)], "terms array<string>")
    make = lambda **more: CountVectorizer(inputCol="terms", outputCol="tf", **more)
    for spread in (rows.repartition(1), rows.repartition(3)):
        assert models._vocabulary(make(vocabSize=4), spread).vocabulary == ["e", "a", "b", "c"]
        assert models._vocabulary(make(minDF=2.0, maxDF=0.7), spread).vocabulary == ["a", "b", "d"]


def test_fit_and_cascade_hold_no_texts_in_memory(spark):
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    docs = spark.createDataFrame([(1, "/a.pdf", "invoice total"), (2, "/b.txt", "")], "file_id long, path string, text string")
    stage = models.keyword_stage()
    done = models.cascade(docs, [("rule_based", 0.5, stage), ("second_pass", 0.0, stage)])
    assert done.count() == 2 and spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_vocabulary_is_whole_when_terms_share_buckets(spark, monkeypatch):
    """The frequent terms stand in few buckets, so those first looked into do not hold every term that is due."""
    from collections import Counter

    from pyspark.ml.feature import CountVectorizer

    texts = [[f"w{(i * j) % 97}" for j in range(1, 60)] + [f"only{i}"] for i in range(60)]
    counts = Counter(w for t in texts for w in t)
    docs = Counter(w for t in texts for w in set(t))
    rows = spark.createDataFrame([(t,) for t in texts], "terms array<string>").repartition(4)
    order = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    make = lambda **more: CountVectorizer(inputCol="terms", outputCol="tf", **more)
    for bits, share in ((1, 0.0), (5, 1.0), (18, 0.1)):
        monkeypatch.setattr(models, "BUCKET_BITS", bits)
        monkeypatch.setattr(models, "LIKELY_SHARE", share)
        for size in (1, 7, 40, 500):
            assert models._vocabulary(make(vocabSize=size), rows).vocabulary == order[:size]
        bounded = [w for w in order if 2 <= docs[w] <= 30]
        assert models._vocabulary(make(vocabSize=20, minDF=2.0, maxDF=0.5), rows).vocabulary == bounded[:20]


def test_rows_of_one_type_stay_in_many_tasks(spark):
    """A type's rows, with their texts, are not shuffled into one task; rare types still go."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where Spark does not broadcast by itself
    held = spark.range(4000).repartition(8).selectExpr(
        "id file_id", "case when id < 4 then 'rare' when id < 10 then 'few' else 'invoice' end document_type",
        "0.9D confidence", "repeat('x', 100) text")
    kept = flags.trainable(held).withColumn("task", F.spark_partition_id())
    got = {r.document_type: (r.n, r.tasks) for r in kept.groupBy("document_type").agg(
        F.count("*").alias("n"), F.count_distinct("task").alias("tasks")).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(got) == {"few", "invoice"} and got["few"][0] == 6 and got["invoice"][0] == 3990
    assert got["invoice"][1] >= 8


def test_pairs_are_counted_of_frequent_words_only(spark, monkeypatch):
    """The vocabulary is that of all terms, also where ties or few buckets leave more words than can be kept."""
    from pyspark.ml import PipelineModel

    texts = [" ".join(f"w{(i * j * j) % 23}" for j in range(1, 40 + i)) + f" only{i} only{i}" + " alpha beta" * (i % 3) * 9 for i in range(60)] + ["", "x", "one"]
    rows = spark.createDataFrame([(t,) for t in texts], "model_text string").repartition(4)
    calls, whole = [], models._vocabulary
    monkeypatch.setattr(models, "_vocabulary", lambda *args: calls.append(1) or whole(*args))
    for bits, size, low, high, stop in ((18, 5, 1.0, 1.0e18, False), (18, 5, 2.0, 0.5, True), (3, 3, 1.0, 1.0e18, False), (18, 400, 1.0, 1.0e18, False)):
        monkeypatch.setattr(models, "BUCKET_BITS", bits)
        *before, counter, _ = models._terms(size, low, high, stop)
        terms = PipelineModel(before).transform(rows)
        assert models._of_pairs(before) and not models._of_pairs(before[:-1])
        calls.clear()
        got = models._pair_vocabulary(counter, terms).vocabulary
        assert calls == [1] * (bits == 3 or size == 400)
        assert got == whole(counter, terms).vocabulary and len(got) == size
        # a frequent pair takes the place of a word, unless most texts hold it
        assert low > 1 or "alpha beta" in got


def test_texts_of_settled_rows_are_not_written(spark, monkeypatch):
    written, write = [], models._written
    monkeypatch.setattr(models, "_written", lambda df, purpose: written.append(write(df, purpose)) or written[-1])
    rows = spark.createDataFrame([(1, 0.9, "long text"), (2, 0.6, "other text")], "id int, c double, text string")

    def stage(factor):
        # an answer needs the text
        return lambda df: df.withColumns({"stage_category": F.upper("text"), "stage_confidence": F.col("c") * factor})

    done = models.cascade(rows, [("one", 0.8, stage(1.0)), ("two", 0.7, stage(1.5))], ["id"])
    assert {r.id: (r.predicted_category, r.model_used) for r in done.collect()} == {1: ("LONG TEXT", "one"), 2: ("OTHER TEXT", "two")}
    assert done.columns[0] == "id" and "text" not in done.columns
    assert {r.id: r.text for r in written[0].collect()} == {1: None, 2: "other text"} and "text" not in written[1].columns
