"""Learned document classifiers and the confidence cascade, on Spark ML."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    NGram,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.functions.rule_tables import CASCADE_PRESETS
from shelfmark.functions.scale import HOT_ROWS_MIN, number_rows, share_of_total
from shelfmark.operators.flags import clock
from shelfmark.session import shared_folder

# --- training data ------------------------------------------------------------


def document_history(
    documents: DataFrame, predictions: DataFrame, feedback: DataFrame, latest_only: bool = False
) -> DataFrame:
    """Documents with their predictions and feedback.

    Several predictions or feedback entries fan out; ``latest_only`` keeps the newest
    of each (one aggregation, no ranking).
    """
    p = predictions.select("document_id", "predicted_category", "pred_confidence", "prediction_timestamp")
    f = feedback.select("document_id", "correct_category", "was_correct", "feedback_timestamp")
    if latest_only:
        p = _latest(p, "prediction_timestamp")
        f = _latest(f, "feedback_timestamp")
    return documents.join(p, "document_id", "left").join(f, "document_id", "left")


def _latest(df: DataFrame, ts: str) -> DataFrame:
    rest = [c for c in df.columns if c != "document_id"]
    return df.groupBy("document_id").agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("s")).select(
        "document_id", "s.*"
    )


def training_set(history: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Label per document: feedback if given, else the prediction."""
    label = F.coalesce("correct_category", "predicted_category")
    return history.where((F.col("confidence") >= min_confidence) & label.isNotNull()).select(
        "document_id",
        label.alias("label"),
        "confidence",
        (F.col("correct_category").isNotNull() & ~F.coalesce("was_correct", F.lit(False))).alias("was_corrected"),
    )


def retraining_rows(feedback: DataFrame, documents: DataFrame) -> DataFrame:
    """Text and corrected label of every unprocessed feedback entry."""
    entries = feedback.where(~F.coalesce("processed", F.lit(False)) & F.col("correct_category").isNotNull())
    return entries.select("document_id", F.col("correct_category").alias("label")).join(
        documents.select("document_id", "text"), "document_id"
    )


def with_text_features(docs: DataFrame, name_col: str = "file_name", text_col: str = "text") -> DataFrame:
    """model_text: the name three times and the whole text, lower case."""
    name = F.coalesce(F.col(name_col), F.lit(""))
    return docs.withColumn(
        "model_text", F.lower(F.concat_ws(" ", name, name, name, F.coalesce(F.col(text_col), F.lit(""))))
    )


def with_structured_features(docs: DataFrame, text_col: str = "text", type_col: str | None = None) -> DataFrame:
    """Numeric features next to the text: sizes, entity counts, type indicators."""
    text = F.col(text_col)
    out = docs.withColumns(
        {
            "f_words": tx.whitespace_word_count(text).cast("double"),
            "f_chars": F.length(text).cast("double"),
            "f_dates": tx.date_count(text).cast("double"),
            "f_money": tx.money_count(text).cast("double"),
        }
    )
    for family in ("financial", "legal", "medical", "tax"):
        hit = F.contains(F.col(type_col), F.lit(family)) if type_col else F.lit(False)
        out = out.withColumn(f"f_{family}", F.coalesce(hit, F.lit(False)).cast("double"))
    return out


STRUCTURED = ["f_words", "f_chars", "f_dates", "f_money", "f_financial", "f_legal", "f_medical", "f_tax"]


def stratified_split(
    labelled: DataFrame, id_col: str, label_col: str = "label", fifth: int = 5, floor: int = HOT_ROWS_MIN
) -> tuple[DataFrame, DataFrame]:
    """(train, test): every fifth row of each class, in md5 order, is a test row."""
    numbered = number_rows(labelled, [label_col], id_col, "_ordinal", floor)
    test = F.col("_ordinal") % fifth == 0
    return numbered.where(~test).drop("_ordinal"), numbered.where(test).drop("_ordinal")


# --- models -------------------------------------------------------------------

# Hash buckets in which occurrences of terms are summed before terms are counted: 2 to this power.
BUCKET_BITS = 18
# Share of the rows in which terms are looked for that are counted by themselves; it decides how, not what.
LIKELY_SHARE = 1 / 64
# Words of two signs and more, which hold no blank, and the terms: the words and their pairs.
WORDS = r"[\p{L}\p{N}_]{2,}"
WORDS_AND_PAIRS = "SELECT *, concat(words, pairs) AS terms FROM __THIS__"


def _terms(vocabulary: int, min_df: float, max_df: float, stop_words: bool) -> list:
    stages = [RegexTokenizer(inputCol="model_text", outputCol="words_raw", pattern=WORDS, gaps=False)]
    if stop_words:
        stages.append(StopWordsRemover(inputCol="words_raw", outputCol="words"))
    else:
        stages.append(SQLTransformer(statement="SELECT *, words_raw AS words FROM __THIS__"))
    return [
        *stages,
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement=WORDS_AND_PAIRS),
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary, minDF=min_df, maxDF=max_df),
        IDF(inputCol="tf", outputCol="tfidf"),
    ]


def _labels() -> StringIndexer:
    return StringIndexer(inputCol="label", outputCol="label_index", handleInvalid="keep", stringOrderType="alphabetAsc")


def forest_pipeline(features: int = 500, trees: int = 100, seed: int = 42) -> Pipeline:
    """TF-IDF over words and word pairs into a random forest."""
    forest = RandomForestClassifier(featuresCol="tfidf", labelCol="label_index", numTrees=trees, seed=seed)
    return Pipeline(stages=[*_terms(features, 1.0, 1.0e18, False), _labels(), forest])


def voting_pipelines(features: int = 500, trees: int = 100, seed: int = 42) -> list[Pipeline]:
    """Members of the soft vote over structured features and TF-IDF."""
    def member(classifier) -> Pipeline:
        assemble = VectorAssembler(inputCols=["tfidf", *STRUCTURED], outputCol="features")
        return Pipeline(stages=[*_terms(features, 2.0, 0.8, True), assemble, _labels(), classifier])

    return [
        member(RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=trees, seed=seed)),
        member(LogisticRegression(featuresCol="features", labelCol="label_index", maxIter=20, regParam=0.01)),
    ]


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    # small row groups, so that a few large files are still read by all cores
    df.write.option("parquet.block.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _used(df: DataFrame, stages: Sequence) -> list[str]:
    """Columns that some parameter of the stages names."""
    values = " ".join(str(v) for stage in stages for v in stage.extractParamMap().values())
    return [c for c in df.columns if re.search(rf"\b{re.escape(c)}\b", values)]


def _vocabulary(stage: CountVectorizer, rows: DataFrame) -> CountVectorizerModel:
    """The stage fitted by grouped counts; terms of equal count go by their bytes.

    Terms frequent in a sample are counted by themselves, all others are summed per hash
    bucket, so no task holds a table of all terms.  A bucket's sum is no less than the
    count of any term in it: if none reaches the count of the last term taken, that is all.
    Else terms are counted in the largest buckets, and again if other buckets reach it.
    """
    col, least, most, size = stage.getInputCol(), stage.getMinDF(), stage.getMaxDF(), stage.getVocabSize()
    one, zero = F.lit(1), F.lit(0)
    bucket = F.shiftrightunsigned(F.xxhash64("term"), 64 - BUCKET_BITS)
    every = rows.select(F.explode(col).alias("term"))
    likely = rows.sample(LIKELY_SHARE, seed=0).select(F.explode(col).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    likely = likely.orderBy(F.desc("n"), "term").limit(4 * size).select("term", F.lit(True).alias("known"))
    marked = every.join(F.broadcast(likely), "term", "left")
    keys = [F.when(F.col("known"), F.col("term")).alias("term"), F.when(F.col("known").isNull(), bucket).alias("bucket")]
    sums = _written(marked.groupBy(*keys).agg(F.count("*").alias("total")), "buckets")
    terms = every.select("term", one.alias("n"), zero.alias("docs"))
    bounded = least > 1 or most < 2**53
    if bounded:
        terms = terms.unionByName(rows.select(F.explode(F.array_distinct(col)).alias("term"), zero.alias("n"), one.alias("docs")))
        # values below one are shares of all rows
        total = rows.count() if min(least, most) < 1 else 0
        low, high = (v if v >= 1 else v * total for v in (least, most))

    def first(buckets: DataFrame) -> list:
        # at most 2**BUCKET_BITS numbers, whatever the input size
        held = terms.withColumn("bucket", bucket).join(F.broadcast(buckets.select("bucket")), "bucket", "left_semi")
        counted = held.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        if bounded:
            counted = counted.where(F.col("docs").between(low, high))
        return counted.orderBy(F.desc("n"), "term").limit(size).collect()

    taken = sums.where("bucket is null").orderBy(F.desc("total"), "term").limit(size).collect()
    if bounded or len(taken) < size or not sums.where((F.col("total") >= taken[-1].total) & F.col("bucket").isNotNull()).isEmpty():
        sums = sums.groupBy(F.coalesce("bucket", bucket).alias("bucket")).agg(F.sum("total").alias("total"))
        taken = first(sums.orderBy(F.desc("total"), "bucket").limit(2 * size))
        reaching = sums.where(F.col("total") >= (taken[-1].n if len(taken) == size else 0))
        if reaching.count() > 2 * size:
            taken = first(reaching)
    words = [r.term for r in taken]
    if not words:
        raise ValueError("no term is left for the vocabulary")
    return _counter(stage, words)


def _counter(stage: CountVectorizer, words: list[str]) -> CountVectorizerModel:
    model = CountVectorizerModel.from_vocabulary(words, stage.getInputCol(), stage.getOutputCol())
    return model.setMinTF(stage.getMinTF()).setBinary(stage.getBinary())


def _of_pairs(stages: Sequence) -> bool:
    """Whether the stages end with the words of ``_terms``, their pairs, and both as terms."""
    if len(stages) < 4 or not isinstance(stages[0], RegexTokenizer) or not isinstance(stages[-2], NGram):
        return False
    cut, pairs, terms = stages[0], stages[-2], stages[-1]
    return (
        (cut.getPattern(), cut.getGaps(), pairs.getN(), pairs.getInputCol(), pairs.getOutputCol()) == (WORDS, False, 2, "words", "pairs")
        and isinstance(terms, SQLTransformer)
        and terms.getStatement() == WORDS_AND_PAIRS
    )


def _pair_vocabulary(stage: CountVectorizer, rows: DataFrame) -> CountVectorizerModel:
    """What ``_vocabulary`` gives for the terms of ``words`` and their pairs, without counting all pairs.

    A pair occurs no more often than either of its words.  So if as many words as the
    vocabulary holds occur n times or more, every term in it does, and only pairs of such
    words are counted.  These words stand in hash buckets whose sums reach n.  Where too
    many words or buckets reach it, all terms are counted.
    """
    least, most, size = stage.getMinDF(), stage.getMaxDF(), stage.getVocabSize()
    bounded = least > 1 or most < 2**53
    total = rows.count() if bounded and min(least, most) < 1 else 0
    low, high = (v if v >= 1 else v * total for v in (least, most))
    bucket = F.shiftrightunsigned(F.xxhash64("term"), 64 - BUCKET_BITS)

    def occurrences(terms: Column) -> DataFrame:
        found = rows.select(F.explode(terms).alias("term"), F.lit(1).alias("n"), F.lit(0).alias("docs"))
        if bounded:
            found = found.unionByName(rows.select(F.explode(F.array_distinct(terms)).alias("term"), F.lit(0).alias("n"), F.lit(1).alias("docs")))
        return found

    def counted(found: DataFrame) -> DataFrame:
        fits = F.col("docs").between(low, high) if bounded else F.lit(True)
        return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("fits", fits)

    words = F.col("words")
    sums = _written(rows.select(F.explode(words).alias("term")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("total")), "buckets")
    largest = sums.orderBy(F.desc("total"), "bucket").limit(2 * size).select("bucket")
    held = occurrences(words).withColumn("bucket", bucket).join(F.broadcast(largest), "bucket", "left_semi")
    known = counted(held).orderBy(F.desc("n"), "term").limit(4 * size + 1).collect()
    reached = [r.n for r in known if r.fits][size - 1 : size]
    known = [r for r in known if reached and r.n >= reached[0]]
    if not reached or len(known) > 4 * size or sums.where(F.col("total") >= reached[0]).count() > 2 * size:
        return _vocabulary(stage, rows)
    frequent = F.transform(words, lambda w: F.when(w.isin([r.term for r in known]), w))
    following = F.zip_with(
        F.slice(frequent, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(frequent, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    pairs = counted(occurrences(F.array_compact(following))).where(F.col("fits") & (F.col("n") >= reached[0]))
    taken = [r for r in known if r.fits] + pairs.orderBy(F.desc("n"), "term").limit(size).collect()
    return _counter(stage, [r.term for r in sorted(taken, key=lambda r: (-r.n, r.term.encode()))[:size]])


def fit(pipeline: Pipeline, train: DataFrame, stored: bool = False) -> PipelineModel:
    """Fit stage by stage; texts are cut once and their words written, for the vocabulary and its vectors.

    The vectors are written without the texts and terms, so every later pass reads
    narrow rows and nothing is held in memory.  Rows that are not cut into words are
    written as they are, unless they are ``stored``.
    """
    stages = pipeline.getStages()
    rows = train.select(_used(train, stages))
    if not stored and not any(isinstance(s, NGram) for s in stages):
        rows = _written(rows, "train")
    fitted = []
    for k, stage in enumerate(stages):
        if isinstance(stage, NGram):
            rows = _written(rows.select(_used(rows, stages[k:])), "words")
        counts = isinstance(stage, CountVectorizer)
        if counts:
            model = (_pair_vocabulary if _of_pairs(stages[:k]) else _vocabulary)(stage, rows)
        else:
            model = stage.fit(rows) if isinstance(stage, Estimator) else stage
        fitted.append(model)
        if k + 1 < len(stages):
            rows = model.transform(rows)
        if counts:
            rows = _written(rows.select(_used(rows, stages[k + 1 :])), "vectors")
    return PipelineModel(fitted)


def fit_members(pipelines: Sequence[Pipeline], train: DataFrame) -> list[PipelineModel]:
    """Each pipeline fitted on the same rows, which are written once."""
    held = _written(train.select(_used(train, [s for p in pipelines for s in p.getStages()])), "train")
    return [fit(p, held, stored=True) for p in pipelines]


def labels_of(model: PipelineModel) -> list[str]:
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            return list(stage.labelsArray[0])
    raise ValueError("the model has no label index")


def _probability_map(probability: Column, labels: Sequence[str]) -> Column:
    # index len(labels) is the bucket for unseen labels: its share goes to the known ones
    known = F.slice(probability, 1, len(labels))
    total = F.aggregate(known, F.lit(0.0), lambda a, b: a + b)
    values = F.transform(known, lambda p: F.try_divide(p, total))
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), values)


def _best(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    entries = F.transform(
        F.map_entries("probabilities"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))
    )
    top = F.array_max(entries)
    return df.withColumn("predicted_category", top["label"]).withColumn("confidence", top["p"])


def predict(model: PipelineModel, docs: DataFrame, id_col: str, threshold: float | None = None) -> DataFrame:
    """id, category, confidence, probability map; below the threshold no category."""
    labels = labels_of(model)
    scored = model.transform(docs.withColumn("label", F.lit(labels[0])) if "label" not in docs.columns else docs)
    out = scored.withColumn("probabilities", _probability_map(vector_to_array("probability"), labels))
    out = _best(out, labels).select(id_col, "predicted_category", "confidence", "probabilities")
    return _with_method(out, threshold)


def _with_method(df: DataFrame, threshold: float | None) -> DataFrame:
    if threshold is None:
        return df.withColumn("method", F.lit("ml_model"))
    sure = F.col("confidence") >= threshold
    return df.withColumn("method", F.when(sure, "ml_model").otherwise("ml_low_confidence")).withColumn(
        "predicted_category", F.when(sure, F.col("predicted_category"))
    )


def soft_vote(models: Sequence[PipelineModel], docs: DataFrame, id_col: str, threshold: float | None = None) -> DataFrame:
    """Average of the members' probabilities, largest wins.

    The members run one after the other on the same rows and are averaged in the row, so
    nothing is shuffled.
    """
    rows, members = docs, []
    for k, model in enumerate(models):
        labels = labels_of(model)
        scored = model.transform(rows if "label" in rows.columns else rows.withColumn("label", F.lit(labels[0])))
        own = _probability_map(vector_to_array("probability"), labels).alias(f"_member{k}")
        members.append((F.col(f"_member{k}"), labels))
        rows = scored.select(*rows.columns, own)
    categories = sorted({c for _, labels in members for c in labels})
    mean = [reduce(lambda a, b: a + b, [F.coalesce(m[c], F.lit(0.0)) for m, _ in members]) / len(members) for c in categories]
    voted = rows.withColumn("probabilities", F.map_from_arrays(F.array(*[F.lit(c) for c in categories]), F.array(*mean)))
    return _with_method(_best(voted, []).select(id_col, "predicted_category", "confidence", "probabilities"), threshold)


def top_probabilities(probabilities: Column, n: int = 5) -> Column:
    """(category, p) structs, most probable first."""
    ranked = F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("minus_p"), e["key"].alias("category")))
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda e: F.struct(e["category"].alias("category"), (-e["minus_p"]).alias("p")))


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class over (label, predicted_category) rows."""
    cells = scored.groupBy("label", "predicted_category").agg(F.count("*").alias("n"))
    actual = cells.groupBy(F.col("label").alias("category")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("predicted_category"), F.col("n")).otherwise(0)).alias("hits"),
    )
    guessed = cells.groupBy(F.col("predicted_category").alias("category")).agg(F.sum("n").alias("guessed"))
    precision = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0))
    recall = F.try_divide("hits", "support")
    return actual.join(guessed, "category", "left").select(
        "category",
        "support",
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 6).alias("f1"),
    )


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("rows"),
        F.round(F.avg((F.col("label") == F.col("predicted_category")).cast("double")), 6).alias("accuracy"),
    )


def with_folds(labelled: DataFrame, id_col: str, label_col: str = "label", folds: int = 5, floor: int = HOT_ROWS_MIN) -> DataFrame:
    """Adds ``fold`` 0 to folds - 1: rows of each class in turn, in md5 order."""
    numbered = number_rows(labelled, [label_col], id_col, "_ordinal", floor)
    return numbered.withColumn("fold", (F.col("_ordinal") % folds).cast("int")).drop("_ordinal")


def fold_predictions(folded: DataFrame, make: Callable[[], Pipeline], id_col: str, folds: int = 5, side_by_side: int = 2) -> DataFrame:
    """``predict`` rows with ``fold`` and ``label``, each row by the model that has not seen its fold.

    ``side_by_side`` folds are fitted at a time, so that their jobs fill the cluster.  The
    rows are written once with what the pipeline reads.
    """
    kept = dict.fromkeys([id_col, "fold", "label", *_used(folded, make().getStages())])
    folded = _written(folded.select(*kept), "folds")

    def one(fold: int) -> DataFrame:
        model = fit(make(), folded.where(F.col("fold") != fold).drop("fold"), stored=True)
        held = folded.where(F.col("fold") == fold)
        return predict(model, held.drop("fold"), id_col).join(held.select(id_col, "fold", "label"), id_col)

    with ThreadPoolExecutor(side_by_side) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(folds)))


def train_session(spark, session_id: str, labelled: DataFrame, make: Callable[[], Pipeline], id_col: str, as_of=None) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model, its predictions of the test rows with their labels, session record) of one training run."""
    train, test = stratified_split(labelled, id_col)
    model = fit(make(), train)
    scored = _written(predict(model, test, id_col).join(test.select(id_col, "label"), id_col), "scored")
    result = accuracy(scored).first()
    return model, scored, session_record(spark, session_id, train.count(), result.rows, result.accuracy or 0.0, as_of)


def cross_validated_accuracy(labelled: DataFrame, pipeline: Pipeline, folds: int = 5, seed: int = 42) -> float:
    """Mean accuracy over the folds."""
    evaluator = MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy")
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator, numFolds=folds, seed=seed
    )
    return search.fit(labelled).avgMetrics[0]


def session_record(spark, session_id: str, train_size: int, test_size: int, score: float, as_of=None) -> DataFrame:
    """Training-session row to append."""
    return spark.range(1).select(
        F.lit(session_id).alias("session_id"),
        F.lit(train_size).cast("long").alias("training_size"),
        F.lit(test_size).cast("long").alias("test_size"),
        F.lit(float(score)).alias("accuracy"),
        clock(as_of).alias("trained_at"),
    )


def save(model: PipelineModel, path: str) -> None:
    """Pipeline with vocabulary and label index, as one folder."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_info(model: PipelineModel) -> dict:
    classifier = model.stages[-1]
    return {"classes": labels_of(model), "classifier": type(classifier).__name__, "features": classifier.numFeatures}


# --- cascade ------------------------------------------------------------------

Stage = Callable[[DataFrame], DataFrame]


def cascade(docs: DataFrame, stages: Sequence[tuple[str, float, Stage]], kept: Sequence[str] | None = None) -> DataFrame:
    """Ordered stages, each asked only about rows no earlier stage was sure of.

    A stage maps rows to the same rows with ``stage_category`` and
    ``stage_confidence`` (NULL when it has no answer).  Rows nobody is sure of keep the
    last answer.  Each stage's output is written once, so no stage runs twice and no
    text is held in memory.  Of the columns of ``docs`` the result holds those ``kept``
    (all, if not given); the others are written only for rows that a later stage reads.
    """
    kept = docs.columns if kept is None else list(kept)
    others = [c for c in docs.columns if c not in kept]
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    rest = docs.withColumns(
        {"last_category": no_text, "last_confidence": no_number, "cascade_path": F.array().cast("array<string>")}
    )
    finished = []
    for k, (name, min_confidence, stage) in enumerate(stages):
        sure = F.coalesce(F.col("stage_category").isNotNull() & (F.col("stage_confidence") >= min_confidence), F.lit(False))
        answered = (
            stage(rest)
            .withColumn("cascade_path", F.concat("cascade_path", F.array(F.lit(name))))
            .withColumn("last_confidence", F.when(F.col("stage_category").isNotNull(), F.col("stage_confidence")).otherwise(F.col("last_confidence")))
            .withColumn("last_category", F.coalesce("stage_category", "last_category"))
        )
        if k + 1 < len(stages):
            answered = answered.withColumns({c: F.when(~sure, F.col(c)) for c in others})
        else:
            answered = answered.drop(*others)
        answered = _written(answered, "cascade")
        finished.append(_cascade_result(answered.where(sure), kept))
        rest = answered.where(~sure).drop("stage_category", "stage_confidence")
    finished.append(_cascade_result(rest, kept))
    return reduce(DataFrame.unionByName, finished)


def _cascade_result(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    answered = F.col("last_category").isNotNull()
    return df.select(
        *columns,
        F.coalesce("last_category", F.lit("unknown")).alias("predicted_category"),
        F.coalesce("last_confidence", F.lit(0.0)).alias("confidence"),
        F.when(answered, F.element_at("cascade_path", -1)).otherwise("none").alias("model_used"),
        "cascade_path",
        answered.alias("success"),
    )


def preset(name: str, available: dict[str, Stage]) -> list[tuple[str, float, Stage]]:
    """Stages of a named preset, in order; a stage without an implementation is an error.

    ``CASCADE_PRESETS[name]`` lists what to supply; hosted and transformer models are the
    caller's own functions.
    """
    wanted = CASCADE_PRESETS[name]
    missing = [stage for stage, _ in wanted if stage not in available]
    if missing:
        raise ValueError(f"preset {name!r} needs stages that were not supplied: {', '.join(missing)}")
    return [(stage, cut, available[stage]) for stage, cut in wanted]


def predict_with_all(docs: DataFrame, stages: Sequence[tuple[str, Stage]], id_col: str) -> DataFrame:
    """Every stage's answer for every row, for comparing models."""
    parts = [
        stage(docs).select(
            id_col,
            F.lit(name).alias("model"),
            F.col("stage_category").alias("predicted_category"),
            F.col("stage_confidence").alias("confidence"),
        )
        for name, stage in stages
    ]
    return reduce(DataFrame.unionByName, parts)


def model_usage(results: DataFrame) -> DataFrame:
    """Rows each stage settled and its share of them in percent."""
    counted = results.groupBy("model_used").agg(F.count("*").alias("rows"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return share_of_total(counted, "rows", "share_pct", 4)


def keyword_stage(text_col: str = "text", path_col: str = "path") -> Stage:
    """The rule-based stage: keyword groups, extension, unknown."""
    from shelfmark.operators.classify import with_keyword_type

    def run(df: DataFrame) -> DataFrame:
        answered = with_keyword_type(df, text_col, path_col)
        return answered.withColumnsRenamed({"predicted_category": "stage_category", "confidence": "stage_confidence"})

    return run


def model_stage(model: PipelineModel, id_col: str) -> Stage:
    """A trained pipeline as a cascade stage over rows with model_text."""
    labels = labels_of(model)

    def run(df: DataFrame) -> DataFrame:
        scored = model.transform(df.withColumn("label", F.lit(labels[0])))
        best = scored.withColumn("_p", vector_to_array("probability"))
        top = F.array_max(
            F.array(*[F.struct(F.col("_p")[i].alias("p"), F.lit(-i).alias("rank"), F.lit(x).alias("label")) for i, x in enumerate(labels)])
        )
        return best.withColumn("_top", top).select(
            *df.columns, F.col("_top.label").alias("stage_category"), F.col("_top.p").alias("stage_confidence")
        )

    return run
