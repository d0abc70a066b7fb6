"""Classifiers and the resolution-time regressor on Spark ML.

Encoders are stages of the fitted pipeline, so a model is saved and loaded as one
``PipelineModel`` and scoring is a plain ``transform`` of any number of rows.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, IndexToString, Normalizer, RegexTokenizer
from pyspark.ml.feature import StringIndexer, VectorAssembler  # StringIndexer for labels only
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from caselight.functions.expr import flag, number
from caselight.functions.text import TOKEN, classifier_text
from caselight.operators.analytics import standardised
from caselight.operators.evaluation import class_weights, weighted_f1
from caselight.operators.scale import PART_ROWS, dealt
from caselight.schemas import (
    CLASSIFIER_BOOLEAN, CLASSIFIER_CATEGORICAL, CLASSIFIER_NUMERIC, CLASSIFIER_TASKS,
    HOURS_BOOLEAN, HOURS_CATEGORICAL, HOURS_NUMERIC, with_columns,
)
from caselight.session import ensure_checkpoint_dir, kept_aside

EMBEDDING = 384
UNKNOWN_LABEL = "UNKNOWN"
#: Range of the numbers that stand for categories in a model.
CODES = 1 << 24


def category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("unknown"))


def structured(df: DataFrame, categorical, numeric, boolean) -> DataFrame:
    """Typed inputs: missing category "unknown", missing number or flag 0.

    A model sees a category as a plain number, a hash of its value: a column may have any
    number of values, none of them is ever listed on the driver, and new ones have a code.
    """
    df = with_columns(df, [*categorical, *numeric, *boolean])
    return df.withColumns({
        **{f"{c}_cat": category(c) for c in categorical},
        **{f"{c}_code": F.pmod(F.xxhash64(category(c)), F.lit(CODES)).cast("double") for c in categorical},
        **{f"{c}_num": number(c, 0) for c in numeric},
        **{f"{c}_num": flag(c).cast("double") for c in boolean},
    })


def scoring_inputs(tickets: DataFrame) -> DataFrame:
    """The tickets with the model's text and structured inputs added."""
    df = structured(tickets, CLASSIFIER_CATEGORICAL, CLASSIFIER_NUMERIC, CLASSIFIER_BOOLEAN)
    return with_columns(df, ["subject", "description"]).withColumn("_text", classifier_text())


def classifier_inputs(tickets: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Text and structured columns shared by the four tasks, and the columns ``also``; persist it once."""
    df = with_columns(scoring_inputs(tickets), CLASSIFIER_TASKS.values())
    keep = [f"{c}_code" for c in CLASSIFIER_CATEGORICAL]
    keep += [f"{c}_num" for c in CLASSIFIER_NUMERIC + CLASSIFIER_BOOLEAN]
    labels = {
        f"label_{t}": F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN_LABEL))
        for t, c in CLASSIFIER_TASKS.items()}
    return df.withColumns(labels).select("ticket_id", "_text", *keep, *labels, *also)


def feature_stages() -> list:
    """Hashed text embedding, category codes and numbers in one vector."""
    return [
        RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=TOKEN, gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=EMBEDDING),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="emb"),
        VectorAssembler(
            inputCols=["emb", *[f"{c}_code" for c in CLASSIFIER_CATEGORICAL],
                       *[f"{c}_num" for c in CLASSIFIER_NUMERIC + CLASSIFIER_BOOLEAN]],
            outputCol="features"),
    ]


def fit_features(inputs: DataFrame) -> PipelineModel:
    return Pipeline(stages=feature_stages()).fit(inputs)


def term_counts(inputs: DataFrame) -> DataFrame:
    """``inputs`` with hashed term counts in place of the text, written once: fitting and encoding
    read these few numbers and neither cut nor move the texts again."""
    tokenizer, hashing = feature_stages()[:2]
    return kept_aside(hashing.transform(tokenizer.transform(inputs)).drop("_text", "_tok"))


def fit_counted(counted: DataFrame) -> PipelineModel:
    """The model of ``fit_features`` from the rows of ``term_counts``."""
    stages = feature_stages()
    return PipelineModel(stages=[*stages[:2], *Pipeline(stages=stages[2:]).fit(counted).stages])


def encode_counted(model: PipelineModel, counted: DataFrame) -> DataFrame:
    """Identifier, features and labels of the rows of ``term_counts``, nothing else, written once."""
    labels = [c for c in counted.columns if c.startswith("label_")]
    return kept_aside(PipelineModel(stages=model.stages[2:]).transform(counted).select("ticket_id", "features", *labels))


def category_codes(tickets: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, value, code): the values of each column numbered in alphabetical order."""
    columns = columns or CLASSIFIER_CATEGORICAL
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), category(c).alias("value")) for c in columns])
    values = with_columns(tickets, columns).select(F.inline(cells)).distinct()
    order = Window.partitionBy("feature").orderBy("value")
    return values.withColumn("code", (F.row_number().over(order) - 1).cast("int"))


def encoded_categories(tickets: DataFrame, codes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ticket_id, <column>_code): -1 for a value that ``codes`` doesn't have."""
    columns = columns or CLASSIFIER_CATEGORICAL
    df = with_columns(tickets, columns).select("ticket_id", *[category(c).alias(c) for c in columns])
    for c in columns:
        own = codes.filter(F.col("feature") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        df = df.join(own, c, "left")
    return df.select("ticket_id", *[F.coalesce(f"{c}_code", F.lit(-1)).alias(f"{c}_code") for c in columns])


def _labelled_cells(tickets: DataFrame, columns: list[str], label: Column) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), category(c).alias("value")) for c in columns])
    rows = with_columns(tickets, columns).select("ticket_id", "created_at", label.cast("double").alias("label"), F.inline(cells))
    # rows without a time come last
    return rows.withColumn("_h", F.coalesce(F.floor(F.unix_micros("created_at") / 3_600_000_000), F.lit(2**62)).cast("long"))


def ordered_encoding(
    tickets: DataFrame, label: Column, columns: list[str] | None = None, prior: float = 0.5, weight: float = 1.0,
) -> DataFrame:
    """(ticket_id, feature, value, n_before, encoded): each category value as the mean label of
    the tickets before, in the order of (created_at, ticket_id).

    A row never sees its own or a later label: encoded is (labels before + weight * prior) /
    (n_before + weight), null labels left out. Labels are summed per hour, running totals over
    the hours tell what came before, and rows are put in order within an hour only, so a value
    that a third of all tickets have is no single task's group.
    """
    rows = _labelled_cells(tickets, columns or CLASSIFIER_CATEGORICAL, label)
    known = F.col("label").isNotNull().cast("long")
    earlier = Window.partitionBy("feature", "value").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("feature", "value", "_h").agg(F.sum(known).alias("_n"), F.sum(F.coalesce("label", F.lit(0.0))).alias("_s"))
    hours = hours.select("feature", "value", "_h", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"))
    inside = Window.partitionBy("feature", "value", "_h").orderBy(F.asc_nulls_last("created_at"), "ticket_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_n": F.coalesce(F.sum(known).over(inside), F.lit(0)), "_s": F.coalesce(F.sum("label").over(inside), F.lit(0.0))})
    n = (F.col("_n0") + F.col("_n")).cast("long")
    return rows.join(hours, ["feature", "value", "_h"]).select(
        "ticket_id", "feature", "value", n.alias("n_before"), ((F.col("_s0") + F.col("_s") + weight * prior) / (n + weight)).alias("encoded"))


def target_encoding(tickets: DataFrame, label: Column, columns: list[str] | None = None, prior: float = 0.5, weight: float = 1.0) -> DataFrame:
    """(feature, value, encoded) over all ``tickets``: what tickets that come later are encoded by."""
    rows = _labelled_cells(tickets, columns or CLASSIFIER_CATEGORICAL, label).filter(F.col("label").isNotNull())
    return rows.groupBy("feature", "value").agg(((F.sum("label") + weight * prior) / (F.count("*") + weight)).alias("encoded"))


def scaled_inputs(tickets: DataFrame) -> DataFrame:
    """The 13 numeric columns with mean 0 and population deviation 1."""
    cols = [f"{c}_num" for c in CLASSIFIER_NUMERIC + CLASSIFIER_BOOLEAN]
    df = structured(tickets, [], CLASSIFIER_NUMERIC, CLASSIFIER_BOOLEAN)
    return standardised(df.select("ticket_id", *cols), cols)


def fit_task(train: DataFrame, task: str, trees: int = 50, depth: int = 8, seed: int = 42) -> PipelineModel:
    """One class-weighted forest for a task; ``train`` has ``features`` and labels."""
    label = f"label_{task}"
    weights = class_weights(train, label).select(label, "weight")
    # a row per class, whose names the indexer lists anyway; dealt by label, the rows of a class
    # would be one task's, however many there are
    # a row per class, whose names the indexer lists anyway; dealt by label, the rows of a class
    # would be one task's, however many there are. Every part sends sums of all nodes of all trees,
    # so there are no more parts than cores need
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // PART_ROWS))
    rows = train.select("features", label).join(F.broadcast(weights), label).coalesce(parts)
    indexer = StringIndexer(
        inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    forest = RandomForestClassifier(
        labelCol="_y", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth,
        seed=seed, predictionCol=f"_pred_{task}", probabilityCol=f"_prob_{task}",
        rawPredictionCol=f"_raw_{task}").fit(indexer.transform(rows))
    names = IndexToString(
        inputCol=f"_pred_{task}", outputCol=f"pred_{task}",
        labels=list(indexer.labels) + ["__unseen__"])
    return PipelineModel(stages=[forest, names])


def search_task(train: DataFrame, validation: DataFrame, task: str, grid: dict[str, list]) -> tuple[PipelineModel, dict, float]:
    """Grid search by weighted F1 on the later validation rows, not by shuffled folds."""
    best = None
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        model = fit_task(train, task, **params)
        score = weighted_f1(model.transform(validation), f"label_{task}", f"pred_{task}").first()[0]
        if best is None or score > best[2]:
            best = (model, params, score)
    return best


def task_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def predict(models: dict[str, PipelineModel], features: DataFrame) -> DataFrame:
    """Labels of every task, class probabilities and the category confidence."""
    df = features
    for model in models.values():
        df = model.transform(df)
    out = ["ticket_id", *[f"label_{t}" for t in models]]
    cols = []
    for task, model in models.items():
        names = task_labels(model)
        probs = F.slice(vector_to_array(f"_prob_{task}"), 1, len(names))
        classes = F.array(*[F.lit(n) for n in names])
        pairs = F.filter(F.arrays_zip(classes.alias("c"), probs.alias("p")),
                         lambda z: z["p"].isNotNull() & (z["c"] != "__unseen__"))
        cols += [F.col(f"pred_{task}"), F.map_from_entries(pairs).alias(f"prob_{task}")]
    df = df.select(*out, *cols)
    if "category" in models:
        df = df.withColumn("confidence", F.array_max(F.map_values("prob_category")))
    return df


def feature_names() -> list[str]:
    return [f"emb_{i}" for i in range(EMBEDDING)] + CLASSIFIER_CATEGORICAL + CLASSIFIER_NUMERIC + CLASSIFIER_BOOLEAN


def feature_importance(model: PipelineModel, spark, top_n: int = 30) -> DataFrame:
    weights = [float(w) for w in model.stages[0].featureImportances.toArray()]
    rows = list(zip(feature_names(), weights))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(top_n)


def hours_inputs(tickets: DataFrame) -> DataFrame:
    df = structured(tickets, HOURS_CATEGORICAL, HOURS_NUMERIC, HOURS_BOOLEAN)
    df = with_columns(df, ["created_at", "resolution_time_hours"])
    return df.withColumn("hour_num", F.coalesce(F.hour("created_at"), F.lit(12)).cast("double"))


def fit_hours(tickets: DataFrame, trees: int = 200, depth: int = 5, step: float = 0.1,
              subsample: float = 0.8, seed: int = 42) -> PipelineModel:
    """Boosted trees on log1p(hours) of tickets with a positive resolution time."""
    ensure_checkpoint_dir(tickets.sparkSession)
    nums = [f"{c}_num" for c in HOURS_NUMERIC + HOURS_BOOLEAN] + ["hour_num"]
    rows = hours_inputs(tickets.filter(F.col("resolution_time_hours") > 0)).select(
        F.log1p("resolution_time_hours").alias("_y"), *[f"{c}_code" for c in HOURS_CATEGORICAL], *nums)
    # each of a thousand passes takes as long as its largest part
    rows = dealt(rows)
    return Pipeline(stages=[
        VectorAssembler(inputCols=[f"{c}_code" for c in HOURS_CATEGORICAL] + nums, outputCol="features"),
        GBTRegressor(labelCol="_y", featuresCol="features", predictionCol="_log_hours",
                     maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample,
                     checkpointInterval=20, seed=seed),
    ]).fit(rows)


def predict_hours(model: PipelineModel, tickets: DataFrame) -> DataFrame:
    """Predicted hours and the rough interval [max(0.5, p/2), 2p]."""
    p = F.expm1("_log_hours")
    return model.transform(hours_inputs(tickets)).select(
        "ticket_id", "resolution_time_hours", p.alias("predicted_hours"),
        F.greatest(F.lit(0.5), p * 0.5).alias("low_hours"), (p * 2.0).alias("high_hours"))


def hours_quality(scored: DataFrame) -> DataFrame:
    """Mean absolute error in hours and R² on the log scale, one pass for the moments."""
    y, p = F.log1p("resolution_time_hours"), F.log1p("predicted_hours")
    rows = scored.filter(F.col("resolution_time_hours") > 0)
    return rows.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("resolution_time_hours") - F.col("predicted_hours"))).alias("mae_hours"),
        (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count("*"))).alias("r2"))
