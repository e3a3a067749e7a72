"""Supervised urgency (or any text-class) model on Spark ML.

Label coding sorts labels alphabetically (as the reference's encoder does);
class weights are balanced ``n / (k * n_c)`` from the training rows only; the
model is a multinomial logistic regression on hashed TF-IDF features with a
weight column; the best regularisation is kept by weighted F1 on a held-out
validation split. Probabilities are mapped to labels in the model's own label
order, so each probability carries its true label. ``epochs`` has the same
model trained in epochs; ``predict``, ``save`` and ``load`` take both.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (HashingTF, IDF, IndexToString, RegexTokenizer, SQLTransformer, StringIndexer,
                                StringIndexerModel)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import TOKEN_PATTERN
from ..sources.store import path_exists
from .epochs import EpochModel, predict_epochs

NUM_FEATURES = 1 << 16
MAX_PARALLEL_FITS = 2  # fits of the grid at a time: one's sums run while the other's tasks leave cores idle
MAX_BROADCAST_CLASSES = 100_000  # class weight rows allowed in a broadcast


def class_weights(train: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``(label, n, weight)`` with balanced weights ``n_total / (k * n_class)``, rounded to 4."""
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return g.withColumn(out, F.round(F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")), 4))


def with_class_weights(train: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach each row's class weight; the one-row-per-class table is broadcast under a row-count check."""
    cw = class_weights(train, label, out).drop("n")
    return train.join(F.broadcast(cw) if cw.count() <= MAX_BROADCAST_CLASSES else cw, label)


def build_pipeline(text_col: str = "clean_text", label_col: str = "urgency", weight_col: str = "weight",
                   reg_param: float = 0.01, max_iter: int = 100, max_tokens: int | None = None,
                   labels: StringIndexerModel | None = None) -> Pipeline:
    """Feature, label and model stages; ``max_tokens`` cuts each text's tokens (off by default).

    ``labels``: a label coding already fitted, so that a validation split may hold a class its
    training part lacks.
    """
    tok = RegexTokenizer(inputCol=text_col, outputCol="_all_tokens", pattern=TOKEN_PATTERN, gaps=False,
                         toLowercase=True)
    used = f"slice(_all_tokens, 1, {max_tokens})" if max_tokens else "_all_tokens"
    cut = SQLTransformer(statement=f"SELECT *, {used} AS _tokens FROM __THIS__")
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=NUM_FEATURES)
    idf = IDF(inputCol="_tf", outputCol="features")
    idx = labels or label_indexer(label_col)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol=weight_col, family="multinomial",
                            regParam=reg_param, maxIter=max_iter, tol=1e-6)
    return Pipeline(stages=[tok, cut, tf, idf, idx, lr])


def label_indexer(label_col: str) -> StringIndexer:
    # "error", not "keep": an extra class for unseen labels would be one more output of the model
    return StringIndexer(inputCol=label_col, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error")


def train(df: DataFrame, text_col: str = "clean_text", label_col: str = "urgency", key: str = "row_id",
          reg_params=(0.001, 0.01), seed: int = L.SEED, max_iter: int = 50) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training split; returns (best model, test rows).

    The stratified 80/20 split and the class weights are Spark jobs. The split
    is written once under the shared checkpoint folder, so the iterative fits
    read a short lineage instead of recomputing the preparation every pass.
    The regularisation is chosen by weighted F1 on a validation split of the
    training rows.
    """
    from ..sources.store import checkpoint_table
    from .prepare import stratified_split

    spark = df.sparkSession
    # the split reads its input three times: materialise the (usually prepared) input once
    rows = checkpoint_table(spark, df.select(key, text_col, label_col), "urgency-input")
    split = checkpoint_table(spark, stratified_split(rows, label_col, key, 0.2, seed), "urgency-split")
    tr = with_class_weights(split.where(~F.col("is_test")), label_col)
    te = split.where(F.col("is_test"))
    pipe = build_pipeline(text_col, label_col, max_iter=max_iter, labels=label_indexer(label_col).fit(tr))
    *texts, idf, coded, lr = pipe.getStages()
    # the texts are tokenised once and their term counts written; the weights' fit, the grid and its validation read those
    counts = checkpoint_table(spark, PipelineModel(texts).transform(tr).select("_tf", label_col, "weight"), "urgency-terms")
    weights = idf.fit(counts)
    features = PipelineModel([*texts, weights, coded])
    rows = PipelineModel([weights, coded]).transform(counts).select("features", "label", "weight")
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()
    if len(grid) == 1:
        return PipelineModel([*features.stages, lr.copy(grid[0]).fit(rows)]), te
    ev = MulticlassClassificationEvaluator(metricName="weightedFMeasure", labelCol="label")
    tvs = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=ev, trainRatio=0.8, seed=seed,
                               parallelism=min(len(grid), MAX_PARALLEL_FITS))
    return PipelineModel([*features.stages, tvs.fit(rows).bestModel]), te


def label_order(model: PipelineModel | EpochModel) -> list[str]:
    """The labels in the order of the model's outputs."""
    if isinstance(model, EpochModel):
        return list(model.labels)
    return list(next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels)


def save(model: PipelineModel | EpochModel, path: str) -> None:
    if isinstance(model, EpochModel):
        model.save(SparkSession.getActiveSession(), f"{path}/epochs")
        return
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | EpochModel:
    """A saved model; its label order is stored with it."""
    spark = SparkSession.getActiveSession()
    if path_exists(spark, f"{path}/epochs"):
        return EpochModel.load(spark, f"{path}/epochs")
    return PipelineModel.load(path)


def predict(model: PipelineModel | EpochModel, df: DataFrame, out: str = "predicted") -> DataFrame:
    """Add predicted label, confidence (max probability) and a label -> probability map.

    Rows need no label; an existing label column is left as it is.
    """
    if isinstance(model, EpochModel):
        return predict_epochs(model, df, out)
    labels = label_order(model)
    scored = PipelineModel([s for s in model.stages if not isinstance(s, StringIndexerModel)]).transform(df)
    to_label = IndexToString(inputCol="prediction", outputCol=out, labels=labels)
    scored = to_label.transform(scored)
    p = vector_to_array(F.col("probability"))
    return (scored.withColumn("confidence", F.round(F.array_max(p), 4))
            .withColumn("probabilities",
                        F.map_from_arrays(F.array(*[F.lit(x) for x in labels]),
                                          F.transform(p, lambda v: F.round(v, 4))))
            .drop("_all_tokens", "_tokens", "_tf", "features", "rawPrediction", "probability"))


def confusion(pred: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    return pred.groupBy(F.col(label_col).alias("actual"), F.col(pred_col).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def evaluate(pred: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """Accuracy and weighted F1 from confusion-matrix aggregates (rows ``metric, value``)."""
    cm = confusion(pred, label_col, pred_col)
    per_actual = cm.groupBy("actual").agg(F.sum("n").alias("support"),
                                          F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                                                .otherwise(0)).alias("tp"))
    per_pred = cm.groupBy(F.col("predicted").alias("actual")).agg(F.sum("n").alias("pred_n"))
    cls = per_actual.join(per_pred, "actual", "left").fillna(0, subset=["pred_n"])
    f1 = F.when(F.col("support") + F.col("pred_n") > 0, 2 * F.col("tp") / (F.col("support") + F.col("pred_n")))
    return cls.agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
        F.sum("support").alias("n"))
