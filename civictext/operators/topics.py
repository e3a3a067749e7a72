"""Topic discovery and description.

* ``class_term_weights`` -- class-based TF-IDF: a term's frequency in a class,
  L1-normalised by the class's word total, times ``ln(1 + A / f(t))`` where
  ``A`` is the (integer) mean word total per class and ``f(t)`` the term's
  frequency over all classes. Top words per class by ``row_number()``.
  Everything is an aggregate over ``explode``d tokens: partial aggregation
  collapses each partition to (class, term) counts before the shuffle.
* ``fit_topics`` -- reduce (PCA) then cluster (KMeans); clusters smaller than
  ``min_topic_size`` become the outlier topic -1 and the rest are renumbered by
  size, largest first. ``predict_topics`` applies the fitted model to new rows
  with soft-max probabilities over negative centroid distances.
* ``topic_info`` / ``label_topics`` / ``top_topics`` -- counts, names of the
  form ``<id>_<w1>_<w2>_<w3>_<w4>``, label lookup with ``Unknown`` default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import tokens

TOPIC_WORDS = 10
NAME_WORDS = 4
MIN_TOKEN_LENGTH = 2


MAX_BROADCAST_ROWS = 100_000  # class or topic tables up to this size are broadcast


def _small(table: DataFrame) -> DataFrame:
    """A broadcast hint for a one-row-per-class table, under a row-count check."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table


def class_term_weights(df: DataFrame, class_col: str, text_col: str, top_n: int | None = TOPIC_WORDS,
                       min_token_length: int = MIN_TOKEN_LENGTH) -> DataFrame:
    """``(class, word, weight, rank)``: the top ``top_n`` words of each class by class TF-IDF."""
    from ..sources.store import checkpoint_table

    toks = df.select(F.col(class_col).alias("_class"), F.explode(tokens(F.col(text_col))).alias("word"))
    toks = toks.where(F.length("word") >= min_token_length)
    # (class, word) counts feed the totals, the word frequencies and the weights: written once
    # (vocabulary x classes rows), so the texts are prepared and tokenised once
    tf = checkpoint_table(df.sparkSession, toks.groupBy("_class", "word").agg(F.count(F.lit(1)).alias("tf")), "class-terms")
    per_class = tf.groupBy("_class").agg(F.sum("tf").alias("class_total"))
    freq = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    # A: mean over the per-class totals (one row per class)
    stats = per_class.withColumn("A", F.floor(F.avg("class_total").over(Window.partitionBy())))
    w = (tf.join(_small(stats), "_class")
         .join(freq, "word")
         .select("_class", "word",
                 ((F.col("tf") / F.col("class_total")) * F.log(1 + F.col("A") / F.col("f"))).alias("weight")))
    win = Window.partitionBy("_class").orderBy(F.desc("weight"), F.asc("word"))
    ranked = w.withColumn("rank", F.row_number().over(win))
    if top_n is not None:
        ranked = ranked.where(F.col("rank") <= top_n)
    return ranked.select(F.col("_class").alias(class_col), "word", F.round("weight", 4).alias("weight"), "rank")


def topic_names(words: DataFrame, topic_col: str = "topic_id", n_words: int = NAME_WORDS) -> DataFrame:
    """``(topic_id, name, top_words)`` with ``name = <id>_<w1>_..._<wn>``."""
    g = words.groupBy(topic_col).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("_w"))
    ws = F.transform("_w", lambda s: s["word"])
    return g.select(topic_col,
                    F.concat_ws("_", F.col(topic_col).cast("string"), F.slice(ws, 1, n_words)).alias("name"),
                    F.array_join(ws, "|").alias("top_words"))


def topic_info(assigned: DataFrame, words: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """``(topic_id, count, name)`` for every topic present, the outlier topic included."""
    counts = assigned.groupBy(topic_col).agg(F.count(F.lit(1)).alias("count"))
    names = topic_names(words, topic_col)
    return counts.join(_small(names.select(topic_col, "name")), topic_col, "left").select(
        topic_col, "count", F.coalesce("name", F.concat(F.col(topic_col).cast("string"), F.lit("_"))).alias("name"))


def top_topics(info: DataFrame, n: int = 20, topic_col: str = "topic_id") -> DataFrame:
    """The ``n`` largest topics (a top-n report), ties by topic id."""
    return info.orderBy(F.desc("count"), F.asc(topic_col)).limit(n)


def label_topics(df: DataFrame, info: DataFrame, topic_col: str = "topic_id", out: str = "topic_label") -> DataFrame:
    """Attach topic names; unknown ids get ``Unknown``. The info table is one row per topic."""
    names = _small(info.select(topic_col, F.col("name").alias(out)))
    return df.join(names, topic_col, "left").withColumn(out, F.coalesce(F.col(out), F.lit("Unknown")))


@dataclass
class TopicModel:
    model: PipelineModel
    mapping: DataFrame  # (cluster, topic_id), one row per cluster
    vec_col: str

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.mapping.write.mode("overwrite").parquet(f"{path}/mapping")

    @staticmethod
    def load(spark, path: str, vec_col: str = "embedding") -> "TopicModel":
        return TopicModel(PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/mapping"), vec_col)


def fit_topics(df: DataFrame, vec_col: str = "embedding", n_topics: int = 20, dims: int = 5,
               min_topic_size: int = 15, seed: int = L.SEED, max_iter: int = 30) -> TopicModel:
    """Reduce with PCA to ``dims``, cluster with KMeans into ``n_topics`` (the topic cap),
    send clusters below ``min_topic_size`` to -1, renumber the rest by size."""
    feats = df.select(array_to_vector(F.col(vec_col)).alias("_vec"))
    pipe = Pipeline(stages=[
        PCA(k=dims, inputCol="_vec", outputCol="_reduced"),
        KMeans(k=n_topics, seed=seed, featuresCol="_reduced", predictionCol="cluster", maxIter=max_iter),
    ])
    model = pipe.fit(feats)
    sizes = model.transform(feats).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    from ..sources.store import checkpoint_table
    return TopicModel(model, checkpoint_table(df.sparkSession, renumber(sizes, min_topic_size), "topic-mapping"), vec_col)


def reduce_vectors(df: DataFrame, vec_col: str = "embedding", dims: int = 5) -> DataFrame:
    """``df`` with its vectors reduced to ``dims`` principal components."""
    feats = df.withColumn("_vec", array_to_vector(F.col(vec_col)))
    out = PCA(k=dims, inputCol="_vec", outputCol="_reduced").fit(feats).transform(feats)
    return out.withColumn(vec_col, vector_to_array("_reduced")).drop("_vec", "_reduced")


def renumber(sizes: DataFrame, min_topic_size: int) -> DataFrame:
    """``(cluster, topic_id)`` from ``(cluster, size)``: small clusters -1, the others 0.. by size, largest first."""
    w = Window.partitionBy(F.col("size") >= min_topic_size).orderBy(F.desc("size"), F.asc("cluster"))  # one row per cluster
    number = F.when(F.col("size") >= min_topic_size, F.row_number().over(w) - 1).otherwise(-1)
    return sizes.select("cluster", number.cast("int").alias("topic_id"))


def predict_topics(tm: TopicModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns + ``topic_id``, ``confidence`` and ``probabilities``.

    ``probabilities``: the soft-max over negative centroid distances, one number per
    cluster in cluster order; ``confidence``: its maximum. A cluster that held no row at
    fit time has no topic and is the outlier topic -1.
    """
    feats = df.select(*keep, array_to_vector(F.col(tm.vec_col)).alias("_vec"))
    km = tm.model.stages[-1]
    centers = [list(map(float, c)) for c in km.clusterCenters()]  # n_topics x dims
    out = tm.model.transform(feats)
    red = vector_to_array(F.col("_reduced"))
    dists = [F.sqrt(F.aggregate(F.zip_with(red, F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b)),
                                F.lit(0.0), lambda acc, x: acc + x)) for c in centers]
    m = F.least(*dists) if len(dists) > 1 else dists[0]
    denom = sum((F.exp(m - d) for d in dists[1:]), F.exp(m - dists[0]))
    conf = F.round(F.lit(1.0) / denom, 4)
    probs = F.array(*[F.round(F.exp(m - d) / denom, 4) for d in dists])
    scored = out.select(*keep, "cluster", conf.alias("confidence"), probs.alias("probabilities"))
    return (scored.join(_small(tm.mapping), "cluster", "left")
            .withColumn("topic_id", F.coalesce("topic_id", F.lit(-1))).drop("cluster")
            .select(*keep, "topic_id", "confidence", "probabilities"))


def centroid_distances(tm: TopicModel, spark) -> DataFrame:
    """``(topic_a, topic_b, distance)`` between the centroids of the kept topics (at most k * k rows)."""
    import math

    topic = {r["cluster"]: r["topic_id"] for r in tm.mapping.collect()}  # one row per cluster
    centers = [(topic.get(i, -1), list(map(float, c))) for i, c in enumerate(tm.model.stages[-1].clusterCenters())]
    rows = [(a, b, round(math.dist(x, y), 6)) for a, x in centers for b, y in centers if 0 <= a < b]
    return spark.createDataFrame(rows, "topic_a int, topic_b int, distance double")


def topic_word_chart(info: DataFrame, words: DataFrame, n_topics: int = 8, topic_col: str = "topic_id") -> DataFrame:
    """Chart rows: the words (and weights) of the ``n_topics`` largest topics, outliers excluded."""
    top = top_topics(info.where(F.col(topic_col) != -1), n_topics, topic_col).select(topic_col)
    return words.join(F.broadcast(top), topic_col)  # at most n_topics keys
