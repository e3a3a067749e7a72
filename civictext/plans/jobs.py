"""User-level jobs composed from the operators.

* ``analyze`` (C5-C8) -- table in, table out: clean, language, topic, urgency
  and a similarity verdict per row; rule results when no model is given, a
  fitted model's results otherwise; ``unavailable`` when there is no index.
  ``predict_topic``, ``predict_urgency`` and ``similar_news`` give one part each.
* ``ingest_csv`` (S1, P1-P5, C1, C2, S5, S12) -- read a complaints or news CSV,
  discover columns, prepare, write, return a one-row summary.
* ``train_all`` (C3, C4, V1, K*, U*, V2/V3, S10, C9) -- the staged run:
  every stage is written under the output folder and reused if committed; a
  failed optional stage is reported and the rule path stays in use.
* ``bootstrap`` (C10) -- a first run through the generic ingest of one complaints
  and, if there is one, one news file.
"""

from __future__ import annotations

import hashlib
import time
import traceback
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.rules import api_urgency, lowered_text, probability_map, topic_rule, urgency_label_by_batch
from ..operators import prepare as P
from ..operators import similarity as S
from ..operators import topics as T
from ..operators import epochs as E
from ..operators import urgency as U
from ..operators import vectors as V
from ..operators.language import with_script_language
from ..sources import csvfiles as C
from ..sources.store import (checkpoint_table, fingerprint, frame_inputs, is_current, materialize, path_exists, seal, stage, unseal,
                             write_table)


def _with_topic(base: DataFrame, model: T.TopicModel | None, info: DataFrame | None, words: DataFrame | None) -> DataFrame:
    """``base`` with a ``topic`` record; the columns travel through the model, nothing is joined back by key."""
    if model is None:
        r = topic_rule("_low", lowered=True)
        return base.withColumn("topic", F.struct(
            r["topic_id"].alias("topic_id"), r["topic_label"].alias("topic_label"), r["confidence"].alias("confidence"),
            r["top_keywords"].alias("top_keywords"), F.lit("rule-based").alias("method")))
    out = T.predict_topics(model, base, base.columns)
    if info is not None:
        out = T.label_topics(out, info)
    else:
        out = out.withColumn("topic_label", F.lit("Unknown"))
    if words is not None:
        named = T.topic_names(words).select("topic_id", F.split("top_words", r"\|").alias("top_keywords"))
        out = out.join(T._small(named), "topic_id", "left")
    else:
        out = out.withColumn("top_keywords", F.lit(None).cast("array<string>"))
    return out.withColumn("topic", F.struct(
        "topic_id", "topic_label", "confidence", F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"),
        F.lit("kmeans").alias("method"))).select(*base.columns, "topic")


def _with_urgency(base: DataFrame, model) -> DataFrame:
    if model is not None:
        scored = U.predict(model, base)
        return scored.withColumn("urgency", F.struct(F.col("predicted").alias("urgency"), "confidence", "probabilities",
                                                     F.lit("logistic-regression").alias("method"))).select(*base.columns, "urgency")
    u = api_urgency("_low", lowered=True)
    return base.withColumn("urgency", F.struct(u["urgency"].alias("urgency"), u["confidence"].alias("confidence"),
                                               probability_map(u).alias("probabilities"), F.lit("rule-based").alias("method")))


def _no_index(index_key_type: str = "bigint"):
    return F.struct(F.lit(False).alias("is_suspicious"), F.lit(0.0).alias("confidence"), F.lit(0).alias("num_similar"),
                    F.lit(0.0).alias("avg_similarity"),
                    F.array().cast(f"array<struct<id:{index_key_type},score:double,text:string>>").alias("similar"),
                    F.lit(L.REASON_NO_INDEX).alias("reason"), F.lit("unavailable").alias("method"))


@dataclass
class StoredIndex:
    """A saved vector index: rows ``(key, embedding, text[, cell])`` and, for the cell layout, its centroids."""
    rows: DataFrame
    key: str
    text_col: str | None = None
    centroids: np.ndarray | None = None

    def search(self, queries: DataFrame, k: int, threshold: float, query_key: str) -> DataFrame:
        cols = [self.key, "embedding"]
        if self.centroids is not None:
            hits = S.ivf_search(self.rows.select(*cols, "cell"), self.centroids, queries, k=k, threshold=threshold,
                                index_key=self.key, query_key=query_key)
        else:
            hits = S.search(self.rows.select(*cols), queries, k=k, threshold=threshold, index_key=self.key, query_key=query_key)
        return S.attach_text(hits, self.rows, self.key, self.text_col) if self.text_col else hits

    @property
    def method(self) -> str:
        return "cell-search" if self.centroids is not None else "exact-search"


def save_index(rows: DataFrame, path: str, key: str, cells: bool = False) -> None:
    """Write an index of ``(key, embedding, text)`` rows; ``cells`` asks for the approximate cell layout."""
    spark = rows.sparkSession
    if not cells:
        write_table(rows, f"{path}/rows")
        return
    placed, centroids = S.build_ivf(rows.select(key, "embedding"), key=key)
    write_table(placed.select(key, "cell").join(rows, key), f"{path}/rows", partition_by=["cell"])
    table = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]  # one row per cell
    write_table(spark.createDataFrame(table, "cell int, centroid array<double>"), f"{path}/centroids")


def load_index(spark: SparkSession, path: str, key: str, text_col: str | None = "text") -> StoredIndex:
    centroids = None
    if path_exists(spark, f"{path}/centroids"):
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # one row per cell
        centroids = np.array([r["centroid"] for r in rows])
    table = spark.read.parquet(f"{path}/rows")
    return StoredIndex(table, key, text_col if text_col in table.columns else None, centroids)


def _verdict(base: DataFrame, key: str, index: StoredIndex | None, top_k: int, threshold: float) -> DataFrame:
    """``base`` with a ``similarity`` record; only the small verdict rows are joined."""
    if index is None:
        return base.withColumn("similarity", _no_index())
    qv = base.select(key, "embedding")
    hits = index.search(qv, top_k, threshold, key)
    ver = S.verdicts(qv, hits, key, index.key, index.text_col)
    ver = ver.select(key, F.struct("is_suspicious", "confidence", "num_similar", "avg_similarity", "similar", "reason",
                                   F.lit(index.method).alias("method")).alias("similarity"))
    return base.join(ver, key, "left")


def _base(df: DataFrame, key: str, text_col: str, embed: bool) -> DataFrame:
    base = P.with_clean_text(df.select(key, text_col), text_col)
    base = lowered_text(with_script_language(base, "clean_text", "language"))
    if embed:
        base = base.withColumn("embedding", V.hashed_embedding(F.col("clean_text")))
        # the cleaned, tagged and embedded rows feed the output, the models, the search's size
        # check and the verdicts: write them once instead of re-running the chain per use
        base = checkpoint_table(df.sparkSession, base, "analysis-base")
    return base


def analyze(df: DataFrame, key: str, text_col: str = "text", index: StoredIndex | DataFrame | None = None,
            index_key: str = "doc_id", topic_model: T.TopicModel | None = None, topic_info: DataFrame | None = None,
            topic_words: DataFrame | None = None, urgency_model=None,
            top_k: int = L.MISINFO_TOP_K, threshold: float = L.MISINFO_THRESHOLD) -> DataFrame:
    """One output row per input row with nested ``topic``, ``urgency`` and ``similarity`` records.

    ``topic_info`` and ``topic_words`` name a topic model's topics; ``index`` is a stored index or
    a table ``(index_key, embedding[, text])``.
    """
    if isinstance(index, DataFrame):
        index = StoredIndex(index, index_key, "text" if "text" in index.columns else None)
    base = _base(df, key, text_col, index is not None or topic_model is not None)
    out = _with_urgency(_with_topic(base, topic_model, topic_info, topic_words), urgency_model)
    out = _verdict(out, key, index, top_k, threshold)
    return out.select(key, text_col, "clean_text", "language", "topic", "urgency", "similarity")


def predict_topic(df: DataFrame, key: str, text_col: str = "text", model: T.TopicModel | None = None,
                  info: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Topic record per row: the model's, or the rules' without one."""
    out = _with_topic(_base(df, key, text_col, model is not None), model, info, words)
    return out.select(key, text_col, "clean_text", "topic.*")


def predict_urgency(df: DataFrame, key: str, text_col: str = "text", model=None) -> DataFrame:
    """Urgency record per row: the model's, or the rules' without one."""
    return _with_urgency(_base(df, key, text_col, False), model).select(key, text_col, "clean_text", "urgency.*")


def similar_news(df: DataFrame, key: str, index: StoredIndex | None, text_col: str = "text",
                 top_k: int = L.MISINFO_TOP_K, threshold: float = L.MISINFO_THRESHOLD) -> DataFrame:
    """Similarity verdict per row with its hits ``(id, score, text)``; ``unavailable`` without an index."""
    out = _verdict(_base(df, key, text_col, index is not None), key, index, top_k, threshold)
    return out.select(key, text_col, "clean_text", "similarity.*")


def analysis_json(analysis: DataFrame, key: str) -> DataFrame:
    """The nested record of each row as one JSON document."""
    return analysis.select(key, F.to_json(F.struct(*[c for c in analysis.columns if c != key])).alias("record"))


def ingest_csv(spark: SparkSession, path: str, kind: str = "complaints", out_path: str | None = None,
               min_length: int = 10, max_length: int | None = None, multi_line: bool = True) -> DataFrame:
    """Read, discover, prepare and (optionally) write a CSV; returns the one-row summary.

    The file is read once into a table under the checkpoint folder; discovery, preparation and
    both counts use that table.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if "." in name and not name.endswith(".csv"):
        raise ValueError("Only CSV files are supported")
    raw = checkpoint_table(spark, C.read_csv(spark, path, multi_line=multi_line).withColumn("row_id", F.monotonically_increasing_id()), "csv-rows")
    text_col, label_col = C.discover_columns(raw, kind)
    prepared = P.prepare(raw, text_col, label_col, key="row_id", min_length=min_length, max_length=max_length)
    if out_path:
        write_table(prepared, out_path)
        prepared = spark.read.parquet(out_path)
    n_in = raw.agg(F.count(F.lit(1)).alias("original_rows"))
    n_out = prepared.agg(F.count(F.lit(1)).alias("processed_rows"))
    return n_in.unionByName(n_out, allowMissingColumns=True).agg(
        F.lit(f"Processed {kind}").alias("message"),
        F.max("original_rows").alias("original_rows"), F.max("processed_rows").alias("processed_rows"),
        F.lit(text_col).alias("text_column"), F.lit(label_col).cast("string").alias("label_column"),
        F.lit(len(prepared.columns)).alias("n_columns"), F.array(*[F.lit(c) for c in prepared.columns]).alias("columns"),
        F.lit(out_path).cast("string").alias("saved_to"))


def prepare_complaints(complaints: DataFrame, cap: int | None = None) -> DataFrame:
    """C3: composite text of the 311 columns, cleaned and labelled; all other columns stay. ``cap`` samples rows."""
    raw = P.drop_null_rows(complaints, ["Category", "Request Details"])
    if cap is not None:
        raw = P.seeded_sample(raw, cap, "row_id")
    t = raw.withColumn("text", P.composite_complaint_text())
    c = lowered_text(with_script_language(P.with_clean_text(t, "text", min_length=20), "clean_text", "language"))
    return c.withColumn("urgency", urgency_label_by_batch("_low")).drop("_low").withColumnsRenamed(
        {c: c.replace(" ", "_").lower() for c in complaints.columns})


def prepare_news(news: DataFrame, per_label: int | None = None, max_chars: int | None = None) -> DataFrame:
    """C4: title and text, cleaned, length filter, keep-first dedup. ``per_label`` samples, ``max_chars`` cuts."""
    s = news if per_label is None else P.per_class_sample(news, "label", per_label, "row_id")
    t = s.withColumn("full_text", P.composite_news_text("title", "text")).select("row_id", "label", "full_text")
    c = P.with_clean_text(t, "full_text", min_length=30, max_length=max_chars, truncate_first=True)
    return P.keep_first(c, ["clean_text"], "row_id")


class Stages:
    """Runs named stages and keeps ``(stage, status, rows, seconds)``; a failed optional stage is reported, not raised."""

    def __init__(self) -> None:
        self.report: list[tuple] = []

    def run(self, name: str, fn, optional: bool = True):
        t0 = time.time()
        try:
            res = fn()
            rows = res.count() if isinstance(res, DataFrame) else None
            self.report.append((name, "ok", rows, round(time.time() - t0, 2)))
            return res
        except Exception as e:  # a failed optional stage leaves the rule path in use
            if not optional:
                raise
            self.report.append((name, f"failed: {type(e).__name__}: {str(e)[:200]}", None, round(time.time() - t0, 2)))
            traceback.print_exc()
            return None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.report, "stage string, status string, rows long, seconds double")


def with_texts(emb: DataFrame, prepared: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row_id, embedding, text)`` of an embedding table and the prepared table that it was made of.

    A vector's text is stored beside it, and where ids are unique that is the row that the join by id
    finds: texts and vectors are then read once instead of being shuffled. Otherwise they are joined.
    """
    n, ids = emb.agg(F.count(F.lit(1)), F.count_distinct("row_id")).first()  # a missing id is not counted
    if n == ids:
        return emb.select("row_id", "embedding", F.col("text").alias(text_col))
    return emb.select("row_id", "embedding").join(prepared.select("row_id", F.col("clean_text").alias(text_col)), "row_id")


def _vector_stages(spark: SparkSession, run: Stages, prepared: DataFrame, name: str, out_dir: str, cells: bool) -> DataFrame | None:
    """Embedding table and index of one prepared table; both are reused when committed."""
    emb = run.run(f"{name}_embeddings", lambda: stage(
        spark, f"{out_dir}/{name}_embeddings",
        lambda: prepared.select("row_id", V.hashed_embedding(F.col("clean_text")).cast("array<float>").alias("embedding"),
                                F.col("clean_text").alias("text")),
        {"texts": True}, frame_inputs(prepared)))

    def index():
        path = f"{out_dir}/{name}_index"
        mark = fingerprint(spark, {"cells": cells}, frame_inputs(emb))
        if not is_current(spark, path, mark):
            unseal(spark, path)
            save_index(with_texts(emb, prepared), path, "row_id", cells)
            seal(spark, path, mark)
        return load_index(spark, path, "row_id").rows

    if emb is not None:  # without embeddings the run goes on and reports what it has
        run.run(f"{name}_index", index)
    return emb


def train_all(spark: SparkSession, complaints: DataFrame, news: DataFrame | None, out_dir: str,
              complaint_cap: int | None = None, news_half: int | None = None, training_rows: int = 500,
              min_topic_size: int = 15, n_topics: int = 20, cells: bool = False) -> DataFrame:
    """Staged training run; returns ``(stage, status, rows, seconds)`` rows.

    ``complaints`` has ``row_id`` and the four 311 columns; ``news`` has
    ``row_id, title, text, label`` (optional). Stages are skipped when their
    output is committed and was made with the same parameters from the same inputs (the files
    behind the tables, the outputs of the stages before). Every row is used; ``complaint_cap`` and
    ``news_half`` sample when given. The classifier is fitted on at most
    ``training_rows`` labelled rows (a documented bound, raised by the caller at
    will). ``cells`` stores the indexes in the approximate cell layout. The chains after the
    prepared complaints run side by side, so the stages' ``seconds`` overlap.
    """
    run = Stages()
    out_dir = out_dir.rstrip("/")
    prepared = run.run("complaints", lambda: stage(spark, f"{out_dir}/complaints", lambda: prepare_complaints(complaints, complaint_cap),
                                                   {"cap": complaint_cap}, frame_inputs(complaints)), optional=False)

    def news_stages():
        table = run.run("news", lambda: stage(spark, f"{out_dir}/news", lambda: prepare_news(news, news_half), {"half": news_half}, frame_inputs(news)))
        if table is not None:
            _vector_stages(spark, run, table, "news", out_dir, cells)

    def topic_stage(emb):
        path = f"{out_dir}/topic_model"
        mark = fingerprint(spark, {"topics": n_topics, "least": min_topic_size}, frame_inputs(emb))
        if is_current(spark, path, mark):
            return T.TopicModel.load(spark, path).mapping
        unseal(spark, path)
        tm = T.fit_topics(emb, "embedding", n_topics=n_topics, min_topic_size=min_topic_size)
        tm.save(path)
        assigned = T.predict_topics(tm, with_texts(emb, prepared, "clean_text"), ["row_id", "clean_text"])
        assigned = checkpoint_table(spark, assigned, "assigned-topics")
        words = T.class_term_weights(assigned, "topic_id", "clean_text")
        write_table(words, f"{path}/words")
        write_table(T.topic_info(assigned, spark.read.parquet(f"{path}/words")), f"{path}/info")
        seal(spark, path, mark)
        return tm.mapping

    def complaint_stages():
        emb = _vector_stages(spark, run, prepared, "complaint", out_dir, cells)
        if emb is not None:
            run.run("topics", lambda: topic_stage(emb))

    def urgency_stage():
        path = f"{out_dir}/urgency_model"
        mark = fingerprint(spark, {"rows": training_rows}, frame_inputs(prepared))
        if is_current(spark, path, mark):
            return spark.read.parquet(f"{path}/metrics")
        unseal(spark, path)
        rows = P.seeded_sample(prepared.select("row_id", "clean_text", "urgency").na.drop(), training_rows, "row_id")
        model, test = E.train_epochs(rows, "clean_text", "urgency", key="row_id",
                                     state=f"{path}/state-{hashlib.sha256(mark.encode()).hexdigest()[:16]}")  # an interrupted training goes on
        U.save(model, f"{path}/model")
        write_table(U.evaluate(U.predict(model, test), "urgency", "predicted"), f"{path}/metrics")
        seal(spark, path, mark)
        return spark.read.parquet(f"{path}/metrics")

    # three chains that do not read each other's outputs: small jobs of one fill the cores that another leaves idle
    chains = [complaint_stages, lambda: run.run("urgency_model", urgency_stage)] + ([news_stages] if news is not None else [])
    with ThreadPoolExecutor(len(chains)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(chain)) for chain in chains]:
            done.result()
    return run.table(spark)


def bootstrap(spark: SparkSession, complaints_csv: str, news_csv: str | None, out_dir: str,
              complaint_cap: int | None = None, news_cap: int | None = None) -> DataFrame:
    """First run through the generic ingest (with dedup) of a complaints file and, if given, a news file.

    Complaints get rule urgency labels; both tables get embeddings and a searchable index.
    Every row is used unless a cap is given. Returns the stage report.
    """
    run = Stages()
    out_dir = out_dir.rstrip("/")

    def ingest(path: str, kind: str, cap: int | None):
        def build():
            ingest_csv(spark, path, kind, f"{out_dir}/{kind}_ingested").count()
            table = spark.read.parquet(f"{out_dir}/{kind}_ingested")
            table = P.seeded_sample(table, cap, "row_id") if cap is not None else table
            if kind != "complaints":
                return table
            return lowered_text(table).withColumn("urgency", urgency_label_by_batch("_low")).drop("_low")
        return materialize(spark, kind, build, f"{out_dir}/{kind}")

    complaints = run.run("complaints", lambda: ingest(complaints_csv, "complaints", complaint_cap), optional=False)
    _vector_stages(spark, run, complaints, "complaint", out_dir, False)
    if news_csv is not None:
        news = run.run("news", lambda: ingest(news_csv, "news", news_cap))
        if news is not None:
            _vector_stages(spark, run, news, "news", out_dir, False)
    return run.table(spark)
