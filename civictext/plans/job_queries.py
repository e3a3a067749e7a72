"""Registered composite jobs: full analysis, CSV ingest, stored index, staged training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import similarity as S
from ..functions.rules import lowered_text, urgency_label
from ..sources.store import checkpoint_table, load_embeddings, save_embeddings
from ..sources.tables import read_table
from ..session import scratch_path
from . import jobs as J
from .registry import query
from .sqltext import q, sql_api_urgency_field, sql_clean, sql_script_language, sql_topic_field
from .text_queries import FREQUENT_LEXICON, PREP_SQL, complaints_311, prepared_documents
from .vector_queries import DOC_SEARCH_SQL, benchmark_vectors, document_vectors


def _flatten(a, key: str):
    return a.select(
        key, "clean_text", "language",
        F.col("topic.topic_id").alias("topic_id"), F.col("topic.topic_label").alias("topic_label"),
        F.col("topic.confidence").alias("topic_confidence"), F.col("topic.method").alias("topic_method"),
        F.col("urgency.urgency").alias("urgency"), F.col("urgency.confidence").alias("urgency_confidence"),
        F.col("urgency.probabilities")["LOW"].alias("p_low"),
        F.col("urgency.probabilities")["CRITICAL"].alias("p_critical"),
        F.col("similarity.is_suspicious").alias("is_suspicious"),
        F.col("similarity.confidence").alias("similarity_confidence"),
        F.col("similarity.num_similar").alias("num_similar"), F.col("similarity.reason").alias("reason"),
        F.col("similarity.method").alias("similarity_method"))


def _sql_rule_fields(text: str) -> str:
    return f"""{sql_script_language(text)} AS language,
       {sql_topic_field(text, 'topic_id')} AS topic_id, {sql_topic_field(text, 'topic_label')} AS topic_label,
       {sql_topic_field(text, 'confidence')} AS topic_confidence, 'rule-based' AS topic_method,
       {sql_api_urgency_field(text, 'urgency')} AS urgency,
       {sql_api_urgency_field(text, 'confidence')} AS urgency_confidence,
       {sql_api_urgency_field(text, 'p_low')} AS p_low, {sql_api_urgency_field(text, 'p_critical')} AS p_critical"""


def document_index(spark, sf_dir) -> J.StoredIndex:
    """The document index, written once and searched from its files."""
    v = document_vectors(spark, sf_dir, materialize=True).select("doc_id", "embedding", F.col("clean_text").alias("text"))
    return J.StoredIndex(v, "doc_id", "text")


# --- C8 (+C5, C6, C7, J7): full analysis of benchmark passages against the document index ---
@query("full_analysis", f"""{DOC_SEARCH_SQL},
h AS (SELECT item_id, round(score, 4) AS score FROM r WHERE rank <= {L.MISINFO_TOP_K} AND score >= {L.MISINFO_THRESHOLD}),
a AS (SELECT item_id, count(*) AS num_similar, max(score) AS mx, avg(score) AS av FROM h GROUP BY item_id),
bq AS (SELECT item_id, {sql_clean('text')} AS clean_text FROM benchmark)
SELECT bq.item_id, bq.clean_text, {_sql_rule_fields('bq.clean_text')},
       coalesce(mx > {L.MISINFO_MAX_SUSPICIOUS} OR (num_similar >= {L.MISINFO_MIN_HITS_FOR_AVG}
                AND av > {L.MISINFO_AVG_SUSPICIOUS}), false) AS is_suspicious,
       coalesce(round(mx, 4), 0.0) AS similarity_confidence, coalesce(num_similar, 0) AS num_similar,
       CASE WHEN num_similar IS NULL THEN {q(L.REASON_NO_HITS)}
            WHEN mx > {L.MISINFO_MAX_SUSPICIOUS} OR (num_similar >= {L.MISINFO_MIN_HITS_FOR_AVG}
                 AND av > {L.MISINFO_AVG_SUSPICIOUS}) THEN {q(L.REASON_SUSPICIOUS)}
            ELSE {q(L.REASON_ORIGINAL)} END AS reason,
       'exact-search' AS similarity_method
FROM bq LEFT JOIN a ON a.item_id = bq.item_id""")
def full_analysis(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    index = document_index(spark, sf_dir)
    return _flatten(J.analyze(b, "item_id", "text", index=index, index_key="doc_id"), "item_id")


# --- C5, C6 with no index: rules only, similarity "unavailable" ------------------------------------
@query("page_analysis_no_index", f"""
WITH pc AS (SELECT page_id, {sql_clean('html')} AS clean_text FROM pages)
SELECT page_id, clean_text, {_sql_rule_fields('clean_text')},
       false AS is_suspicious, CAST(0.0 AS DOUBLE) AS similarity_confidence, 0 AS num_similar, {q(L.REASON_NO_INDEX)} AS reason,
       'unavailable' AS similarity_method
FROM pc""")
def page_analysis_no_index(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", ["page_id", "html"])
    return _flatten(J.analyze(p, "page_id", "html"), "page_id")


# --- X4: nested record as JSON (rows-only: JSON formatting differs between engines) ---------------
@query("analysis_records_json")
def analysis_records_json(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    index = document_index(spark, sf_dir)
    return J.analysis_json(J.analyze(b, "item_id", "text", index=index, index_key="doc_id"), "item_id")


# --- S1, S5, S12, C2, P1-P5: CSV written from documents, ingested back -----------------------------
@query("csv_ingest_summary", f"""WITH {PREP_SQL}
SELECT 'Processed complaints' AS message, (SELECT count(*) FROM documents) AS original_rows,
       (SELECT count(*) FROM d) AS processed_rows, 'text' AS text_column, 'Category' AS label_column,
       8 AS n_columns""")
def csv_ingest_summary(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    path = scratch_path(spark, "documents-csv")
    _write_csv(d.withColumnRenamed("source", "Category"), path)
    s = J.ingest_csv(spark, path, "complaints")
    return s.select("message", "original_rows", "processed_rows", "text_column", "label_column", "n_columns")


# --- S6, S7, V2: embeddings stored as a table, reloaded, searched ----------------------------------
@query("stored_index_search", f"""{DOC_SEARCH_SQL}
SELECT item_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r
WHERE rank <= {L.SEARCH_TOP_K} AND score >= {L.SEARCH_THRESHOLD}""")
def stored_index_search(spark, sf_dir):
    path = scratch_path(spark, "doc-embeddings")
    save_embeddings(document_vectors(spark, sf_dir).select("doc_id", "embedding"), path, key="doc_id")
    index = load_embeddings(spark, path)
    return S.search(index, benchmark_vectors(spark, sf_dir), k=L.SEARCH_TOP_K, threshold=L.SEARCH_THRESHOLD,
                    index_key="doc_id", query_key="item_id")


# --- C7: similar news as a job of its own, hits with id, score and text ---------------------------------
@query("similar_documents", f"""{DOC_SEARCH_SQL},
h AS (SELECT r.item_id, r.doc_id, round(r.score, 4) AS score, r.rank, d.clean_text FROM r JOIN d ON d.doc_id = r.doc_id
      WHERE rank <= {L.MISINFO_TOP_K} AND score >= {L.MISINFO_THRESHOLD})
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id AS id, score, clean_text AS text FROM h""")
def similar_documents(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    found = J.similar_news(b, "item_id", document_index(spark, sf_dir))
    return found.select("item_id", F.posexplode("similar").alias("rank", "h")).select(
        "item_id", (F.col("rank") + 1).alias("rank"), "h.id", "h.score", "h.text")


# --- C2 news kind: CSV written from labelled documents, ingested as news ------------------------------------
def _labelled_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return d.join(lab, "doc_id").select("doc_id", F.col("source").alias("title"), "text",
                                        F.when(F.col("toxic") == 1, "FAKE").otherwise("REAL").alias("label"))


def _write_csv(df, path: str) -> str:
    (df.write.option("header", "true").option("escape", '"').option("quoteAll", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return path


NEWS_ROWS_SQL = """news AS (SELECT d.doc_id, d.source AS title, d.text, CASE WHEN l.toxic = 1 THEN 'FAKE' ELSE 'REAL' END AS label
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query("news_csv_ingest", f"""WITH {NEWS_ROWS_SQL},
c AS (SELECT {sql_clean('text')} AS clean_text FROM news)
SELECT 'Processed news' AS message, (SELECT count(*) FROM news) AS original_rows,
       (SELECT count(DISTINCT clean_text) FROM c WHERE length(clean_text) >= 10) AS processed_rows,
       'text' AS text_column, 'label' AS label_column, 7 AS n_columns, 'clean_text|doc_id|label|language|row_id|text|title' AS columns""")
def news_csv_ingest(spark, sf_dir):
    path = _write_csv(_labelled_documents(spark, sf_dir), scratch_path(spark, "news-csv"))
    s = J.ingest_csv(spark, path, "news", out_path=scratch_path(spark, "news-table"))
    return s.select("message", "original_rows", "processed_rows", "text_column", "label_column", "n_columns",
                    F.array_join(F.array_sort("columns"), "|").alias("columns"))


# --- S2, S3, C4: two files with one layout, each tagged with its label, then the news preparation -----------
@query("fake_true_csv_prepare", f"""WITH {NEWS_ROWS_SQL},
c AS (SELECT doc_id, label, {sql_clean("coalesce(title, '') || '. ' || coalesce(text, '')")} AS clean_text FROM news),
f AS (SELECT * FROM c WHERE length(clean_text) >= 30)
SELECT doc_id, label, clean_text FROM f QUALIFY row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) = 1""")
def fake_true_csv_prepare(spark, sf_dir):
    from ..sources.csvfiles import read_labelled_pair
    rows = _labelled_documents(spark, sf_dir)
    files = [_write_csv(rows.where(F.col("label") == label).drop("label"), scratch_path(spark, f"{label.lower()}-csv"))
             for label in ("FAKE", "REAL")]
    news = read_labelled_pair(spark, *files, columns=["doc_id", "title", "text"])
    out = J.prepare_news(news.withColumn("row_id", F.col("doc_id").cast("long")))
    return out.select(F.col("row_id").alias("doc_id"), "label", "clean_text")


# --- U1-U6, X2, W4: model urgency of every prepared document (rows-only: model scores) -----------------------
@query("urgency_predictions")
def urgency_predictions(spark, sf_dir):
    from ..operators import urgency as U
    prep = labelled_urgency(spark, sf_dir)
    model, _ = U.train(prep, "clean_text", "urgency", key="row_id")
    p = U.predict(model, prep.drop("urgency"))
    probs = [F.col("probabilities")[c].alias(f"p_{c.lower()}") for c in U.label_order(model)]
    return p.select(F.col("row_id").alias("doc_id"), "predicted", "confidence", *probs)


def labelled_urgency(spark, sf_dir, prepared=None):
    """Rule urgency of the prepared documents, written; ``prepared``: ``(doc_id, clean_text)`` that a query already has."""
    prep = lowered_text(prepared if prepared is not None else prepared_documents(spark, sf_dir, detect_lang=False))
    lab = prep.select(F.col("doc_id").alias("row_id"), "clean_text", urgency_label("_low", FREQUENT_LEXICON, lowered=True).alias("urgency"))
    return checkpoint_table(spark, lab, "labelled-urgency")


# --- C8 with both models (rows-only: model scores) ----------------------------------------------------------------
@query("full_analysis_with_models")
def full_analysis_with_models(spark, sf_dir):
    from ..operators import topics as T
    from ..operators import urgency as U
    vecs = document_vectors(spark, sf_dir, materialize=True)
    tm = T.fit_topics(vecs, "embedding", n_topics=8, dims=5, min_topic_size=15)
    assigned = checkpoint_table(spark, T.predict_topics(tm, vecs, ["doc_id", "clean_text"]), "assigned-topics")
    words = checkpoint_table(spark, T.class_term_weights(assigned, "topic_id", "clean_text"), "topic-words")
    model, _ = U.train(labelled_urgency(spark, sf_dir, vecs.select("doc_id", "clean_text")), "clean_text", "urgency", key="row_id")  # prepared once
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    index = J.StoredIndex(vecs.select("doc_id", "embedding", F.col("clean_text").alias("text")), "doc_id", "text")
    return _flatten(J.analyze(b, "item_id", "text", index=index, topic_model=tm, topic_info=T.topic_info(assigned, words),
                              topic_words=words, urgency_model=model), "item_id")


# --- C9, S8, S9, S10: staged training run; its stage counts are plain counts -------------------------------------
@query("staged_training_run", f"""WITH raw AS (SELECT d.source AS category, CAST(l.quality AS VARCHAR) AS request_type, d.text AS details,
                    CAST(l.toxic AS VARCHAR) AS neighborhood FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
cc AS (SELECT {sql_clean("coalesce(category, 'nan') || ' - ' || coalesce(request_type, 'nan') || ' - ' || coalesce(details, 'nan') || ' at ' || coalesce(neighborhood, 'Unknown')")}
              AS clean_text FROM raw WHERE category IS NOT NULL AND details IS NOT NULL),
{NEWS_ROWS_SQL},
nc AS (SELECT {sql_clean("coalesce(title, '') || '. ' || coalesce(text, '')")} AS clean_text FROM news),
n AS (SELECT (SELECT count(*) FROM cc WHERE length(clean_text) >= 20) AS complaints,
             (SELECT count(DISTINCT clean_text) FROM nc WHERE length(clean_text) >= 30) AS news)
SELECT 'complaints' AS stage, 'ok' AS status, complaints AS rows FROM n
UNION ALL SELECT 'news', 'ok', news FROM n
UNION ALL SELECT 'complaint_embeddings', 'ok', complaints FROM n UNION ALL SELECT 'complaint_index', 'ok', complaints FROM n
UNION ALL SELECT 'news_embeddings', 'ok', news FROM n UNION ALL SELECT 'news_index', 'ok', news FROM n
UNION ALL SELECT 'topics', 'ok', 8 UNION ALL SELECT 'urgency_model', 'ok', 1""")
def staged_training_run(spark, sf_dir):
    complaints = complaints_311(spark, sf_dir).withColumnRenamed("doc_id", "row_id")
    news = _labelled_documents(spark, sf_dir).withColumnRenamed("doc_id", "row_id")
    return _report(spark, J.train_all(spark, complaints, news, scratch_path(spark, "training-run"), n_topics=8))


def _report(spark, report):
    return checkpoint_table(spark, report, "stage-report").select("stage", "status", "rows")


# --- C10: first run through the generic ingest; news are optional -----------------------------------------------------
@query("bootstrap_run", f"""WITH {PREP_SQL},
{NEWS_ROWS_SQL},
nc AS (SELECT {sql_clean('text')} AS clean_text FROM news),
n AS (SELECT (SELECT count(*) FROM d) AS complaints, (SELECT count(DISTINCT clean_text) FROM nc WHERE length(clean_text) >= 10) AS news)
SELECT 'complaints' AS stage, 'ok' AS status, complaints AS rows FROM n
UNION ALL SELECT 'complaint_embeddings', 'ok', complaints FROM n UNION ALL SELECT 'complaint_index', 'ok', complaints FROM n
UNION ALL SELECT 'news', 'ok', news FROM n
UNION ALL SELECT 'news_embeddings', 'ok', news FROM n UNION ALL SELECT 'news_index', 'ok', news FROM n""")
def bootstrap_run(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]).withColumnRenamed("source", "Category")
    complaints = _write_csv(d, scratch_path(spark, "complaints-csv"))
    news = _write_csv(_labelled_documents(spark, sf_dir), scratch_path(spark, "news-csv"))
    return _report(spark, J.bootstrap(spark, complaints, news, scratch_path(spark, "bootstrap")))


# --- C5, C6: one part each, by the rules -----------------------------------------------------------------------------
@query("predict_topic_and_urgency", f"""
WITH c AS (SELECT conv_id, turn, {sql_clean('text')} AS clean_text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {sql_topic_field('clean_text', 'topic_label')} AS topic_label, {sql_api_urgency_field('clean_text', 'urgency')} AS urgency FROM c""")
def predict_topic_and_urgency(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).where("role = 'user'")
    c = c.select(F.struct("conv_id", "turn").alias("at"), "text")
    topic = J.predict_topic(c, "at").select("at", "topic_label")
    urgency = J.predict_urgency(c, "at").select("at", "urgency")
    return topic.join(urgency, "at").select("at.conv_id", "at.turn", "topic_label", "urgency")
