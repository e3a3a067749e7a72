"""Registered streaming queries: each drives a file stream over a driver table to
completion and returns the written result, which must equal the batch answer."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import similarity as S
from ..operators import vectors as V
from ..functions.text import clean_text
from ..operators.prepare import with_clean_text
from ..session import scratch_path
from ..sources.store import checkpoint_table, stored_bytes
from ..sources.tables import table_path
from ..streaming import live
from .registry import query
from .sqltext import sql_clean, sql_script_language, sql_topic_field, sql_urgency
from .vector_queries import DOC_SEARCH_SQL, document_vectors


# --- ST1: per-text rule analysis of a text stream -----------------------------------------
@query("stream_rule_analysis", f"""
WITH c AS (SELECT doc_id, {sql_clean('text')} AS clean_text FROM documents)
SELECT doc_id, {sql_script_language('clean_text')} AS language, {sql_topic_field('clean_text', 'topic_id')} AS topic_id,
       {sql_urgency('clean_text')} AS urgency
FROM c""")
def stream_rule_analysis(spark, sf_dir):
    s = live.file_stream(spark, sf_dir, "documents.parquet")
    out = live.rule_analysis(s.select("doc_id", "text"), "text", ["doc_id"])
    path = live.run_to_table(spark, out.select("doc_id", "language", "topic_id", "urgency"), "rules")
    return spark.read.parquet(path)


# --- ST3: windowed live counts with a watermark ----------------------------------------------
@query("stream_window_counts", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n
FROM events GROUP BY 1, 2""")
def stream_window_counts(spark, sf_dir):
    s = live.with_event_time(live.file_stream(spark, sf_dir, "events.parquet"), "ts")
    counts = live.live_counts(s, "event_time", "event_type", window="1 day", watermark="1 hour")
    path = live.run_to_table(spark, counts, "window-counts", output_mode="update")
    final = live.latest_per_key(spark.read.parquet(path), ["window_start", "event_type"])
    return final.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                        "event_type", "n")


@query("stream_sliding_counts", """
WITH k AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS b0, ts, event_type FROM events),
s AS (SELECT b0 - INTERVAL 6 HOUR * i AS ws, event_type FROM k, range(4) t(i))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM s GROUP BY 1, 2""")
def stream_sliding_counts(spark, sf_dir):
    s = live.with_event_time(live.file_stream(spark, sf_dir, "events.parquet"), "ts")
    counts = live.live_counts(s, "event_time", "event_type", window="1 day", slide="6 hours", watermark="1 hour")
    path = live.run_to_table(spark, counts, "sliding-counts", output_mode="update")
    final = live.latest_per_key(spark.read.parquet(path), ["window_start", "event_type"])
    return final.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                        "event_type", "n")


# --- ST4: repeated texts of a text stream, over several micro-batches ------------------------------
STREAM_FILES = 4  # micro-batches
STREAM_FILE_BYTES = 8 << 20  # of the table, in one arriving file


@query("stream_dedup_texts", f"""
SELECT DISTINCT md5({sql_clean('text')}) AS text_hash FROM documents""")
def stream_dedup_texts(spark, sf_dir):
    """Each distinct text once. Arriving texts have no event time, so a text's state is kept for the
    run of the stream: the answer does not depend on how the files fall into micro-batches."""
    d = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    folder = scratch_path(spark, "arriving-texts")
    # a micro-batch has as many files as its share of the table needs, so that no task writes or reads more than one of bounded size
    each = max(1, math.ceil(stored_bytes(spark, table_path(sf_dir, "documents")) / (STREAM_FILES * STREAM_FILE_BYTES)))
    d.repartition(STREAM_FILES * each).write.parquet(folder)
    s = live.file_stream(spark, folder, "*.parquet", max_files_per_trigger=each)
    hashed = s.select(F.md5(clean_text(F.coalesce(F.col("text"), F.lit("nan")))).alias("text_hash"))
    path = live.run_to_table(spark, hashed.dropDuplicates(["text_hash"]), "dedup")
    return spark.read.parquet(path)


# --- ST2: misinformation verdicts for a stream of passages, per micro-batch ------------------------
@query("stream_misinformation", f"""{DOC_SEARCH_SQL},
h AS (SELECT item_id, round(score, 4) AS score FROM r WHERE rank <= {L.MISINFO_TOP_K} AND score >= {L.MISINFO_THRESHOLD}),
a AS (SELECT item_id, count(*) AS num_similar, max(score) AS mx, avg(score) AS av FROM h GROUP BY item_id)
SELECT b.item_id,
       coalesce(mx > {L.MISINFO_MAX_SUSPICIOUS} OR (num_similar >= {L.MISINFO_MIN_HITS_FOR_AVG}
                AND av > {L.MISINFO_AVG_SUSPICIOUS}), false) AS is_suspicious,
       coalesce(round(mx, 4), 0.0) AS confidence, coalesce(num_similar, 0) AS num_similar
FROM benchmark b LEFT JOIN a ON a.item_id = b.item_id""")
def stream_misinformation(spark, sf_dir):
    # the index is a stored table: each micro-batch reads it instead of rebuilding the vectors
    index = document_vectors(spark, sf_dir, materialize=True).select("doc_id", "embedding")

    def per_batch(batch, batch_id):
        c = with_clean_text(batch.select("item_id", "text"), "text")
        qv = checkpoint_table(spark, c.select("item_id", V.hashed_embedding(F.col("clean_text")).alias("embedding")),
                              "batch-vectors")
        hits = S.search(index, qv, k=L.MISINFO_TOP_K, threshold=L.MISINFO_THRESHOLD, index_key="doc_id",
                        query_key="item_id")
        return S.verdicts(qv, hits, "item_id", "doc_id").select("item_id", "is_suspicious", "confidence",
                                                               "num_similar")

    s = live.file_stream(spark, sf_dir, "benchmark.parquet")
    path = live.run_to_table(spark, s, "misinformation", batch_fn=per_batch)
    return spark.read.parquet(path).drop("batch_id")
