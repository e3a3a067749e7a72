"""Structured Streaming versions of the per-text jobs.

* ``rule_analysis`` (ST1) -- stateless: clean, tag language, rule topic and
  urgency per arriving text; same column expressions as the batch jobs.
* ``verdict_batches`` (ST2) -- per micro-batch (``foreachBatch``) the batch
  search + verdict job runs against the index table; ranking per query is not
  a streaming operator, so it runs on each micro-batch as a batch job.
* ``live_counts`` (ST3) -- event-time windows (tumbling or sliding) with a
  watermark; state for a window is dropped once the watermark passes it.
* ``dedup_within_watermark`` (ST4) -- repeated keys dropped while their state
  is inside the watermark (bounded state, unlike a plain ``dropDuplicates``).

``run_to_table`` drives a stream to completion over the available input
(``availableNow``) into a parquet table in the shared checkpoint folder, with
the stream's own checkpoint next to it, so a restarted job resumes exactly.
Update-mode aggregates are written per micro-batch with the batch id; the
latest row per key is the final value (``latest_per_key``).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import topic_rule, urgency_label
from ..functions.text import clean_text
from ..operators.language import with_script_language
from ..session import scratch_path
from ..sources.store import is_folder


def file_stream(spark: SparkSession, folder: str, file_glob: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``folder`` (matching ``file_glob``) as a stream.

    A match that is a folder itself (a table written by Spark) gives the files in it.
    The schema is taken from the files present now (a stream needs it fixed).
    """
    path = f"{folder.rstrip('/')}/{file_glob}"
    if is_folder(spark, path):
        folder, file_glob = path, "*.parquet"
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def rule_analysis(stream: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    c = clean_text(F.coalesce(F.col(text_col), F.lit("nan")))
    t = topic_rule("_low", lowered=True)
    tagged = with_script_language(stream.select(*keep, c.alias("clean_text")), "clean_text", "language")
    return (tagged.withColumn("_low", F.lower("clean_text"))
            .select(*keep, "clean_text", "language",
                    t["topic_id"].alias("topic_id"), t["topic_label"].alias("topic_label"),
                    urgency_label("_low", lowered=True).alias("urgency")))


def with_event_time(stream: DataFrame, ts_col: str, out: str = "event_time") -> DataFrame:
    """Event time as TIMESTAMP (zone-less source timestamps are read in the session zone)."""
    return stream.withColumn(out, F.col(ts_col).cast("timestamp"))


def live_counts(stream: DataFrame, time_col: str, class_col: str, window: str = "1 day", slide: str | None = None,
                watermark: str = "1 hour") -> DataFrame:
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return (stream.withWatermark(time_col, watermark)
            .groupBy(w.alias("w"), F.col(class_col))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), class_col, "n"))


def dedup_within_watermark(stream: DataFrame, keys: list[str], time_col: str, watermark: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(keys)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, output_mode: str = "append",
                 batch_fn: Callable[[DataFrame, int], DataFrame] | None = None, path: str | None = None) -> str:
    """Run ``stream`` over all available input into a parquet table; returns its path.

    With ``batch_fn`` each micro-batch is transformed by a batch job first.
    Update/complete modes and ``batch_fn`` go through ``foreachBatch`` and tag
    rows with ``batch_id``. Passing the same ``path`` again resumes from the
    stream's checkpoint (offsets, watermark and state survive the restart).
    """
    out = path or scratch_path(spark, f"stream-{name}")
    ckpt = os.path.join(out + "-checkpoint")
    w = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).outputMode(output_mode)
    if batch_fn is None and output_mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            # one folder per micro-batch, overwritten on retry: a re-run batch
            # replaces its own output instead of appending a second copy
            res = batch_fn(batch, batch_id) if batch_fn else batch
            res.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

        q = w.foreachBatch(write).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


def latest_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest micro-batch per key (final value of an update-mode aggregate)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "batch_id")
