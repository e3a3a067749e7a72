"""Streaming results equal the batch answer; late rows beyond the watermark are dropped."""

import os
import tempfile

from pyspark.sql import functions as F

from civictext.streaming import live


def test_window_counts_with_late_data(spark):
    d = tempfile.mkdtemp(prefix="civictext-stream-")
    batches = [
        [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:05:00", "b")],
        [("2024-01-01 03:00:00", "a")],                            # advances the watermark to 02:00
        [("2024-01-01 02:30:00", "a"), ("2024-01-01 00:30:00", "a")],  # late inside / outside the watermark
    ]
    src = os.path.join(d, "in")
    path = os.path.join(d, "out")
    schema = "ts timestamp, k string"
    for i, rows in enumerate(batches):  # one arriving file per run; each run restarts from the checkpoint
        spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts")) \
            .coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(schema).parquet(src)
        counts = live.live_counts(s, "ts", "k", window="1 hour", watermark="1 hour")
        live.run_to_table(spark, counts, "late-test", output_mode="update", path=path)
    final = {(str(r.window_start), r.k): r.n for r in live.latest_per_key(spark.read.parquet(path),
                                                                           ["window_start", "k"]).collect()}
    assert final[("2024-01-01 00:00:00", "a")] == 2   # the 00:30 row came after the watermark passed 01:00
    assert final[("2024-01-01 02:00:00", "a")] == 1   # late but inside the watermark: counted
    assert final[("2024-01-01 03:00:00", "a")] == 1


def test_stream_dedup_does_not_depend_on_the_micro_batches(spark):
    import __spark_entry__ as E
    out = E.queries()["stream_dedup_texts"](spark, "/root/testdata/sf0.001")  # four files, one a micro-batch
    from civictext.functions.text import clean_text
    from civictext.sources.tables import read_table
    batch = read_table(spark, "/root/testdata/sf0.001", "documents", ["text"]).select(F.md5(clean_text(F.col("text"))).alias("text_hash"))
    assert out.count() == batch.distinct().count() and out.exceptAll(batch.distinct()).count() == 0


def test_dedup_within_watermark_drops_repeats_inside_it(spark):
    d = tempfile.mkdtemp(prefix="civictext-stream-")
    src, path = os.path.join(d, "in"), os.path.join(d, "out")
    batches = [[("2024-01-01 00:00:00", "x"), ("2024-01-01 00:10:00", "x")], [("2024-01-01 00:30:00", "x")],
               [("2024-01-01 05:00:00", "y")], [("2024-01-01 05:30:00", "x")]]
    for rows in batches:
        spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("ts timestamp, k string").parquet(src)
        live.run_to_table(spark, live.dedup_within_watermark(s, ["k"], "ts", "1 hour"), "within", path=path)
    got = sorted((str(r.ts)[11:16], r.k) for r in spark.read.parquet(path).collect())
    # x is dropped while its state lasts and comes again once the watermark has passed it
    assert got == [("00:00", "x"), ("05:00", "y"), ("05:30", "x")]


def test_a_table_of_several_files_is_a_stream(spark, tmp_path):
    import __spark_entry__ as E
    texts = [(i, f"Broken pipe number {i % 7} floods the road", "en", "web", 40) for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = E.queries()["stream_rule_analysis"](spark, str(tmp_path))
    assert sorted((r.doc_id, r.topic_id, r.urgency) for r in out.collect()) == [(i, 0, "CRITICAL") for i in range(30)]


def test_arriving_files_are_bounded(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    from civictext.plans import stream_queries as Q
    from civictext.sources.store import stored_bytes
    texts = [(i, f"text {i} " + " ".join(str(j * i) for j in range(200))) for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(Q, "STREAM_FILE_BYTES", 20_000)
    made = []
    stream = Q.live.file_stream
    monkeypatch.setattr(Q.live, "file_stream", lambda s, folder, *a, **b: made.append((folder, b)) or stream(s, folder, *a, **b))
    assert E.queries()["stream_dedup_texts"](spark, str(tmp_path)).count() == 400
    folder, more = made[0]
    files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert len(files) == 4 * more["max_files_per_trigger"] and more["max_files_per_trigger"] > 1
    assert stored_bytes(spark, folder) / len(files) < 40_000
