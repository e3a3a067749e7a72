"""Sampling, splitting, weights, dedup and accounting on hand-made tables."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from civictext.operators import prepare as P
from civictext.operators.urgency import class_weights


def labels4(spark):
    rows, i = [], 0
    for lab, n in (("LOW", 40), ("MEDIUM", 30), ("HIGH", 20), ("CRITICAL", 10)):
        for _ in range(n):
            rows.append((i, lab))
            i += 1
    return spark.createDataFrame(rows, "row_id long, urgency string")


def test_stratified_split_sizes(spark):
    s = P.stratified_split(labels4(spark), "urgency", "row_id")
    got = {r.urgency: r.n for r in s.where("is_test").groupBy("urgency").agg(F.count("*").alias("n")).collect()}
    assert got == {"LOW": 8, "MEDIUM": 6, "HIGH": 4, "CRITICAL": 2}


def test_class_weights_balanced(spark):
    got = {r.urgency: r.weight for r in class_weights(labels4(spark), "urgency").collect()}
    assert got == {"LOW": 0.625, "MEDIUM": 0.8333, "HIGH": 1.25, "CRITICAL": 2.5}


def test_seeded_sample_exact_size_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in P.seeded_sample(df, 37, "k").collect()]
    b = [r.k for r in P.seeded_sample(df, 37, "k").collect()]
    assert len(a) == 37 and sorted(a) == sorted(b)
    assert P.seeded_sample(df, 5000, "k").count() == 1000  # at or below the cap: whole table


def test_per_class_sample_cap(spark):
    s = P.per_class_sample(labels4(spark), "urgency", 15, "row_id")
    got = {r.urgency: r.n for r in s.groupBy("urgency").agg(F.count("*").alias("n")).collect()}
    assert got == {"LOW": 15, "MEDIUM": 15, "HIGH": 15, "CRITICAL": 10}


def test_keep_first_keeps_smallest_key(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "row_id long, clean_text string, o string")
    got = sorted((r.row_id, r.o) for r in P.keep_first(df, ["clean_text"], "row_id").collect())
    assert got == [(1, "y"), (2, "z")]


def test_prepare_filter_truncate_dedup(spark):
    long = "word " * 1000
    df = spark.createDataFrame([(1, "short"), (2, long), (3, long + " tail"), (4, None), (5, "a valid complaint text")],
                               "row_id long, Descriptor string")
    out = P.prepare(df, "Descriptor", key="row_id", min_length=10, max_length=512)
    rows = {r.row_id: r for r in out.collect()}
    assert set(rows) == {2, 5}  # 1 short, 4 is "nan", 3 equals 2 after truncation to 2560 chars
    assert len(rows[2].clean_text) == 2560 and rows[2].language == "en"


def test_prepare_label_rename_clash(spark):
    df = spark.createDataFrame([(1, "a long enough complaint", "x", "L")],
                               "row_id long, Descriptor string, text string, Category string")
    out = P.prepare(df, "Descriptor", "Category", key="row_id")
    assert {"text", "text_orig", "label"} <= set(out.columns)


def test_first_in_seeded_order_equals_window_rank_with_coarse_buckets(spark):
    # 2-bit buckets put hundreds of rows in each cut bucket, so the boundary ranking is exercised
    df = labels4(spark)
    rank = F.row_number().over(Window.partitionBy("urgency").orderBy(P.seeded_hash("row_id"), "row_id"))
    size = F.count(F.lit(1)).over(Window.partitionBy("urgency"))
    ref = df.select("row_id", "urgency", rank.alias("rk"), size.alias("n_class"))
    for n in (1, 7, 15, 40):
        got = {r.row_id for r in P.first_in_seeded_order(df, "row_id", n=n, label="urgency", bits=2).collect()}
        assert got == {r.row_id for r in ref.where(F.col("rk") <= n).collect()}
    flagged = P.first_in_seeded_order(df, "row_id", fraction=0.2, label="urgency", bits=2, flag="t")
    got = {r.row_id: r.t for r in flagged.collect()}
    want = {r.row_id: r.rk <= math.ceil(0.2 * r.n_class) for r in ref.collect()}
    assert got == want
    whole = spark.range(500).withColumnRenamed("id", "k")
    top = {r.k for r in whole.orderBy(P.seeded_hash("k"), "k").limit(123).collect()}
    assert {r.k for r in P.first_in_seeded_order(whole, "k", n=123, bits=3).collect()} == top
    assert P.first_in_seeded_order(whole, "k", n=0, bits=3).count() == 0


def test_first_in_seeded_order_null_class_is_a_class(spark):
    rows = [(i, None if i % 3 == 0 else "a") for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, c string")
    got = P.first_in_seeded_order(df, "row_id", n=5, label="c", bits=1)
    counts = {r.c: r.n for r in got.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {None: 5, "a": 5}


def test_first_in_seeded_order_limits_at_the_edges(spark):
    df = labels4(spark)
    assert P.first_in_seeded_order(df, "row_id", fraction=0.0, label="urgency", flag="t").where("t").count() == 0
    assert P.first_in_seeded_order(df, "row_id", n=1000, label="urgency").count() == 100  # all classes under n
    assert P.first_in_seeded_order(df, "row_id", n=1000, label="urgency", flag="t").where("t").count() == 100
    assert P.first_in_seeded_order(df, "row_id", fraction=1.0, label="urgency", flag="t", bits=2).where("t").count() == 100


def test_dense_row_ids_are_dense_on_a_million_permuted_keys(spark):
    # range bounds are sampled anew by each execution: counts and rows must come from one written table
    n = 1_000_000
    df = spark.range(n).select(((F.col("id") * 7919 + 13) % n).alias("k"))
    got = P.dense_row_ids(df, "k", partitions=8)
    row = got.agg(F.count("*").alias("n"), F.min("row_num").alias("lo"), F.max("row_num").alias("hi"),
                  F.sum(F.when(F.col("row_num") != F.col("k"), 1).otherwise(0)).alias("off")).first()
    assert (row.n, row.lo, row.hi, row.off) == (n, 0, n - 1, 0)


def test_prepare_keeps_whole_texts_by_default(spark):
    long = "word " * 2000
    df = spark.createDataFrame([(1, long + "a"), (2, long + "b")], "row_id long, text string")
    got = [r.clean_text for r in P.prepare(df, "text", key="row_id").orderBy("row_id").collect()]
    assert got == [long + "a", long + "b"]  # equal in their first 2,560 characters, both kept
    cut = P.prepare(df, "text", key="row_id", max_length=512).collect()
    assert len(cut) == 1 and len(cut[0].clean_text) == 2560
