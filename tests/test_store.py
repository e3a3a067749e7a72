"""Stages that notice changed parameters and inputs; the calendar trend; one reduction of vectors."""

import datetime as dt

from pyspark.sql import functions as F

from civictext.operators import reports as R
from civictext.sources import store as S


def test_only_what_depends_on_a_change_is_rebuilt(spark, tmp_path):
    built = []
    source = f"{tmp_path}/source"

    def run(cap=10):
        def one():
            built.append("one")
            return spark.read.parquet(source).limit(cap)

        def two():
            built.append("two")
            return spark.read.parquet(f"{tmp_path}/one").withColumn("x", F.col("id") * 2)

        def other():
            built.append("other")
            return spark.range(3)

        S.stage(spark, f"{tmp_path}/one", one, {"cap": cap}, [source])
        S.stage(spark, f"{tmp_path}/other", other, {"n": 3})
        return S.stage(spark, f"{tmp_path}/two", two, inputs=[f"{tmp_path}/one"]).count()

    def seen():
        out, built[:] = list(built), []
        return out

    spark.range(20).write.parquet(source)
    assert run() == 10 and seen() == ["one", "other", "two"]
    assert run() == 10 and seen() == []  # all reused
    assert run(cap=5) == 5 and seen() == ["one", "two"]
    spark.range(3).write.mode("overwrite").parquet(source)
    assert run(cap=5) == 3 and seen() == ["one", "two"]
    S.write_table(spark.range(1), f"{tmp_path}/two_manifest", fmt="csv")  # a manifest that says something else
    assert run(cap=5) == 3 and seen() == ["two"]


def test_days_without_rows_count_zero(spark):
    day = lambda d: dt.datetime(2024, 1, d, 12)
    rows = [(day(1), "a"), (day(1), "a"), (day(4), "a"), (day(2), "b"), (day(2), None), (day(3), None), (None, "a")]
    got = sorted(((str(r.k), r.day.day, r.n, r.change) for r in R.calendar_trend(spark.createDataFrame(rows, "ts timestamp, k string"), "ts", "k").collect()))
    assert got == [("None", 2, 1, None), ("None", 3, 1, 0), ("a", 1, 2, None), ("a", 2, 0, -2), ("a", 3, 0, 0), ("a", 4, 1, 1), ("b", 2, 1, None)]
    assert R.calendar_trend(spark.createDataFrame([], "ts timestamp, k string"), "ts", "k").count() == 0
