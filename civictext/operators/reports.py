"""Report aggregates: distributions, rollups, trends and pivots.

All are hash aggregates with partial (map-side) aggregation; the only
whole-table windows run over already-aggregated, class-sized results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: numeric weight of each urgency label for mean-urgency reports.
# ---------------------------------------------------------------------------
URGENCY_WEIGHT = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def distribution(df: DataFrame, *cols: str, count_col: str = "n", share_col: str = "share") -> DataFrame:
    """Counts per class with the share of the total (rounded to 4 places)."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count_col))
    return g.withColumn(share_col, F.round(F.col(count_col) / F.sum(count_col).over(Window.partitionBy()), 4))


def rollup_counts(df: DataFrame, col: str, total_label: str = "TOTAL", count_col: str = "n") -> DataFrame:
    """Counts per class plus a grand-total row."""
    return (df.rollup(col).agg(F.count(F.lit(1)).alias(count_col), F.grouping(col).alias("_g"))
            .select(F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col(col)).alias(col), count_col))


def urgency_weight(c) -> "F.Column":
    col = F.col(c) if isinstance(c, str) else c
    out = None
    for k, v in URGENCY_WEIGHT.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out


def topic_volume(df: DataFrame, topic_col: str = "topic_id", urgency_col: str = "urgency") -> DataFrame:
    """Per topic: row count and mean urgency weight."""
    return df.groupBy(topic_col).agg(F.count(F.lit(1)).alias("n"),
                                     F.round(F.avg(urgency_weight(urgency_col)), 4).alias("mean_urgency"))


def daily_trend(df: DataFrame, ts_col: str, class_col: str) -> DataFrame:
    """Count per class per day and the change against the class's previous day."""
    daily = (df.groupBy(F.to_date(F.col(ts_col)).alias("day"), F.col(class_col))
             .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(class_col).orderBy("day")
    return daily.withColumn("change", F.col("n") - F.lag("n").over(w))


def calendar_trend(df: DataFrame, ts_col: str, class_col: str) -> DataFrame:
    """Count per class on every calendar day from its first to its last, and the change against the day before.

    Days without rows count 0, so the change of a day after a gap is against 0, not against the last day with rows. The days
    between are made from each class's first and last day, a range of dates for each class.
    """
    daily = (df.where(F.col(ts_col).isNotNull()).groupBy(F.col(class_col), F.to_date(F.col(ts_col)).alias("day"))
             .agg(F.count(F.lit(1)).alias("n")))
    span = daily.groupBy(class_col).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    same = F.col("s." + class_col).eqNullSafe(F.col("d." + class_col)) & (F.col("s.day") == F.col("d.day"))
    full = span.alias("s").join(daily.alias("d"), same, "left").select(F.col("s.day"), F.col("s." + class_col), F.coalesce("d.n", F.lit(0)).cast("long").alias("n"))
    w = Window.partitionBy(class_col).orderBy("day")
    return full.withColumn("change", F.col("n") - F.lag("n").over(w))


def pivot_counts(df: DataFrame, row_col: str, pivot_col: str, values: list[str]) -> DataFrame:
    """Counts of ``row_col`` x ``pivot_col`` with explicit pivot values (one aggregation pass)."""
    return df.groupBy(row_col).pivot(pivot_col, values).agg(F.count(F.lit(1))).na.fill(0, subset=values)


def report(df: DataFrame, *class_cols: str) -> DataFrame:
    """The summary of a prepared table: ``(section, class, n, share)`` for its row count and each class column.

    One grouping-sets aggregate over the rows, so the table is read once.
    """
    found = df.groupingSets([[], *[[c] for c in class_cols]], *class_cols).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*class_cols).alias("_g")) if class_cols else df.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("_g"))
    k = len(class_cols)
    full = (1 << k) - 1
    section, value = F.lit("rows"), F.lit("all")
    for i, c in enumerate(class_cols):
        only = F.col("_g") == full - (1 << (k - 1 - i))
        section, value = F.when(only, F.lit(c)).otherwise(section), F.when(only, F.coalesce(F.col(c).cast("string"), F.lit("(null)"))).otherwise(value)
    total = F.max("n").over(Window.partitionBy())
    return found.select(section.alias("section"), value.alias("class"), "n", F.round(F.col("n") / total, 4).alias("share"))


def index_sizes(**tables: DataFrame) -> DataFrame:
    """Rows ``(index_name, size)``: the row count of each named index table."""
    out = None
    for n, t in tables.items():
        d = t.agg(F.lit(n).alias("index_name"), F.count(F.lit(1)).alias("size"))
        out = d if out is None else out.unionByName(d)
    return out
