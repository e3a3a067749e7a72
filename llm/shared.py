"""Helpers of the operators: shared tables, fixed-size row filters, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civictext.session import scratch_path

FILTER_BITS = 22  # a row filter is 2**22 bits = 512 KiB, whatever it was built from


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table under the shared checkpoint folder and go on from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def with_columns_set(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with the given columns added, replacing those whose names differ only in case."""
    low = {c.lower() for c in new}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]
    return df.select(*keep, *[v.alias(k) for k, v in new.items()])


def with_row_number(df: DataFrame, name: str, table: str) -> DataFrame:
    """``df`` with a distinct long for every row, written, so that later reads see the same numbers.

    The low bits differ between partitions too, as ``bit_filter`` uses them as a hash.
    """
    x, low = F.monotonically_increasing_id(), (1 << 33) - 1  # partition << 33 | place
    part = F.shiftright(x, 33)
    number = F.shiftleft(part, 33).bitwiseOR((x + part * 2654435761).bitwiseAND(low))
    return saved(df.withColumn(name, number), table)


def bit_filter(keys: DataFrame, col: str) -> np.ndarray:
    """A bitmap of a 64-bit key column: at most 2**22 bits, so a broadcast of it is bounded.

    The words of 64 bits are ORed inside Spark; at most 65,536 of them reach the driver.
    """
    words = (keys.select(F.col(col).bitwiseAND((1 << FILTER_BITS) - 1).alias("s"))
             .groupBy(F.shiftright("s", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).collect())
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for r in words:
        out[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be among those of the bitmap (no false negatives)."""
    s = keys.astype(np.uint64, copy=False) & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root names its connected component.

    Contraction in rounds: each node hooks to its smallest neighbour if that is
    smaller, one pointer jump follows, and the edges move to the new super-nodes;
    loops and repeated edges go. A round at least halves the nodes that still have
    edges, so there are O(log n) rounds; every round is a written table. No node
    list or edge list reaches the driver. ``root`` is a node of the component but
    not always its smallest: callers take their own minimum by a partial aggregate.
    """
    spark = edges.sparkSession
    e = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = saved(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "hook")
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        step = saved(hook.join(up, "p").select("a", F.col("pp").alias("r")), "step")
        steps.append(step)
        right = step.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        e = saved(e.join(step, "a").join(right, "b").where("r <> rb")
                  .select(F.least("r", "rb").alias("a"), F.greatest("r", "rb").alias("b")).distinct(), "edges")
    if not steps:
        return empty_like(spark, "node long, root long")
    out = steps[0].select(F.col("a").alias("node"), F.col("r").alias("root"))
    for step in steps[1:]:
        nxt = step.select(F.col("a").alias("root"), F.col("r").alias("next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return saved(out, "components")
