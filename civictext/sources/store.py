"""Sinks and stage reuse: parquet tables, embedding tables, materialised stages.

Intermediate results go to the shared folder named by ``spark.checkpoint.dir``
(never a machine-local temp folder), so a lost executor only re-runs the tasks
of the current stage and the next stage reads a written table instead of the
whole lineage.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

SUCCESS = "_SUCCESS"
MANIFEST = "_manifest"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite",
                fmt: str = "parquet") -> str:
    """Write a table (parquet by default, csv with header on request)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    else:
        w.parquet(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system (local, ``file:``, HDFS, object store)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder in its own file system; a pattern is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def is_complete(spark: SparkSession, path: str) -> bool:
    """A stage output counts as present only when the writer committed it."""
    return path_exists(spark, f"{path.rstrip('/')}/{SUCCESS}")


def materialize(spark: SparkSession, name: str, build: Callable[[], DataFrame], path: str | None = None,
                partition_by: list[str] | None = None) -> DataFrame:
    """Read a committed stage if present, else build it, write it, and read it back.

    Reading back cuts the lineage: later stages start from the written files.
    """
    path = path or scratch_path(spark, name)
    if not is_complete(spark, path):
        write_table(build(), path, partition_by=partition_by)
    return spark.read.parquet(path)


def input_version(spark: SparkSession, path: str) -> str:
    """What identifies the present content of a file or folder: names, lengths and times of its files (the file system's list)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "absent"
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if not name.startswith((".", MANIFEST)):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def frame_inputs(df: DataFrame) -> list[str]:
    """The folders of the files that a DataFrame reads; none where it reads no files."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def fingerprint(spark: SparkSession, params: dict | None = None, inputs: list[str] | None = None) -> str:
    """Parameters, and the version of every input: a source path, or another stage's table, whose files are new after a rebuild."""
    return json.dumps({"params": params or {}, "inputs": {i: input_version(spark, i) for i in sorted(inputs or [])}}, sort_keys=True, default=str)


def is_current(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether a stage's manifest says that it was made with this fingerprint.

    A table that reads no files (rows given by the driver) has no version: without inputs only the parameters are compared.
    """
    manifest = f"{path.rstrip('/')}{MANIFEST}"
    if not path_exists(spark, f"{manifest}/{SUCCESS}"):
        return False
    row = spark.read.json(manifest, schema="manifest string").first()
    old, new = json.loads(row["manifest"] or "{}") if row else {}, json.loads(mark)
    return old.get("params") == new["params"] and (not new["inputs"] or old.get("inputs") == new["inputs"])


def unseal(spark: SparkSession, path: str) -> None:
    """Delete a stage's manifest: from here on the stage counts as unfinished."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{MANIFEST}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def seal(spark: SparkSession, path: str, mark: str) -> None:
    """Write a stage's manifest, after everything else of it."""
    spark.createDataFrame([(mark,)], "manifest string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}{MANIFEST}")


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], params: dict | None = None, inputs: list[str] | None = None,
          partition_by: list[str] | None = None) -> DataFrame:
    """A committed stage that is rebuilt when its parameters or inputs have changed, and only then.

    The manifest beside the table is deleted first and written last, so a stage that was lost half-way is built anew.
    """
    mark = fingerprint(spark, params, inputs)
    if not (is_complete(spark, path) and is_current(spark, path, mark)):
        unseal(spark, path)
        write_table(build(), path, partition_by=partition_by)
        seal(spark, path, mark)
    return spark.read.parquet(path)


def save_embeddings(df: DataFrame, path: str, key: str = "row_id", col: str = "embedding") -> str:
    """Embedding table ``(key, embedding ARRAY<FLOAT>)`` keyed by a stable row id."""
    return write_table(df.select(key, df[col].cast("array<float>").alias(col)), path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def checkpoint_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and continue from the files."""
    path = scratch_path(spark, name)
    write_table(df, path)
    return spark.read.parquet(path)
