"""Text -> vector operators: hashed bag-of-words embedding, normalisation, checks.

The default encoder is a hashed bag of words: tokens are lower-cased word
runs, each token goes to bucket ``md5(token)[:8] mod dim``, and the bucket
counts are L2-normalised, so the dot product of two rows is their cosine.
Tokenising runs JVM-side and hands over one string a text; the Arrow arrays are split and encoded
slice by slice in the UDF, so md5 runs once per distinct token of a slice (not once
per token through an interpreted higher-order function), no token becomes a
Python object of its own, and a slice becomes dense rows with one ``bincount``.
``token_buckets`` states the same bucket as a JVM column expression.

A different encoder (e.g. a sentence model) can be plugged in through
``encode_with`` which runs a user function over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import lexicons as L
from ..functions.text import blank_as_empty_word, spaced_tokens, tokens

SLICE_ROWS = 512  # texts whose tokens are encoded at a time


def token_buckets(c, dim: int = L.EMBEDDING_DIM) -> Column:
    """Array of hash buckets, one per token (JVM-side md5)."""
    toks = tokens(blank_as_empty_word(c))
    return F.transform(toks, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim)
                       .cast("int"))


def _dense_from_buckets(dim: int):
    @F.pandas_udf(ArrayType(DoubleType()))
    def dense(buckets: pd.Series) -> pd.Series:
        n = len(buckets)
        lengths = buckets.map(len).to_numpy()
        if n == 0:
            return pd.Series([], dtype=object)
        flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in buckets]) if lengths.sum() else \
            np.zeros(0, dtype=np.int64)
        rows = np.repeat(np.arange(n), lengths)
        m = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
        return pd.Series(list(m))

    return dense


def _dense_from_words(dim: int):
    from hashlib import md5

    @F.arrow_udf(ArrayType(DoubleType()))
    def dense(words: pa.Array) -> pa.Array:
        m = np.zeros((len(words), dim))
        for a in range(0, len(words), SLICE_ROWS):  # beside the batch itself only a slice's codes are held
            part = pc.split_pattern(words.slice(a, SLICE_ROWS), " ")
            codes = part.flatten().dictionary_encode()
            if len(codes):
                names = codes.dictionary.cast(pa.large_binary())
                ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1].tolist()
                data = names.buffers()[2].to_pybytes() if names.buffers()[2] else b""
                digests = b"".join([md5(data[i:j]).digest() for i, j in zip(ends, ends[1:])])
                buckets = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % dim
                buckets[np.diff(ends) == 0] = dim  # the empty word of a text without words is counted in a column of its own
                rows = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy())
                n = np.bincount(rows * (dim + 1) + buckets[codes.indices.to_numpy()], minlength=len(part) * (dim + 1))
                m[a:a + len(part)] = n.reshape(-1, dim + 1)[:, :dim]
            norms = np.sqrt((m[a:a + len(part)] ** 2).sum(axis=1, keepdims=True))
            m[a:a + len(part)] /= np.where(norms > 0, norms, 1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim), pa.int32()), pa.array(m.reshape(-1)))

    # else a filter on the vector is evaluated once more below the dedup of the texts
    return dense.asNondeterministic()


def hashed_embedding(c, dim: int = L.EMBEDDING_DIM) -> Column:
    """Unit-length hashed bag-of-words vector ``ARRAY<DOUBLE>`` of width ``dim``."""
    return _dense_from_words(dim)(spaced_tokens(blank_as_empty_word(c)))


def l2_normalize(c) -> Column:
    """``v / ||v||`` as a higher-order function (zero vectors stay zero)."""
    v = F.col(c) if isinstance(c, str) else c
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def _document_frequencies(df: DataFrame, col: str) -> dict[int, int]:
    """In how many vectors each dimension is not zero, by dimension."""
    if df.schema[col].dataType.typeName() != "binary":
        seen = df.select(F.posexplode(col).alias("d", "w")).where("w <> 0").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
        return {r["d"]: r["n"] for r in seen.collect()}
    import pyarrow as pa

    from . import vector_join as VJ

    width, _ = VJ.vectors_of(df, col)

    def run(batches):
        n = np.zeros(width, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, SLICE_ROWS):
                n += np.count_nonzero(VJ.unpack(b.column(0).slice(a, SLICE_ROWS), width), axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["d", "n"])

    return {r["d"]: r["n"] for r in df.select(col).mapInArrow(run, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()}


def idf_weighted(df: DataFrame, col: str = "embedding") -> DataFrame:
    """``df`` with its vectors weighted by ``ln((n + 1) / (df + 1))`` of each dimension, at unit length again.

    The document frequencies are one number per dimension (``dim`` rows on the driver). Packed vectors (``vector_join.compact``)
    keep their short form: the weights go along with the column and are applied where it is read (``vector_join.weigh``).
    """
    n = df.count()
    idf = {d: float(np.log((n + 1) / (k + 1))) for d, k in _document_frequencies(df, col).items()}
    if df.schema[col].dataType.typeName() == "binary":
        from . import vector_join as VJ

        return VJ.weighted(df, col, [idf.get(d, 0.0) for d in range(VJ.vectors_of(df, col)[0])])
    table = F.array(*[F.lit(idf.get(d, 0.0)) for d in range(max(idf, default=-1) + 1)])
    weighted = F.zip_with(F.col(col), table, lambda x, w: x * F.coalesce(w, F.lit(0.0)))
    staged = df.withColumn("_weighted", weighted)
    norm = F.sqrt(F.aggregate("_weighted", F.lit(0.0), lambda a, x: a + x * x))
    staged = staged.withColumn("_norm", norm)
    unit = F.transform("_weighted", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(F.lit(0.0)))
    return staged.withColumn(col, unit).drop("_weighted", "_norm")


def dimension_check(df: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: min and max vector width and the row count (width mismatch shows as min != max)."""
    return df.agg(F.min(F.size(col)).alias("min_dim"), F.max(F.size(col)).alias("max_dim"),
                  F.count(F.lit(1)).alias("n"))


def encode_with(df: DataFrame, text_col: str, key: str, fn: Callable[[list[str]], np.ndarray], dim: int,
                out: str = "embedding") -> DataFrame:
    """Pluggable encoder: ``fn(list_of_texts) -> (n, dim)`` array, applied per Arrow batch.

    Batch size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].fillna("").map(lambda t: t if t.strip() else "empty").tolist()
            m = np.asarray(fn(texts), dtype=np.float64).reshape(len(texts), dim)
            yield pd.DataFrame({key: pdf[key].to_numpy(), out: list(m)})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInPandas(run, f"{key} {key_type}, {out} array<double>")
