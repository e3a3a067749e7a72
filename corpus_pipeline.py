"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, mix.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and returns a
DataFrame; the runner writes it as Parquet and reads it again as the next stage's input. All but the last
return the columns of ``documents``; the last adds the mixing columns. A row's order does not
matter to any stage, so a lost executor only repeats the tasks of the current stage.

Defined results: nulls, empty and very long texts, repeated rows, clashing columns: as the operators define them, row by row; an
empty table goes through every stage empty.

Decisions
* language: a text without letters, or one that lies far from every learned profile, goes; a null
  language is filled with the predicted one.
* near duplicates: of each group (5-word shingles, Jaccard >= 0.8) the row with the smallest id stays
  (nulls last); each row is judged by itself, also when ids repeat or are null.
* benchmark: rows that hold a window of a benchmark item go, whatever their id.
* personal data: texts go on with surrogates; ``n_chars`` is counted anew.
* mix: rows are sampled with their calibrated probabilities.

SQL can state neither the rank-order profiles nor the surrogates, so ``ORACLE_SQL`` is None and the tests hold the
stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civictext.session import scratch_path
from llm import decontaminate, language_profiles, mixing, ngram_join, surrogates
from llm.shared import free

MIN_SCORE = 0.2  # a text whose out-of-place distance to every profile is more than 80 % of the greatest possible


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a recognised language."""
    profiles = language_profiles.learn_profiles(docs)  # all rows with a language
    found, score = free(docs, "lang_pred", "score")
    named = language_profiles.predict(docs, profiles, docs.columns, out=(found, score))
    good = named.where((F.col(found) != language_profiles.UNKNOWN) & (F.col(score) >= MIN_SCORE))
    return good.withColumn("lang", F.coalesce("lang", found)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    return ngram_join.keep_first(docs, k=5, num=4, den=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for personal data."""
    out = surrogates.replace_private(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns if c in out.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled rows, with topic, tokens, weight and probability."""
    return mixing.mix(docs).where("kept").drop("kept")


STAGES = [("language", language), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark_passages),
          ("personal data", personal_data), ("mix", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
