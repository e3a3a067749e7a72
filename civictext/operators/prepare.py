"""Table preparation: composite text, null fills, cleaning, length filter,
truncation, seeded sampling, stratified split, keep-first dedup, accounting.

Scale notes
* Cleaning is one projection; ``once`` keeps a following length filter from
  re-running the regex chain.
* Keep-first dedup is a hash aggregate with ``min_by`` (partial aggregation
  collapses a hot duplicate group on the map side before the shuffle) rather
  than a window, which would sort a hot group inside one task.
* Seeded order is ``md5('<seed>:' || key)`` so Spark and SQL engines agree.
  Samples, per-class caps and stratified splits take "the first n rows in
  seeded order" without a global sort or a per-class funnel: the rows are
  counted per (class, 20-bit hash bucket), a window over those counts finds
  the one bucket of each class holding its cut, and only the rows of that
  bucket (about 1/1M of the class) are ranked. Rows before it are in, rows
  after it are out -- exactly the rows of ``ORDER BY hash, key LIMIT n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import clean_text, null_as_nan, once, supported_language, truncate

HASH_BUCKET_BITS = 20  # about 1M hash buckets per class
MAX_BROADCAST_CLASSES = 1_000_000  # cut table rows (one per class) allowed in a broadcast


def seeded_hash(key, seed: int = L.SEED) -> Column:
    """Hex md5 of ``'<seed>:' || key``; ordering by it is a seeded shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def composite_complaint_text(category="Category", request_type="Request Type", details="Request Details",
                             neighborhood="Neighborhood") -> Column:
    """``Category - Request Type - Request Details at Neighborhood``; NULL as ``nan``/``Unknown``."""
    return F.concat(
        null_as_nan(F.col(f"`{category}`")), F.lit(" - "), null_as_nan(F.col(f"`{request_type}`")), F.lit(" - "),
        null_as_nan(F.col(f"`{details}`")), F.lit(" at "), F.coalesce(F.col(f"`{neighborhood}`"), F.lit("Unknown")),
    )


def composite_news_text(title="title", text="text") -> Column:
    """``title + '. ' + text`` with NULL as empty string."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(". "), F.coalesce(F.col(text), F.lit("")))


def with_clean_text(df: DataFrame, text_col: str = "text", out: str = "clean_text", min_length: int | None = None,
                    max_length: int | None = None, truncate_first: bool = False, extended_scripts: bool = False,
                    nan_for_null: bool = True) -> DataFrame:
    """Add the cleaned text; optionally keep rows with ``length >= min_length`` and truncate.

    ``truncate_first`` selects the news order (truncate, then filter); the
    default is the complaints order (filter, then truncate).
    """
    src = null_as_nan(F.col(text_col)) if nan_for_null else F.col(text_col)
    cleaned = clean_text(src, extended_scripts)
    if truncate_first and max_length:
        cleaned = truncate(cleaned, max_length)
    cols = [c for c in df.columns if c != out]
    res = df.select(*cols, once(cleaned).alias(out))
    if min_length is not None:
        res = res.where(F.length(out) >= min_length)
    if max_length and not truncate_first:
        res = res.withColumn(out, truncate(F.col(out), max_length))
    return res


def keep_first(df: DataFrame, subset: list[str], order_col: str) -> DataFrame:
    """One row per ``subset`` value: the one with the smallest ``order_col``."""
    others = [c for c in df.columns if c not in subset]
    agg = df.groupBy(*subset).agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_col)).alias("_r"))
    return agg.select(*subset, "_r.*").select(*df.columns)


def hash_bucket(h: Column, bits: int = HASH_BUCKET_BITS) -> Column:
    """The top ``bits`` bits of a hex hash; bucket order agrees with the hash's order."""
    digits = (bits + 3) // 4
    return F.shiftright(F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint"), 4 * digits - bits).cast("int")


def first_in_seeded_order(df: DataFrame, key: str, n: int | None = None, fraction: float | None = None,
                          label: str | None = None, seed: int = L.SEED, flag: str | None = None,
                          bits: int = HASH_BUCKET_BITS) -> DataFrame:
    """The first ``n`` (or ``ceil(fraction * class size)``) rows of each class in seeded order.

    Without ``flag`` the other rows are dropped; with it every row is kept and
    ``flag`` tells whether it is among the first. Exact: the same rows as a
    ``row_number()`` over ``(hash, key)`` per class, but no task ever sorts a
    whole class or receives candidates from every map task. Three passes over
    the input: bucket counts, then the rows decided by their bucket, then the
    ranked rows of each class's cut bucket -- so an input with a costly
    lineage should be materialised first (``sources.store.checkpoint_table``).
    """
    if (n is None) == (fraction is None):
        raise ValueError("give exactly one of n and fraction")
    if (n if n is not None else fraction) <= 0:  # nothing is among the first zero rows
        return df.withColumn(flag, F.lit(False)) if flag else df.where(F.lit(False))
    grp = [label] if label else []
    rows = df.withColumn("_h", seeded_hash(key, seed))
    rows = rows.withColumn("_b", hash_bucket(F.col("_h"), bits))
    counts = rows.groupBy(*grp, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_class = Window.partitionBy(*grp)  # at most 2**bits small count rows per class
    counts = counts.select(
        *grp, "_b", "_n",
        F.coalesce(F.sum("_n").over(by_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_n").over(by_class).alias("_total"))
    limit = F.lit(n) if n is not None else F.ceil(F.lit(fraction) * F.col("_total"))
    cut = (counts.where((F.col("_before") < limit) & (F.col("_before") + F.col("_n") >= limit))
           .select(*grp, F.col("_b").alias("_cut"), (limit - F.col("_before")).alias("_need")))
    # one row per class whose cut falls inside it: written once to the shared checkpoint
    # folder (so the size check and the join read it instead of recounting the input),
    # and broadcast only under a checked row count
    from ..sources.store import checkpoint_table
    cut = checkpoint_table(df.sparkSession, cut, "seeded-cut")
    n_cut = cut.count()
    if n_cut == 0:  # every class is within its limit: all rows are among the first
        return df.withColumn(flag, F.lit(True)) if flag else df
    if not grp:
        rows, cut, grp_join = rows.withColumn("_k", F.lit(1)), cut.withColumn("_k", F.lit(1)), ["_k"]
    else:
        grp_join = grp
    # a NULL class is a class of its own (as in a window's PARTITION BY): null-safe key
    cut = cut.withColumnRenamed(grp_join[0], "_cls")
    # beyond the bound a plain join: AQE splits a hot class's partition of the row side
    cut_side = F.broadcast(cut) if n_cut <= MAX_BROADCAST_CLASSES else cut
    joined = rows.join(cut_side, rows[grp_join[0]].eqNullSafe(cut_side["_cls"]), "left").drop("_cls")
    # no cut in a class: it is smaller than its limit, so all of it is in
    before = F.col("_cut").isNull() | (F.col("_b") < F.col("_cut"))
    drop = ["_h", "_b", "_cut", "_need"] + (["_k"] if "_k" in grp_join else [])
    decided = joined.where(F.col("_cut").isNull() | (F.col("_b") != F.col("_cut")))
    boundary = joined.where(F.col("_b") == F.col("_cut"))
    w = Window.partitionBy(*grp_join, "_b").orderBy("_h", key)
    ranked_in = F.row_number().over(w) <= F.col("_need")
    if flag:
        return (decided.withColumn(flag, before)
                .unionByName(boundary.withColumn(flag, ranked_in))
                .drop(*drop))
    boundary = boundary.withColumn("_in", ranked_in).where(F.col("_in")).drop("_in")
    return decided.where(before).unionByName(boundary).drop(*drop)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = L.SEED) -> DataFrame:
    """Exactly ``min(n, count)`` rows chosen by seeded hash order.

    As in the source system, a table at or below the cap is kept whole. The
    sample stays spread over the input's partitions (no top-n funnel into one
    task), see ``first_in_seeded_order``.
    """
    return first_in_seeded_order(df, key, n=n, seed=seed)


def per_class_sample(df: DataFrame, label: str, n_per_class: int, key: str, seed: int = L.SEED) -> DataFrame:
    """Up to ``n_per_class`` rows of each class by seeded hash order (skew-safe, exact)."""
    return first_in_seeded_order(df, key, n=n_per_class, label=label, seed=seed)


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     seed: int = L.SEED) -> DataFrame:
    """Add ``is_test``: the first ``ceil(test_fraction * n_class)`` rows of each class by seeded order."""
    return first_in_seeded_order(df, key, fraction=test_fraction, label=label, seed=seed, flag="is_test")


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def prepare(df: DataFrame, text_col: str = "text", label_col: str | None = None, key: str = "row_id",
            min_length: int = 10, max_length: int | None = None, detect_lang: bool = True,
            drop_duplicates: bool = True, drop_empty: bool = True, extended_scripts: bool = False,
            language_fn=None, keep_text: bool = True) -> DataFrame:
    """Clean a text table: rename, clean, length filter, optional cut, dedup, language, label.

    ``max_length`` (in words of five characters) cuts the cleaned text; by default texts stay whole.
    ``language_fn(clean_text_column) -> Column`` supplies the language tag; the
    default tags by script (see ``operators.language.script_language``).
    """
    from ..sources.csvfiles import rename_canonical
    from .language import with_script_language

    if key not in df.columns:
        df = df.withColumn(key, F.monotonically_increasing_id())
    out = rename_canonical(df, text_col)
    out = with_clean_text(out, "text", min_length=min_length if drop_empty else None,
                          max_length=max_length * 5 if max_length else None, extended_scripts=extended_scripts)
    if not keep_text:  # do not carry the raw text through the dedup shuffle
        out = out.drop("text")
    if drop_duplicates:
        out = keep_first(out, ["clean_text"], key)
    if detect_lang:
        if language_fn:
            out = out.withColumn("language", supported_language(language_fn(F.col("clean_text")),
                                                                L.SUPPORTED_LANGUAGES))
        else:
            out = with_script_language(out, "clean_text", "language")
    if label_col and label_col in df.columns and label_col != text_col:
        if "label" in out.columns and label_col != "label":
            out = out.withColumnRenamed("label", "label_orig")
        out = out.withColumnRenamed(label_col, "label")
    return out


def dense_row_ids(df: DataFrame, key: str, out: str = "row_num", partitions: int | None = None) -> DataFrame:
    """0-based dense row numbers in ``key`` order, without a one-partition global sort.

    Rows are range-partitioned on ``key`` and written once with their range number:
    range bounds are sampled anew by every execution, so the counts and the rows must
    come from the same written table. Each range numbers its own rows and adds the count of
    all earlier ranges, joined as a small table (one row per range). By default there are as
    many ranges as the session's shuffle partitions (sized for the data on a
    cluster), and at least one per core.
    """
    from ..sources.store import checkpoint_table
    spark = df.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism,
                          int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = checkpoint_table(spark, df.repartitionByRange(n, F.col(key)).withColumn("_pid", F.spark_partition_id()),
                              "ranged-rows")
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c")).select(
        "_pid", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(F.col(key))
    return (ranged.withColumn(out, F.row_number().over(w)).join(offsets, "_pid")
            .withColumn(out, (F.col("_off") + F.col(out) - 1).cast("long")).drop("_pid", "_off"))
