"""Language tagging at table scale.

Two parts:
* ``script_language`` -- a Unicode-block rule: the Indic script holding most of
  a text's letters names its language; other texts are ``en``; empty text is
  ``unknown``. Since unsupported codes are reported as ``en`` anyway, this rule
  alone decides the supported-language column.
* ``train_language_profile`` / ``detect_language`` -- a word naive Bayes whose
  profile table (all words per language, log probabilities) is learned with
  Spark aggregates from a labelled table, and applied with a join of that
  profile (broadcast only below a checked size) plus one aggregate per document.
  It yields the raw language code (de, fr, es, ...) kept next to the reported one.

* ``train_ngram_profile`` / ``detect_by_ngrams`` -- the same naive Bayes over character n-grams of the words, which
  also knows words that no training text had and separates languages of one script. N-grams are
  made once per distinct word: training counts words by language first, and a document's score is the sum of its words' scores.

Text without any letter has no features and is ``unknown``. ``mr`` is a supported
code that the script rule cannot tell from ``hi``; only a learned profile can yield it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

# ---------------------------------------------------------------------------
# FIXED VALUES: Indic script blocks and the language each one names.
# ---------------------------------------------------------------------------
SCRIPT_BLOCKS = [
    ("hi", r"\x{0900}-\x{097F}"),  # Devanagari
    ("bn", r"\x{0980}-\x{09FF}"),  # Bengali
    ("gu", r"\x{0A80}-\x{0AFF}"),  # Gujarati
    ("ta", r"\x{0B80}-\x{0BFF}"),  # Tamil
    ("te", r"\x{0C00}-\x{0C7F}"),  # Telugu
    ("kn", r"\x{0C80}-\x{0CFF}"),  # Kannada
    ("ml", r"\x{0D00}-\x{0D7F}"),  # Malayalam
]
INDIC_RANGE = r"\x{0900}-\x{0D7F}"
LETTER_CLASS = r"\p{L}\p{M}"


def _count_in(c: Column, char_class: str) -> Column:
    # deleting whole runs (``+``) gives the same string as deleting one character
    # per match, with one replacement per run instead of one per character
    return F.length(F.regexp_replace(c, f"[^{char_class}]+", ""))


def script_language(c: Column) -> Column:
    """``unknown`` for text without letters, the dominant Indic script's language, else ``en``."""
    indic = F.regexp_replace(c, f"[^{INDIC_RANGE}]+", "")
    letters = _count_in(c, LETTER_CLASS)
    best = F.greatest(*[F.struct(_count_in(indic, rng).alias("n"), F.lit(code).alias("lang"))
                        for code, rng in SCRIPT_BLOCKS])
    return (F.when(F.coalesce(letters, F.lit(0)) == 0, F.lit("unknown"))
            .when(F.length(indic) == 0, F.lit("en"))
            .when(best["n"] * 2 > letters, best["lang"])
            .otherwise(F.lit("en")))


def with_script_language(df: DataFrame, text_col: str = "clean_text", out: str = "language") -> DataFrame:
    """Add ``script_language`` of ``text_col`` as ``out``, each regex pass run once per row.

    The Indic-only string and the winning script are separate projections
    (Catalyst keeps a costly expression that is used more than once in its own
    projection), and the per-script counts run on the short Indic-only string.
    """
    c = F.col(text_col)
    staged = df.withColumn("_indic", F.regexp_replace(c, f"[^{INDIC_RANGE}]+", ""))
    counts = [F.struct(_count_in(F.col("_indic"), rng).alias("n"), F.lit(code).alias("lang"))
              for code, rng in SCRIPT_BLOCKS]
    staged = staged.withColumn("_best", F.when(F.length("_indic") > 0, F.greatest(*counts)))
    lang = (F.when(~F.coalesce(c, F.lit("")).rlike(f"[{LETTER_CLASS}]"), F.lit("unknown"))
            .when(F.col("_best").isNull(), F.lit("en"))
            .when(F.col("_best.n") * 2 > _count_in(c, LETTER_CLASS), F.col("_best.lang"))
            .otherwise(F.lit("en")))
    return staged.withColumn(out, lang).drop("_indic", "_best")


def train_language_profile(df: DataFrame, text_col: str, label_col: str, top_n: int | None = None) -> DataFrame:
    """Profile ``(lang, token, logp, floor, prior)``: every token of every language.

    Add-one smoothing over the whole vocabulary; ``floor`` is the log
    probability of an unseen token, ``prior`` the log share of documents.
    ``top_n`` keeps only the most frequent tokens of each language (off by default).
    """
    from ..sources.store import checkpoint_table

    toks = df.select(F.col(label_col).alias("lang"), F.explode(tokens(F.col(text_col))).alias("token"))
    # (language, token) counts feed the vocabulary size, the totals and the top words:
    # written once (vocabulary x languages rows) so the texts are tokenised once
    counts = checkpoint_table(df.sparkSession, toks.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")),
                              "language-token-counts")
    return _smoothed(counts, df.groupBy(F.col(label_col).alias("lang")).agg(F.count(F.lit(1)).alias("docs")), top_n)


def _smoothed(counts: DataFrame, docs: DataFrame, top_n: int | None = None) -> DataFrame:
    """Profile ``(lang, token, logp, floor, prior)`` of counts ``(lang, token, n)`` and documents ``(lang, docs)``."""
    vocab = counts.select("token").distinct().agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    all_docs = docs.agg(F.sum("docs").alias("all_docs"))
    top = counts
    if top_n is not None:
        w = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("token"))
        top = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n).drop("_rn")
    stats = totals.join(docs, "lang")
    # vocabulary size and document total are single scalars; attach them by a
    # constant key so the plan stays an equi-join
    scal = vocab.withColumn("_k", F.lit(1)).join(all_docs.withColumn("_k", F.lit(1)), "_k")
    stats = stats.withColumn("_k", F.lit(1)).join(F.broadcast(scal), "_k").drop("_k")
    stats = stats.select(
        "lang",
        F.log(F.lit(1.0) / (F.col("total") + F.col("v"))).alias("floor"),
        F.log(F.col("docs") / F.col("all_docs")).alias("prior"),
        (F.col("total") + F.col("v")).alias("denom"),
    )
    return (top.join(F.broadcast(stats), "lang")
            .select("lang", "token", F.log((F.col("n") + 1) / F.col("denom")).alias("logp"), "floor", "prior"))


def detect_language(df: DataFrame, profile: DataFrame, text_col: str, key: str, out: str = "raw_language",
                    keep: tuple[str, ...] = (), max_profile_rows: int = 2_000_000) -> DataFrame:
    """``(key, *keep, out)``: the most likely language under ``profile`` (ties go to the smaller code).

    The profile's languages, floors and priors are a few numbers per language
    and are read to the driver. The token table is broadcast when it has at most
    ``max_profile_rows`` numbers (tokens by languages); a larger one is joined by shuffle on the token, with the
    same result (AQE splits the partition of a frequent token). The texts are tokenised
    once and not joined back: ``keep`` columns travel through the aggregate.
    """
    from ..sources.store import checkpoint_table

    # the profile is a model table: write it once so the two small reads below and the
    # join do not each re-run the training job
    profile = checkpoint_table(df.sparkSession, profile, "language-profile")
    langs = profile.select("lang", "floor", "prior").distinct().orderBy("lang").collect()
    wide = (profile.groupBy("token")
            .pivot("lang", [r["lang"] for r in langs])
            .agg(F.first(F.col("logp") - F.col("floor"))))
    toks = df.select(key, *keep, F.explode_outer(tokens(F.col(text_col))).alias("token"))
    # the wide table has a number for every token and language, also where the profile has no row
    cells = profile.agg(F.count_distinct("token")).first()[0] * max(1, len(langs))
    joined = toks.join(F.broadcast(wide) if cells <= max_profile_rows else wide, "token", "left")
    sums = joined.groupBy(key, *keep).agg(
        F.count("token").alias("_ntok"),
        *[F.coalesce(F.sum(F.col(f"`{r['lang']}`")), F.lit(0.0)).alias(f"_s_{i}") for i, r in enumerate(langs)])
    scored = [F.struct((F.col("_ntok") * F.lit(r["floor"]) + F.lit(r["prior"]) + F.col(f"_s_{i}")).alias("score"),
                       F.lit(-i).alias("neg_rank"), F.lit(r["lang"]).alias("lang"))
              for i, r in enumerate(langs)]
    best = F.greatest(*scored)["lang"] if len(scored) > 1 else scored[0]["lang"]
    return sums.select(key, *keep, best.alias(out))


NGRAM_SIZES = (1, 2, 3)
NGRAM_WORD = r"[\p{L}\p{M}\p{N}_]+"  # with combining marks: without them Indic words fall apart at their vowel signs


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(NGRAM_WORD), F.lit(0))


def word_ngrams(word: Column, sizes: tuple[int, ...] = NGRAM_SIZES) -> Column:
    """The character n-grams of a word with a mark before and after it, repeats included."""
    marked = F.concat(F.lit("_"), word, F.lit("_"))


    def of_size(n: int) -> Column:
        last = F.char_length(marked) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(n) for n in sizes])


def train_ngram_profile(df: DataFrame, text_col: str, label_col: str, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """Profile ``(lang, token, logp, floor, prior)`` whose tokens are character n-grams; add-one smoothing over all n-grams.

    Rows without a label take no part.
    """
    from ..sources.store import checkpoint_table

    df = df.where(F.col(label_col).isNotNull())
    words = df.select(F.col(label_col).alias("lang"), F.explode(_words(F.col(text_col))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    grams = words.select("lang", "n", F.explode(word_ngrams(F.col("word"), sizes)).alias("token")).groupBy("lang", "token").agg(F.sum("n").alias("n"))
    counts = checkpoint_table(df.sparkSession, grams, "language-ngram-counts")
    return _smoothed(counts, df.groupBy(F.col(label_col).alias("lang")).agg(F.count(F.lit(1)).alias("docs")))


def detect_by_ngrams(df: DataFrame, profile: DataFrame, text_col: str, key: str, out: str = "raw_language", keep: tuple[str, ...] = (),
                     sizes: tuple[int, ...] = NGRAM_SIZES, max_cells: int = 2_000_000) -> DataFrame:
    """``(key, *keep, out)``: the most likely language under an n-gram profile (ties go to the smaller code).

    The distinct words of ``df`` are scored by a join of their n-grams with the profile, broadcast up to ``max_cells`` numbers,
    and a document by a join of its word counts with the word scores. Texts without words get the likeliest prior.
    """
    from ..sources.store import checkpoint_table

    spark = df.sparkSession
    profile = checkpoint_table(spark, profile, "ngram-profile")
    langs = profile.select("lang", "floor", "prior").distinct().orderBy("lang").collect()  # one row a language
    names = [r["lang"] for r in langs]
    cols = [f"_s_{i}" for i in range(len(langs))]
    wide = profile.groupBy("token").pivot("lang", names).agg(F.first(F.col("logp") - F.col("floor")))
    words = df.select(key, *keep, F.explode_outer(_words(F.col(text_col))).alias("word")).groupBy(key, *keep, "word").agg(F.count(F.lit(1)).alias("n"))
    words = checkpoint_table(spark, words, "document-words")
    grams = words.select("word").where("word is not null").distinct().select("word", F.explode(word_ngrams(F.col("word"), sizes)).alias("token"))
    small = profile.agg(F.count_distinct("token")).first()[0] * max(1, len(langs)) <= max_cells
    scored = grams.join(F.broadcast(wide) if small else wide, "token", "left").groupBy("word").agg(
        F.count(F.lit(1)).alias("_grams"), *[F.coalesce(F.sum(F.col(f"`{x}`")), F.lit(0.0)).alias(c) for x, c in zip(names, cols)])
    total = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0.0))
    sums = words.join(scored, "word", "left").groupBy(key, *keep).agg(total("_grams").alias("_grams"), *[total(c).alias(c) for c in cols])
    best = [F.struct((F.col("_grams") * F.lit(r["floor"]) + F.lit(r["prior"]) + F.col(c)).alias("score"), F.lit(-i).alias("place"), F.lit(r["lang"]).alias("lang"))
            for i, (r, c) in enumerate(zip(langs, cols))]
    return sums.select(key, *keep, (F.greatest(*best) if len(best) > 1 else best[0])["lang"].alias(out))


def language_accuracy(pred: DataFrame, truth_col: str, pred_col: str = "raw_language") -> DataFrame:
    """Per-language support and accuracy, plus the overall row."""
    return (pred.groupBy(F.col(truth_col).alias("lang"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(F.col(truth_col) == F.col(pred_col), 1).otherwise(0)).alias("correct"))
            .withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 4)))
