"""URL filters: host and path rules, then gradient-boosted trees on lexical features (operator 6).

``matched`` takes the longest rule whose host is the url's host or a parent domain of it and
whose path begins the url's path. The urls with a rule are the labelled ones: a bounded sample of them
(``TRAIN_ROWS`` by hash of the url, a documented bound) trains ``GBTClassifier``; urls without a rule get
the trees' verdict. Features: lengths, depth, digit ratio, entropy of the characters, parameters,
hyphens, and statistics of the registered suffix of the host (the share of blocked training urls under
its last label and under its last two labels, smoothed towards the overall share). Suffix statistics are counted over
all labelled urls by a partial aggregate and joined, so neither a hot host nor their number matters.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; the trees judge its
features (zeros). Every input row gives one row. Without labelled urls of both kinds the verdict is the only
kind seen, or allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

ALLOW, BLOCK = "allow", "block"

#: ``(verdict, host, path)``: fixed values of the registered query.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]

TRAIN_ROWS = 50_000
SMOOTH = 20.0
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "last_share", "two_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    has = F.coalesce(url.contains("://"), F.lit(False))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, low).otherwise(""), F.when(has, path).otherwise("")


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """``(rule, verdict)`` of the longest rule that fits (host and path together; ties: the first in the list), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the longest is tested first: it wraps the others
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    n = F.length(text)
    parts = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(-F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p)), F.lit(0.0))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the lexical features and the suffixes ``last`` and ``two``; needs ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = lambda c: F.length(c).cast("double")
    count = lambda c, ch: (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("double")
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return (rows.withColumn("url_length", size(url)).withColumn("host_length", size(F.col("host"))).withColumn("path_length", size(F.col("path")))
            .withColumn("depth", F.size(F.filter(F.split("path", "/", -1), lambda s: s != "")).cast("double"))
            .withColumn("host_labels", F.when(F.col("host") == "", 0.0).otherwise(count(F.col("host"), ".") + 1))
            .withColumn("digit_ratio", digits / F.greatest(F.length(url), F.lit(1))).withColumn("entropy", entropy(url))
            .withColumn("parameters", F.when(query == "", 0.0).otherwise(count(query, "&") + 1)).withColumn("hyphens", count(url, "-"))
            .withColumn("last", F.substring_index("host", ".", -1)).withColumn("two", F.substring_index("host", ".", -2)))


def suffix_shares(labelled: DataFrame, suffix: str, out: str, prior: float) -> DataFrame:
    """``(suffix, out)``: smoothed share of blocked urls under each suffix."""
    return labelled.groupBy(suffix).agg(((F.sum("label") + SMOOTH * prior) / (F.count(F.lit(1)) + SMOOTH)).alias(out))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, block_probability)`` for every row; the probability is null where a rule decides."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("hit", matched(F.col("host"), F.col("path"), rules))
    rows = saved(lexical(rows.withColumn("label", F.when(F.col("hit.verdict") == BLOCK, 1.0).when(F.col("hit.verdict") == ALLOW, 0.0))), "urls")
    labelled = rows.where("label is not null")
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    plain = rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("given"))
    if not seen["n"] or seen["blocked"] in (0, seen["n"]):
        only = BLOCK if seen["n"] and seen["blocked"] else ALLOW
        return plain.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    prior = seen["blocked"] / seen["n"]
    full = rows
    for suffix, out in (("last", "last_share"), ("two", "two_share")):
        full = full.join(suffix_shares(labelled, suffix, out, prior), suffix, "left").withColumn(out, F.coalesce(out, F.lit(prior)))
    full = saved(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
                 .select("page_id", "url", "host", "path", "hit", "label", "features"), "url-features")
    part = min(1.0, train_rows / seen["n"])
    train = full.where("label is not null").where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(part * 1_000_000))
    model = GBTClassifier(maxIter=12, maxDepth=4, maxBins=64, seed=7, cacheNodeIds=False).fit(train.select("features", "label"))
    scored = model.transform(full).withColumn("p", vector_to_array("probability")[1])
    free = F.col("label").isNull()
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                         F.coalesce(F.col("hit.verdict"), F.when(F.col("p") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
                         F.when(free, F.col("p")).alias("block_probability"))
