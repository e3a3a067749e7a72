"""Quality rules as a learned decision list, in DataFrame functions only (operator 5).

``text_stats`` counts each text's statistics inside its row (no shuffle, whole texts).
``learn_rules`` covers the low-quality documents one rule after another (sequential covering):
a rule grows by the threshold test with the best FOIL gain on the grow rows, is pruned at its end
by (p - n) / (p + n) on the prune rows (a third, by a hash of the id), and joins the list if
it is right on more than half of the prune rows it fits; the rows it covers go, and the next
rule grows. Thresholds are quantiles of the labelled rows. Every step is one small aggregate over
all labelled rows, whose result has one row per statistic and threshold; nothing else is collected.
``decision`` turns the list into one ordered Spark conditional expression.

``n_repeat_words``: the three-word windows are hashed, the position is packed into the low bits,
the packed numbers are sorted, and neighbours with equal hashes are compared word by word.

Defined results: null text: no words, so the base test fails. Every input row gives one row. A
document with several labels counts with the smallest; labels without a text, or null, teach nothing.
Without labels of both kinds the list is empty and the base test decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CUTS = 24  # quantile thresholds a statistic
MAX_RULES = 8
MAX_TESTS = 4
LEAST_ROWS = 10  # grow rows that a rule must cover

STATS = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words")


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...)`` of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    without = lambda chars: F.length(F.translate(F.col("text"), chars, ""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"), F.length("text").alias("n"),
                       without(BLANKS).alias("word_chars"), without(SYMBOLS).alias("no_symbols"), without("0123456789").alias("no_digits"),
                       without("!?.,;:\"'()").alias("no_marks"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("no_upper"))
    count = lambda c: (F.col("n") - F.col(c)).cast("long")
    rows = rows.select("doc_id", "words", F.size("words").alias("n_words"), F.size("lines").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.col("word_chars").cast("long").alias("word_chars"),
                       count("no_symbols").alias("n_symbols"), count("no_digits").alias("n_digits"), count("no_marks").alias("n_marks"), count("no_upper").alias("n_upper"))
    others = ("n_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_digits", "n_marks", "n_upper")
    word = lambda i: F.get("words", i)
    bits = F.length(F.bin("n_words")).cast("int")  # positions 0..n_words - 3 fit into so many low bits
    keep = F.call_function("shiftleft", F.lit(-1).cast("long"), bits)

    def packed(i: Column) -> Column:
        return F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(keep).bitwiseOR(i.cast("long"))

    windows = F.when(F.col("n_words") >= 4, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 3, F.lit(0))), packed)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("doc_id", "words", *others, bits.alias("bits"), windows.alias("windows"))
    rows = rows.select("doc_id", "words", *others, "bits", F.sort_array("windows").alias("windows"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1

    def same(v: Column, u: Column) -> Column:
        p, q = v.bitwiseAND(low).cast("int"), u.bitwiseAND(low).cast("int")
        near = F.call_function("shiftright", v.bitwiseXOR(u), F.col("bits")) == 0
        return near & (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))

    def twice(v: Column, j: Column) -> Column:
        before, after = F.get("windows", j - 1), F.get("windows", j + 1)
        return F.coalesce(same(v, before), F.lit(False)) | F.coalesce(same(v, after), F.lit(False))

    found = F.transform(F.filter("windows", twice), lambda v: v.bitwiseAND(low))
    rows = rows.select("doc_id", *others, F.sort_array(found).alias("at"))
    # each repeated window adds three words, or as many as lie before the next one
    added = F.transform("at", lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("at", j + 1) - p, F.lit(3).cast("long"))))
    total = F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in others], F.when(F.size("at") > 0, total).otherwise(0).cast("long").alias("n_repeat_words"))


def features(stats: DataFrame) -> DataFrame:
    """Adds the ``STATS`` that the rules test."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return (stats.withColumn("word_length", share("word_chars", "n_words")).withColumn("symbol_share", share("n_symbols", "word_chars"))
            .withColumn("dup_line_share", share("n_dup_lines", "n_lines")).withColumn("repeat_share", share("n_repeat_words", "n_words"))
            .withColumn("upper_share", share("n_upper", "word_chars")).withColumn("digit_share", share("n_digits", "word_chars"))
            .withColumn("mark_share", share("n_marks", "word_chars")).withColumn("line_words", share("n_words", "n_lines")))


@dataclass(frozen=True)
class Test:
    """``stat <= cut`` or ``stat > cut``."""
    stat: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = F.col(self.stat).cast("double")
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.cut:.6g}"


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def _best_test(rows: DataFrame, cuts: dict[str, list[float]], covered: tuple[int, int]) -> tuple[float, Test | None, tuple[int, int]]:
    """The test with the greatest FOIL gain among the grow rows that the rule so far covers."""
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), sum((F.when(F.col(s) > c, 1).otherwise(0) for c in cuts[s]), F.lit(0)).alias("bin")) for s in cuts]))
    got = (rows.select("low", cells.alias("c")).groupBy("c.stat", "c.bin").agg(F.sum(F.col("low")).alias("p"), F.sum(1 - F.col("low")).alias("n")).collect())
    table = {(r["stat"], r["bin"]): (r["p"], r["n"]) for r in got}
    p0, n0 = covered
    base = math.log2(p0 / (p0 + n0))
    best: tuple[float, Test | None, tuple[int, int]] = (0.0, None, covered)
    for s in sorted(cuts):
        p = n = 0
        for b, cut in enumerate(cuts[s]):  # bins 0..b lie at or below cut
            x, y = table.get((s, b), (0, 0))
            p, n = p + x, n + y
            for above, (tp, tn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if tp + tn >= LEAST_ROWS and tp:
                    gain = tp * (math.log2(tp / (tp + tn)) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, Test(s, above, cut), (tp, tn))
    return best


def learn_rules(labelled: DataFrame, max_rules: int = MAX_RULES, max_tests: int = MAX_TESTS) -> list[list[Test]]:
    """Ordered rules for low quality from ``(doc_id, low 0/1, STATS...)``; the default is to keep."""
    rows = saved(labelled.select("low", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *[F.col(s).cast("double").alias(s) for s in STATS]), "labelled")
    quantiles = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    got = rows.agg(*[F.percentile_approx(s, quantiles, 10_000).alias(s) for s in STATS]).first()
    cuts = {s: sorted(set(got[s])) for s in STATS if got[s]}
    rules: list[list[Test]] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        grow, prune = rows.where(left & F.col("grow")), rows.where(left & ~F.col("grow"))
        c = grow.agg(F.sum("low").alias("p"), F.sum(1 - F.col("low")).alias("n")).first()
        covered = (int(c["p"] or 0), int(c["n"] or 0))
        tests: list[Test] = []
        while covered[0] and covered[1] and len(tests) < max_tests:
            gain, test, covered_by = _best_test(grow.where(_all(tests)), cuts, covered)
            if test is None:
                break
            tests.append(test)
            covered = covered_by
        if not tests:
            break
        sums = [x for i in range(1, len(tests) + 1) for x in (F.sum(F.when(_all(tests[:i]), F.col("low"))).alias(f"p{i}"), F.sum(F.when(_all(tests[:i]), 1 - F.col("low"))).alias(f"n{i}"))]
        c = prune.agg(*sums).first()
        worth = [((int(c[f"p{i}"] or 0) - int(c[f"n{i}"] or 0)) / max(1, int(c[f"p{i}"] or 0) + int(c[f"n{i}"] or 0)), i) for i in range(1, len(tests) + 1)]
        best, size = max(worth, key=lambda x: (x[0], -x[1]))
        if best <= 0:
            break
        rules.append(tests[:size])
        left = left & ~_all(tests[:size])
    return rules


def decision(rules: list[list[Test]]) -> tuple[Column, Column]:
    """``(number of the first rule that fits or 0, its text or null)`` as ordered conditional expressions."""
    number, said = F.lit(0), F.lit(None).cast("string")
    for i in range(len(rules), 0, -1):
        fits = _all(rules[i - 1])
        number, said = F.when(fits, i).otherwise(number), F.when(fits, " and ".join(map(str, rules[i - 1]))).otherwise(said)
    return number, said


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (number, 0: none), ``rule_text`` and ``kept`` for every row."""
    stats = saved(text_stats(docs, id_col, text_col), "stats")
    # n_words < 50, or more than half of the words repeated
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rated = features(stats).withColumn("base_failed", base)
    marks = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.min(f"`{label_col}`").alias("_label"))
    taught = rated.where("not base_failed").join(marks, "doc_id").withColumn("low", F.when(F.col("_label") > 0, 0).otherwise(1))
    number, said = decision(learn_rules(taught))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return (rated.withColumn("rule", F.when(F.col("base_failed"), 0).otherwise(number)).withColumn("rule_text", F.when(~F.col("base_failed"), said))
            .select("doc_id", *counts, "base_failed", "rule", "rule_text", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")))
