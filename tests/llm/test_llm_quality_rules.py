"""Statistics against plain Python, and rules learned from planted labels."""

import collections
import re

from edge_rows import documents, empty
from pyspark.sql import functions as F

from llm import quality_rules as Q


def plain(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_statistics_of_documents_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(-1, "a b a b a b c"), (-2, "x x x"), (-3, "x x x x"), (-4, "a b c d a b c"), (-5, "a b c a b c a b c"), (-6, "one two"), (-7, "a b \x1c c | # \U0001f642"), (-8, "p q r s " * 3000)]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    text = {r.doc_id: r.text for r in df.collect()}
    for r in Q.text_stats(df).collect():
        assert counts(r) == plain(text[r.doc_id]), text[r.doc_id][:80]
    edge = documents(spark)
    got = sorted(((r.doc_id, *counts(r)) for r in Q.text_stats(edge).collect()), key=str)
    assert got == sorted(((r.doc_id, *plain(r.text)) for r in edge.collect()), key=str)


def labelled(spark, n=600):
    """Low quality: many symbols, or many digits; the rest is good."""
    rows = []
    for i in range(n):
        words = [chr(97 + j // 26) + chr(97 + j % 26) + "word"[:1 + (i + j) % 4] for j in range(60 + i % 40)]
        low = i % 5 in (0, 1)
        if i % 5 == 0:
            words = [w + "#" for w in words]
        elif i % 5 == 1:
            words = [w + "1" for w in words]
        else:
            words = [w + "x" for w in words]
        rows.append((i, " ".join(words), 0 if low else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_planted_rules_are_learned(spark):
    rows = labelled(spark)
    got = {r.doc_id: r for r in Q.judge(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).collect()}
    assert len(got) == 600
    for i, r in got.items():
        assert not r.base_failed and r.kept == (i % 5 > 1) and (r.rule == 0) == r.kept
    assert {r.rule for r in got.values()} == {0, 1, 2}  # two rules cover two kinds


def test_tests_and_rules_equal_brute_force(spark):
    """The first test has the best gain of all thresholds, counted row by row."""
    import math

    df = Q.features(Q.text_stats(labelled(spark, 200).select("doc_id", "text"))).withColumn("low", F.when(F.col("doc_id") % 5 < 2, 1).otherwise(0))
    rows = df.select("low", *[F.col(s).cast("double").alias(s) for s in Q.STATS])
    data = rows.collect()
    cuts = {s: sorted({r[s] for r in data})[::7] for s in Q.STATS}
    p0 = sum(r.low for r in data)
    gain, test, _ = Q._best_test(rows, cuts, (p0, len(data) - p0))
    best = 0.0
    for s in cuts:
        for c in cuts[s]:
            for above in (False, True):
                fit = [r.low for r in data if (r[s] > c) == above]
                if len(fit) >= Q.LEAST_ROWS and sum(fit):
                    best = max(best, sum(fit) * (math.log2(sum(fit) / len(fit)) - math.log2(p0 / len(data))))
    assert abs(gain - best) < 1e-9 and test is not None


def test_edge_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 0), (99, 0)], "doc_id long, quality int")
    rows = Q.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.rule == 0 for r in rows)  # one labelled document teaches nothing
    assert {r.doc_id for r in rows if r.base_failed} >= {0, 1, 2, 3, 4}
    assert Q.judge(empty(spark), labels.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = Q.text_stats(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
