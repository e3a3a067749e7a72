"""Cleaning chain and rule classifiers against the golden rows."""

import pytest
from pyspark.sql import functions as F

import golden as G
from civictext.functions.rules import api_urgency, topic_rule, urgency_label
from civictext.functions.text import clean_text, contains_any, tokens


def test_clean_golden_rows(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(G.CLEAN_ROWS)], "i int, raw string")
    got = {r.i: r.c for r in df.select("i", clean_text("raw").alias("c")).collect()}
    for i, (_, want) in enumerate(G.CLEAN_ROWS):
        assert got[i] == want, (G.CLEAN_ROWS[i][0], got[i], want)


def test_clean_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "raw string")
    assert df.select(clean_text("raw").alias("c")).first().c == ""


def test_clean_is_idempotent_on_documents(spark):
    from civictext.sources.tables import read_table
    d = read_table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"])
    once = d.select("doc_id", clean_text("text").alias("c"))
    twice = once.select("doc_id", "c", clean_text("c").alias("c2"))
    assert twice.where(F.col("c") != F.col("c2")).count() == 0


def test_extended_scripts_keep_marks(spark):
    df = spark.createDataFrame([("ಕನ್ನಡ",)], "raw string")
    assert df.select(clean_text("raw", extended_scripts=True).alias("c")).first().c == "ಕನ್ನಡ"


@pytest.mark.parametrize("row", G.RULE_ROWS, ids=[r[0][:20] for r in G.RULE_ROWS])
def test_rule_golden_rows(spark, row):
    text, tid, tconf, api_label, api_conf, train_label = row
    df = spark.createDataFrame([(text,)], "t string").select(clean_text("t").alias("c"))
    r = df.select(topic_rule("c").alias("topic"), api_urgency("c").alias("u"), urgency_label("c").alias("lab")).first()
    assert r.topic.topic_id == tid and r.topic.confidence == tconf
    assert r.u.urgency == api_label and r.u.confidence == api_conf
    assert r.lab == train_label
    assert abs(r.u.p_low + r.u.p_medium + r.u.p_high + r.u.p_critical - 1.0) < 1e-9


def test_topic_keywords_first_five(spark):
    r = spark.createDataFrame([("water leak",)], "t string").select(topic_rule("t").alias("x")).first().x
    assert r.top_keywords == ["water", "leak", "pipe", "supply", "drainage"]
    none = spark.createDataFrame([("policy",)], "t string").select(topic_rule("t").alias("x")).first().x
    assert none.topic_id == -1 and none.topic_label == "General/Other" and none.top_keywords == []


def test_substring_semantics(spark):
    df = spark.createDataFrame([("he was fired",)], "t string")
    assert df.select(contains_any(F.lower(F.col("t")), ["fire"]).alias("x")).first().x is True


def test_tokens_lowercase_unicode(spark):
    df = spark.createDataFrame([("Café NAÏVE, x_1!",)], "t string")
    assert df.select(tokens("t").alias("w")).first().w == ["café", "naïve", "x_1"]


def test_short_request_rejected(spark):
    import __spark_entry__  # noqa: F401  (registers queries)
    from civictext.plans.catalog import QUERIES
    out = QUERIES["request_validation"](spark, "/root/testdata/sf0.001")
    bad = out.where(~F.col("valid"))
    assert bad.where(F.col("reason").isNull()).count() == 0


def test_staged_script_language_equals_the_column_rule(spark):
    from civictext.operators.language import script_language, with_script_language
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("t"))
    extra = spark.createDataFrame(
        [(-1, "पानी की समस्या है"), (-2, "రోడ్డు పాడైంది road"), (-3, "water पानी leak leak leak"), (-4, ""),
         (-5, None), (-6, "தமிழ் text বাংলা")], "doc_id long, t string")
    d = docs.unionByName(extra)
    got = with_script_language(d, "t", "a").withColumn("b", script_language(F.col("t")))
    letterless = spark.createDataFrame([("12345 678",), ("!!! ...",), ("",)], "t string")
    assert {r.a for r in with_script_language(letterless, "t", "a").collect()} == {"unknown"}
    bad = got.where(~F.col("a").eqNullSafe(F.col("b"))).count()
    assert bad == 0
    langs = {r.doc_id: r.a for r in got.where(F.col("doc_id") < 0).collect()}
    assert langs[-1] == "hi" and langs[-2] == "te" and langs[-4] == "unknown"


def test_rules_parsed_once_equal_the_column_built_rules(spark):
    from civictext.functions.rules import lowered_text
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("text").alias("clean_text"))
    extra = spark.createDataFrame([("Water LEAK near the bus stop",), ("आपातकालीन",), ("",), (None,)], "clean_text string")
    d = lowered_text(docs.unionByName(extra))
    col = F.col("_low")
    got = d.select(topic_rule("_low", lowered=True).alias("t1"), topic_rule(col, lowered=True).alias("t2"),
                   api_urgency("_low", lowered=True).alias("a1"), api_urgency(col, lowered=True).alias("a2"),
                   urgency_label("_low", lowered=True).alias("u1"), urgency_label(col, lowered=True).alias("u2"))
    for a, b in (("t1", "t2"), ("a1", "a2"), ("u1", "u2")):
        assert got.where(~F.col(a).eqNullSafe(F.col(b))).count() == 0, a


def test_cleaning_patterns_match_what_the_steps_match(spark):
    """Every character between letters, blanks and its own kind: the faster patterns change what the plain steps change, no single blank is a match."""
    from civictext.functions import text as X
    c = F.expr("CASE WHEN id < 55296 OR id > 57343 THEN decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') END")
    chars = spark.range(1, 0x1FFFF).select(c.alias("c")).where("c IS NOT NULL")
    rows = chars.select(F.explode(F.array(*[F.concat(*[F.col("c") if k == "c" else F.lit(k) for k in form]) for form in
                                            (("a", "c", "b"), ("a ", "c", " b"), ("c", "c", "z  Z"), ("A b", "c", " "))])).alias("t"))
    for extended in (False, True):
        plain = F.col("t")
        for pattern, repl in X.clean_steps(extended):
            plain = F.regexp_replace(plain, pattern, repl)
        assert rows.where(clean_text("t", extended) != F.btrim(plain, F.lit(" "))).count() == 0
    assert rows.where(F.concat_ws(" ", tokens("t")) != X.spaced_tokens("t")).count() == 0
    single = spark.createDataFrame([("three plain words",)], "t string")
    assert single.select(F.col("t").rlike(X._collapse_pattern(False)).alias("m")).first().m is False


def test_urgency_by_batch_equals_the_column_rule(spark):
    from civictext.functions import lexicons as L
    from civictext.functions.rules import urgency_label_by_batch
    words = [k for _, ks in L.TRAINING_URGENCY for k in ks]
    texts = [f"x{k}y" for k in words] + [f"{a} {b}" for a, b in zip(words, reversed(words))] + ["", None, "nothing here", "no  water", "a+b (c) [d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    odd = [("HIGH", ["a+b (c)", "["]), ("MEDIUM", []), ("CRITICAL", ["x"])]
    for lexicon in (None, odd):
        got = df.select("t", urgency_label("t", lexicon, lowered=True).alias("a"), urgency_label_by_batch("t", lexicon).alias("b")).collect()
        assert len(got) == len(texts) and all(r.a == r.b for r in got)
