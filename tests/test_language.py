"""Language by character n-grams: Hindi and Marathi share a script, unseen words, null and wordless rows, brute force."""

import math
from collections import Counter

from pyspark.sql import functions as F

from civictext.functions.text import supported_language
from civictext.functions import lexicons as L
from civictext.operators import language as LG

TRAIN = [
    ("hi", "सड़क पर पानी भर गया है और लोग परेशान हैं"), ("hi", "बिजली नहीं है कृपया जल्दी ठीक करें"), ("hi", "यह कचरा कई दिनों से पड़ा है"),
    ("hi", "नगर निगम को शिकायत दी गई है"), ("hi", "बच्चों के लिए खतरा है"), ("mr", "रस्त्यावर पाणी साचले आहे आणि लोक त्रस्त आहेत"),
    ("mr", "वीज नाही कृपया लवकर दुरुस्त करा"), ("mr", "हा कचरा अनेक दिवसांपासून पडला आहे"), ("mr", "महानगरपालिकेला तक्रार दिली आहे"),
    ("mr", "मुलांसाठी धोका आहे"), ("en", "the street is full of water and people are upset"), ("en", "there is no power please repair it"), (None, "no label at all")]
TEST = [("hi", "पानी नहीं आ रहा है"), ("mr", "पाणी येत नाही आहे"), ("hi", "लोगों की शिकायतें हैं"), ("mr", "लोकांच्या तक्रारी आहेत"), ("en", "people are waiting for repairs")]


def grams(word):
    w = f"_{word}_"
    return [w[i:i + n] for n in LG.NGRAM_SIZES for i in range(len(w) - n + 1)]


def brute(rows, texts):
    import regex

    words = lambda t: regex.findall(LG.NGRAM_WORD, (t or "").lower())
    counts = {}
    docs = Counter(lang for lang, _ in rows if lang)
    for lang, t in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(g for w in words(t) for g in grams(w))
    v = len(set().union(*counts.values()))
    out = []
    for t in texts:
        score = {}
        for lang, c in counts.items():
            total = sum(c.values()) + v
            score[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((c[g] + 1) / total) for w in words(t) for g in grams(w))
        out.append(min(score, key=lambda x: (-score[x], x)))
    return out


def test_marathi_and_hindi_are_told_apart(spark):
    train = spark.createDataFrame(TRAIN, "lang string, text string")
    texts = [t for _, t in TEST] + [t for lang, t in TRAIN if lang] + [None, "", "123 _", "xyzzy"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("n", F.lit("clash"))
    found = LG.detect_by_ngrams(rows.select("id", "text"), LG.train_ngram_profile(train, "text", "lang"), "text", "id").withColumn(
        "language", supported_language(F.col("raw_language"), L.SUPPORTED_LANGUAGES))
    got = {r.id: r for r in found.collect()}
    assert [got[i].raw_language for i in range(len(texts))] == brute(TRAIN, texts)
    assert [got[i].language for i in range(len(TEST))] == [lang for lang, _ in TEST] and "mr" in {r.language for r in got.values()}
    assert LG.detect_by_ngrams(rows.limit(0), LG.train_ngram_profile(train, "text", "lang"), "text", "id").count() == 0


def test_a_profile_beyond_the_broadcast_bound_is_joined_alike(spark):
    train = spark.createDataFrame(TRAIN, "lang string, text string")
    profile = LG.train_ngram_profile(train, "text", "lang")
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TEST)], "id long, text string")
    plan = lambda n: sorted(map(tuple, LG.detect_by_ngrams(rows, profile, "text", "id", max_cells=n).collect()))
    assert plan(0) == plan(2_000_000)
    words = LG.train_language_profile(train.where("lang is not null"), "text", "lang")
    both = [sorted(map(tuple, LG.detect_language(rows, words, "text", "id", max_profile_rows=n).collect())) for n in (0, 2_000_000)]
    assert both[0] == both[1]
