"""Rank-order profiles: a plain version of the distance, and held-out accuracy."""

import collections
import unicodedata
import zlib

from edge_rows import documents, empty

from llm import language_profiles as L
from llm.queries import QUERIES


def grams(text):
    low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    if not any(c.isalpha() for c in low):
        return collections.Counter()
    out = collections.Counter()
    for w in low.split():
        p = "\x01" + w + "\x01"
        out.update(w)
        out.update(p[i:i + 2] for i in range(len(p) - 1))
        out.update(p[i:i + 3] for i in range(len(p) - 2))
    return out


def top(counts, size):
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_distance_equals_the_plain_version(spark):
    size = 60
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    learned = collections.defaultdict(collections.Counter)
    for d, t, lang in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            learned[lang] += grams(t)
    profile = {lang: top(c, size) for lang, c in learned.items()}
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=size).collect()}
    for d, t, _ in rows:
        own = top(grams(t), size)
        away = {lang: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(own)) for lang, p in profile.items()}
        best = min(sorted(away), key=away.get)
        assert got[d].lang_pred == best and abs(got[d].score - (1 - away[best] / (size * len(own)))) < 1e-12


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op9_language"](spark, "/root/testdata/sf0.01").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(out) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    docs = documents(spark)
    rows = L.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for d in (0, 1, 2, 10):  # null, empty, blank, no letter
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert by[13].lang_pred in ("en", "de") and by[None].held_out is False
    assert L.identify(empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(1, 0)).withColumn("lang", docs["source"].isNull().cast("string").substr(9, 1))
    assert {r.lang_pred for r in L.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"} and unlabelled is not None


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    text = "Ünïcode Straße ΣΑΣ ein Wort, zwei Wörter! " * 50
    whole = L.ranked(text, 50).tolist()
    monkeypatch.setattr(L, "PIECE", 40)
    assert L.ranked(text, 50).tolist() == whole
