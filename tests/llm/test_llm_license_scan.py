"""Dice over word bigrams against plain Python."""

import re

from edge_rows import documents, empty

from llm import license_scan as L


def grams(t):
    w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
    return set(zip(w, w[1:]))


def plain(text, threshold=L.THRESHOLD):
    text = text or ""
    blocks = {*text.split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text), text}
    best = []
    for b in blocks:
        g = grams(b)
        found = [(-2.0 * len(g & grams(t)) / (len(g) + len(grams(t))), name) for name, ts in L.TEMPLATES.items() for t in ts if g]
        found = [f for f in found if f[0] <= -threshold]
        if found:
            best.append(min(found))
    return (min(best)[1], -min(best)[0], ",".join(sorted({n for _, n in best}))) if best else (None, 0.0, "")


def test_dice_equals_the_plain_version(spark):
    mit = L.TEMPLATES["MIT"][2]
    texts = ["Released under the MIT License.", "released   UNDER the mit licence", "Some prose.\nAll rights reserved.\nMore", mit, mit.replace("Software", "Program"),
             "\n".join(mit.split(", ")), "Intro\n\n" + "\n".join(mit.split(", ")) + "\n\nend", "This work is licensed under the GNU General Public License, version 2 or 3.",
             "Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0.", "x", "", None, "a_b c", " ".join([mit] * 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.score, r.licenses) for r in L.scan(df).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-12 and got[i][2] == want[2], (t, got[i], want)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = L.scan(docs).collect()
    assert len(rows) == len(text) and any(r.license for r in rows)
    for r in rows:
        want = plain(text[r.doc_id])
        assert (r.license, r.licenses) == (want[0], want[2]) and abs(r.score - want[1]) < 1e-12


def test_edge_rows(spark):
    docs = documents(spark)
    rows = L.scan(docs).collect()
    assert len(rows) == docs.count() and {r.license for r in rows} == {None}
    assert L.scan(empty(spark)).count() == 0
    plan = L.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
