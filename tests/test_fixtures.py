"""Hand-made tables: complaint and news preparation, column discovery, clashes, missing words."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from civictext.functions import lexicons as L
from civictext.operators import prepare as P
from civictext.plans import jobs as J
from civictext.session import clear_scratch, scratch_path
from civictext.sources import csvfiles as C


def test_complaints_311_rows(spark):
    text = "the light at the corner is broken again"
    rows = [(1, None, "Repair", text, "North"), (2, "Street", None, text, "North"), (3, "Street", "Repair", text, None),
            (4, "A", "B", "c", "D"), (5, "Street", "Repair", text, "South"), (6, "Street", "Repair", text, "South"), (7, "Street", "Repair", None, "East")]
    df = spark.createDataFrame(rows, "row_id long, Category string, `Request Type` string, `Request Details` string, Neighborhood string")
    got = {r.row_id: r for r in J.prepare_complaints(df).collect()}
    assert set(got) == {2, 3, 5, 6}  # no category or details: out; too short: out; the exact duplicate stays
    assert got[2].clean_text == f"Street - nan - {text} at North" and got[3].clean_text.endswith("at Unknown")
    assert got[5].neighborhood == "South" and got[5].request_type == "Repair" and got[5].urgency and got[5].language == "en"


def test_news_rows(spark):
    long = "a very long article " * 60
    same = "the same article text in both files"
    rows = [(1, None, "x" * 40, "FAKE"), (2, "t" * 40, None, "FAKE"), (3, "t", long + "one", "FAKE"), (4, "t", long + "two", "REAL"),
            (5, "t", same, "FAKE"), (6, "t", same, "REAL"), (7, "t", "y" * 25, "REAL"), (8, "t", "y" * 27, "REAL")]
    df = spark.createDataFrame(rows, "row_id long, title string, text string, label string")
    got = {r.row_id: r for r in J.prepare_news(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8}  # the second copy and the 28-character text are out
    assert got[1].clean_text == ". " + "x" * 40 and got[2].clean_text == "t" * 40 + "." and len(got[3].clean_text) > 512
    assert len(got[8].clean_text) == 30
    cut = {r.row_id for r in J.prepare_news(df, max_chars=512).collect()}
    assert cut == {1, 2, 3, 5, 8}  # cut at 512 characters, the two long texts are equal
    assert J.prepare_news(df, per_label=2).count() <= 4


def test_column_discovery(spark):
    known = spark.createDataFrame([("a", "b")], ["Descriptor", "Complaint Type"])
    assert C.discover_columns(known) == ("Descriptor", "Complaint Type")
    assert C.discover_columns(known.select("Complaint Type")) == ("Complaint Type", None)
    by_length = spark.createDataFrame([("abc", "a text of more than twenty characters")], ["code", "words"])
    assert C.discover_columns(by_length) == ("words", None)
    with pytest.raises(ValueError):
        C.discover_columns(by_length.select("code"))


def test_clashing_text_column(spark):
    df = spark.createDataFrame([(1, "a longer description", "other")], "row_id long, Descriptor string, text string")
    r = P.prepare(df, "Descriptor", key="row_id").first()
    assert r.text == "a longer description" and r.text_orig == "other"


def test_missing_words_and_column_list(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="civictext-na-"), "t.csv")
    with open(path, "w") as f:
        f.write('a,b,c\nNA,null,1\n"n/a",words,2\nNAN,"",3\n')
    rows = [tuple(r) for r in C.read_csv(spark, path, columns=["b", "a"]).collect()]
    assert rows == [(None, None), ("words", None), (None, "NAN")] and "null" in L.NA_WORDS
    typed = C.read_csv(spark, path, infer=True)
    assert dict(typed.dtypes)["c"] == "int" and typed.agg(F.sum("c")).first()[0] == 6


def test_scratch_is_one_folder_of_the_application(spark):
    path = scratch_path(spark, "t")
    assert spark.sparkContext.applicationId in path and path.rsplit("/", 1)[0] == scratch_path(spark, "u").rsplit("/", 1)[0]
    assert callable(clear_scratch)
