"""Stage reuse, pluggable encoder, and the analysis job's fallback path."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from civictext.functions import lexicons as L
from civictext.operators import topics as T
from civictext.operators import urgency as U
from civictext.operators import vectors as V
from civictext.plans import jobs as J
from civictext.sources.store import materialize


def test_materialize_skips_committed_stage(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="civictext-stage-"), "s")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert materialize(spark, "s", build, path).count() == 5
    assert materialize(spark, "s", build, path).count() == 5
    assert len(calls) == 1


def test_pluggable_encoder_batches(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], "id long, t string")

    def enc(texts):
        return np.array([[len(t), 1.0] for t in texts])

    got = {r.id: r.embedding for r in V.encode_with(df, "t", "id", enc, 2).collect()}
    assert got[2] == [5.0, 1.0]  # blank text is encoded as the word "empty"
    assert got[1] == [3.0, 1.0]


def test_hashed_embedding_unit_length(spark):
    df = spark.createDataFrame([("water water road",), ("",)], "t string")
    rows = df.select(V.hashed_embedding(F.col("t")).alias("e")).collect()
    for r in rows:
        assert len(r.e) == 384 and abs(sum(x * x for x in r.e) - 1.0) < 1e-9


def test_analyze_rules_without_index(spark):
    df = spark.createDataFrame([(1, "Emergency! Building collapsed")], "id long, text string")
    r = J.analyze(df, "id").first()
    assert r.topic.topic_id == 6 and r.urgency.urgency == "CRITICAL"
    assert r.urgency.probabilities["CRITICAL"] == 0.8 and r.similarity.method == "unavailable"
    assert r.similarity.reason == L.REASON_NO_INDEX and r.similarity.similar == []


def test_materialize_reuses_a_stage_on_a_file_uri(spark):
    path = "file://" + os.path.join(tempfile.mkdtemp(prefix="civictext-stage-"), "s")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert materialize(spark, "s", build, path).count() == materialize(spark, "s", build, path).count() == 3
    assert len(calls) == 1


def labelled_texts(spark):
    words = {"LOW": "park bench tree", "MEDIUM": "noise street light", "HIGH": "water leak road", "CRITICAL": "fire collapse smoke"}
    rows = [(i, f"{words[c]} number {i % 7}", c) for i, c in enumerate(list(words) * 12)]
    return spark.createDataFrame(rows, "row_id long, clean_text string, urgency string")


def test_urgency_model_probabilities_and_reload(spark):
    df = labelled_texts(spark)
    model, _ = U.train(df, reg_params=(0.01,), max_iter=20)
    assert U.label_order(model) == ["CRITICAL", "HIGH", "LOW", "MEDIUM"]
    path = os.path.join(tempfile.mkdtemp(prefix="civictext-model-"), "m")
    U.save(model, path)
    unlabelled = df.drop("urgency")
    first = {r.row_id: r for r in U.predict(model, unlabelled).collect()}
    again = {r.row_id: r for r in U.predict(U.load(path), unlabelled).collect()}
    for k, r in first.items():
        assert set(r.probabilities) == set(U.label_order(model)) and abs(sum(r.probabilities.values()) - 1) < 1e-3
        assert max(r.probabilities, key=r.probabilities.get) == r.predicted
        assert abs(r.confidence - max(r.probabilities.values())) < 1e-9
        assert (again[k].predicted, again[k].probabilities) == (r.predicted, r.probabilities)


def test_analyze_with_models_names_its_topics(spark):
    df = labelled_texts(spark)
    vecs = df.select("row_id", "clean_text", V.hashed_embedding(F.col("clean_text")).alias("embedding"))
    tm = T.fit_topics(vecs, "embedding", n_topics=4, dims=3, min_topic_size=3)
    path = os.path.join(tempfile.mkdtemp(prefix="civictext-topics-"), "t")
    tm.save(path)
    again = T.TopicModel.load(spark, path)
    assigned = T.predict_topics(tm, vecs, ["row_id", "clean_text"])
    same = T.predict_topics(again, vecs, ["row_id", "clean_text"])
    assert assigned.exceptAll(same).count() == 0
    words = T.class_term_weights(assigned, "topic_id", "clean_text")
    model, _ = U.train(df, reg_params=(0.01,), max_iter=20)
    rows = J.analyze(df.withColumnRenamed("clean_text", "text"), "row_id", topic_model=tm, topic_info=T.topic_info(assigned, words),
                     topic_words=words, urgency_model=model).collect()
    assert len(rows) == 48
    assert all(r.topic.topic_label.startswith(f"{r.topic.topic_id}_") and r.topic.top_keywords for r in rows)
    assert all(abs(sum(r.urgency.probabilities.values()) - 1) < 1e-3 and r.urgency.method == "logistic-regression" for r in rows)


def test_stored_index_layouts_are_reloaded(spark):
    df = labelled_texts(spark)
    rows = df.select("row_id", V.hashed_embedding(F.col("clean_text")).alias("embedding"), F.col("clean_text").alias("text"))
    base = tempfile.mkdtemp(prefix="civictext-index-")
    for cells in (False, True):
        path = os.path.join(base, f"i{cells}")
        J.save_index(rows, path, "row_id", cells)
        index = J.load_index(spark, path, "row_id")
        assert (index.centroids is not None) == cells
        q = df.select(F.col("row_id").alias("q"), F.col("clean_text").alias("text")).where("row_id < 4")
        got = {r.q: r for r in J.similar_news(q, "q", index).collect()}
        for k, r in got.items():
            assert r.similar[0].text and abs(r.similar[0].score - 1) < 1e-6 and r.num_similar >= 1


def test_training_run_is_reused_and_complete(spark):
    from civictext.plans.job_queries import _labelled_documents
    from civictext.plans.text_queries import complaints_311
    sf = "/root/testdata/sf0.001"
    out = "file://" + os.path.join(tempfile.mkdtemp(prefix="civictext-run-"), "run")
    complaints = complaints_311(spark, sf).withColumnRenamed("doc_id", "row_id")
    news = _labelled_documents(spark, sf).withColumnRenamed("doc_id", "row_id")
    first = {r.stage: (r.status, r.rows) for r in J.train_all(spark, complaints, news, out, n_topics=4).collect()}
    assert all(s == "ok" for s, _ in first.values()), first
    assert set(first) == {"complaints", "news", "complaint_embeddings", "complaint_index", "news_embeddings", "news_index", "topics", "urgency_model"}
    # the second run gets no data: every stage must come from its committed output
    none = {r.stage: (r.status, r.rows) for r in J.train_all(spark, complaints.limit(0), news.limit(0), out, n_topics=4).collect()}
    assert none == first


def test_texts_travel_with_their_vectors(spark):
    """Unique ids: no join of texts and vectors; repeated or missing ids: the rows of the join by id."""
    prepared = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d e")], "row_id long, clean_text string")
    embedded = lambda t: t.select("row_id", V.hashed_embedding("clean_text").alias("embedding"), F.col("clean_text").alias("text"))
    rows = J.with_texts(embedded(prepared), prepared)
    assert rows.columns == ["row_id", "embedding", "text"] and "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.row_id, r.text) for r in rows.collect()} == {(1, "a b"), (2, "c"), (3, "d e")}
    odd = prepared.unionByName(spark.createDataFrame([(1, "f"), (None, "g")], prepared.schema))
    got = sorted((r.row_id, r.clean_text) for r in J.with_texts(embedded(odd), odd, "clean_text").collect())
    assert got == [(1, "a b"), (1, "a b"), (1, "f"), (1, "f"), (2, "c"), (3, "d e")]


def test_news_ingest_and_column_discovery(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="civictext-csv-"), "news.csv")
    with open(path, "w") as f:
        f.write("code,body\n1,\"the first long enough article, with a comma\"\n2,short\n3,\"the first long enough article, with a comma\"\n")
    r = J.ingest_csv(spark, path, "news").first()
    assert (r.original_rows, r.processed_rows, r.text_column, r.label_column) == (3, 1, "body", None) or r.processed_rows == 1
    import pytest
    with pytest.raises(ValueError):
        J.ingest_csv(spark, path[:-4] + ".xlsx", "news")


def test_hashed_embedding_equals_the_jvm_bucket_expression(spark):
    # the per-batch md5 in the pandas UDF must give the buckets of the JVM expression exactly
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ""), (-2, "   "), (-3, None), (-4, "Ünïcode ÉÈ straße ß 水 x_1")],
                                  "doc_id long, text string")
    d = docs.unionByName(extra)
    jvm = V._dense_from_buckets(L.EMBEDDING_DIM)(V.token_buckets(F.col("text")))
    got = d.select("doc_id", V.hashed_embedding(F.col("text")).alias("a"), jvm.alias("b"))
    assert got.where(F.col("a") != F.col("b")).count() == 0
    assert got.count() == docs.count() + 4


def test_training_writes_term_counts_once_and_fits_the_same_weights(spark, monkeypatch):
    """The texts are tokenised into one written table of term counts; the IDF weights are those of the whole pipeline."""
    from civictext.sources import store

    rows = [(i, f"{'fire flood' if i % 2 else 'park bench'} street {'house ' * (i % 3)}w{i % 7}", "HIGH" if i % 2 else "LOW") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, clean_text string, urgency string")
    made, write = {}, store.checkpoint_table
    monkeypatch.setattr(store, "checkpoint_table", lambda s, d, name: made.setdefault(name, write(s, d, name)))
    model, test = U.train(df, max_iter=5)
    assert made["urgency-terms"].columns == ["_tf", "urgency", "weight"] and "urgency-features" not in made
    idf = next(s for s in model.stages if type(s).__name__ == "IDFModel")
    train = made["urgency-split"].where("not is_test")
    plain = U.build_pipeline(max_iter=1).fit(U.with_class_weights(train, "urgency"))
    want = next(s for s in plain.stages if type(s).__name__ == "IDFModel")
    assert np.allclose(idf.idf.toArray(), want.idf.toArray()) and test.count() == 12
    assert U.predict(model, df).where("predicted = urgency").count() == 60


def test_urgency_labels_of_documents_that_are_already_prepared(spark, monkeypatch):
    """A query that has the prepared texts does not prepare the documents once more for their labels."""
    from civictext.plans import job_queries as Q

    def again(*a, **k):
        raise AssertionError("prepared twice")

    monkeypatch.setattr(Q, "prepared_documents", again)
    have = spark.createDataFrame([(1, "There was a fire"), (2, "A quiet park")], "doc_id long, clean_text string")
    got = Q.labelled_urgency(spark, None, have)
    assert got.columns == ["row_id", "clean_text", "urgency"] and got.count() == 2
