"""Training in epochs: patience, the kept epoch, resuming, reload, and label order."""

import random

import numpy as np
from pyspark.sql import functions as F

from civictext.operators import epochs as E
from civictext.operators import urgency as U
from civictext.sources.store import path_exists


def labelled(spark, n=400, seed=1):
    rng = random.Random(seed)
    marks = {"LOW": ["park", "bench"], "MEDIUM": ["delay", "queue"], "HIGH": ["leak", "damage"], "CRITICAL": ["fire", "flood"]}
    rows = []
    for i in range(n):
        label = rng.choice(list(marks))
        words = [rng.choice(["the", "a", "street", "city", "house", "road"]) for _ in range(rng.randint(3, 12))] + rng.sample(marks[label], rng.randint(1, 2))
        rng.shuffle(words)
        rows.append((i, " ".join(words), label))
    rows += [(n, None, "LOW"), (n + 1, "", "LOW"), (n + 2, "no label", None)]
    return spark.createDataFrame(rows, "row_id long, clean_text string, urgency string").repartition(3)


def test_epochs_learn_keep_the_best_and_stop(spark):
    model, test = E.train_epochs(labelled(spark), max_epochs=12, patience=2)
    assert model.labels == ["CRITICAL", "HIGH", "LOW", "MEDIUM"]
    f1 = [f for _, f, _ in model.history]
    kept = [e for e, _, k in model.history if k]
    assert kept == [f1.index(max(f1)) + 1] and (len(f1) == 12 or len(f1) - kept[0] == 2)  # two epochs without a gain end it
    scores = U.evaluate(U.predict(model, test), "urgency", "predicted").first()
    assert scores.accuracy > 0.9 and scores.weighted_f1 > 0.9 and test.where("urgency is null").count() == 0
    table = E.epoch_table(spark, model).orderBy("epoch").collect()
    assert [(r.epoch, r.kept) for r in table] == [(e, k) for e, _, k in model.history]


def test_a_lost_run_goes_on_after_its_last_epoch(spark, tmp_path):
    data = labelled(spark, 200)
    whole, _ = E.train_epochs(data, max_epochs=4, patience=9, state=f"{tmp_path}/a")
    E.train_epochs(data, max_epochs=2, patience=9, state=f"{tmp_path}/b")  # the driver is lost here
    written = spark.read.parquet(f"{tmp_path}/b/epoch=2").first().f1
    again, _ = E.train_epochs(data, max_epochs=4, patience=9, state=f"{tmp_path}/b")
    assert path_exists(spark, f"{tmp_path}/b/epoch=4/_SUCCESS") and again.history[1][1] == written
    assert [e for e, _, _ in again.history] == [1, 2, 3, 4] and len(whole.history) == 4


def test_saved_model_predicts_the_same(spark, tmp_path):
    data = labelled(spark, 150)
    model, _ = E.train_epochs(data, max_epochs=2)
    U.save(model, f"{tmp_path}/m")
    again = U.load(f"{tmp_path}/m")
    assert isinstance(again, E.EpochModel) and again.history == model.history and U.label_order(again) == U.label_order(model)
    first = {r.row_id: r for r in U.predict(model, data.drop("urgency")).collect()}
    for r in U.predict(again, data.drop("urgency")).collect():
        assert r == first[r.row_id] and abs(sum(r.probabilities.values()) - 1) < 1e-3
        assert r.predicted == max(r.probabilities, key=lambda k: (r.probabilities[k], [-ord(c) for c in k])) or list(r.probabilities.values()).count(r.confidence) > 1
    assert U.predict(model, data.limit(0)).count() == 0


def test_weighted_f1():
    table = np.array([[8, 2], [1, 9]])
    p0, r0, p1, r1 = 8 / 9, 0.8, 9 / 11, 0.9
    assert abs(E.weighted_f1(table) - (10 * 2 * p0 * r0 / (p0 + r0) + 10 * 2 * p1 * r1 / (p1 + r1)) / 20) < 1e-12
    assert E.weighted_f1(np.zeros((2, 2))) == 0.0


def test_regression_pipeline_is_unchanged(spark):
    data = labelled(spark, 150).where(F.col("urgency").isNotNull()).fillna("")
    model, test = U.train(data, reg_params=(0.001, 0.01), max_iter=20)
    assert U.label_order(model) == ["CRITICAL", "HIGH", "LOW", "MEDIUM"]
    assert U.evaluate(U.predict(model, test), "urgency", "predicted").first().accuracy > 0.8


def test_kernels_hold_a_slice_of_a_batch(spark):
    """10,000 texts of 400 words in one batch: beside the batch the kernels hold a slice's arrays."""
    import tracemalloc

    import pyarrow as pa

    n, words = 10_000, 400
    b = np.random.default_rng(1).integers(0, E.FEATURES, n * words).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words), pa.int32()), pa.array(b))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n) % 2, pa.int32()), pa.array(np.ones(n)), pa.array(np.ones(n, bool)), lists], ["label", "weight", "valid", "b"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in E._featured([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 40 << 20, peak


def test_features_are_packed_and_read_back_from_any_slice():
    """A row's features and counts are one binary each; slices and empty rows keep their own values."""
    import pyarrow as pa

    texts = [[1, 5, 5], [], [E.FEATURES - 1] * 70_000, [7], []]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 5, pa.int32()), pa.array([1.0] * 5), pa.array([False] * 5), pa.array(texts, pa.list_(pa.int32()))], ["label", "weight", "valid", "b"])
    made, = E._featured([batch])
    assert [made.schema.field(c).type for c in ("feature", "count")] == [pa.binary(), pa.binary()]
    for a, n in ((0, 5), (1, 2), (2, 3), (4, 1), (5, 0)):
        part = made.slice(a, n)
        sizes, feature = E._unpacked(part.column("feature"), E.FEATURE_TYPE)
        _, count = E._unpacked(part.column("count"), E.COUNT_TYPE)
        want = [sorted((f, t.count(f)) for f in set(t)) for t in texts[a:a + n]]
        assert sizes.tolist() == [len(w) for w in want] and list(zip(feature.tolist(), count.tolist())) == [p for w in want for p in w]
