"""A text classifier trained in epochs: validation F1 after each, patience, the best epoch kept, resumable.

Softmax regression on hashed TF-IDF features. The features are made once and written. In an epoch every task goes
once over its own training rows in small batches, starting from the common weights, and the weights that the tasks
end with are averaged by rows (local steps with averaging; step sizes adapt to each feature). Then the validation rows are
scored and their weighted F1 is noted. Training ends after ``patience`` epochs without a gain, or ``max_epochs``; the
model is that of the best epoch.

Each epoch's state is written to its own folder below ``state``, so a driver that starts again with the same
folder and data goes on after the last committed epoch. What reaches the driver is the model: ``FEATURES * classes``
numbers, sent in chunks, and one confusion matrix an epoch.

Defined results: a null or wordless text has no features and is judged by the classes' offsets. A class that the
training rows lack is never predicted; labels are coded in alphabetical order; a null label takes no part in training.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import tokens
from ..session import scratch_path
from ..sources.store import checkpoint_table, is_complete, path_exists, write_table

FEATURES = 1 << 16
FEATURE_TYPE, COUNT_TYPE = "<u2", "<i4"  # as packed; a feature is below 1 << 16
MAX_EPOCHS = 15
PATIENCE = 3
STEP = 0.5
BATCH = 32
DECAY = 1e-5
CHUNKS = 16
STEPS_ROWS = 8 * BATCH  # training rows whose values are made at a time
SLICE_ROWS = 512  # texts whose features are made or scored at a time: a kernel's arrays do not follow the Arrow batch


@dataclass
class EpochModel:
    """Labels in code order, feature weights and what each epoch reached."""

    labels: list[str]
    text_col: str
    idf: np.ndarray
    weights: np.ndarray  # (FEATURES + 1, classes); the last row are the offsets
    history: list[tuple[int, float, bool]] = field(default_factory=list)  # epoch, weighted F1, best so far

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.labels, self.text_col, self.idf.tobytes(), self.weights.tobytes(), [{"epoch": e, "f1": f, "kept": k} for e, f, k in self.history])]
        write_table(spark.createDataFrame(row, "labels array<string>, text_col string, idf binary, weights binary, history array<struct<epoch:int,f1:double,kept:boolean>>"), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "EpochModel":
        r = spark.read.parquet(path).first()
        weights = np.frombuffer(r["weights"], np.float64).reshape(-1, len(r["labels"]))
        return EpochModel(list(r["labels"]), r["text_col"], np.frombuffer(r["idf"], np.float64), weights, [(h["epoch"], h["f1"], h["kept"]) for h in r["history"]])


def buckets(c) -> Column:
    """The hashed feature of every word token of a text."""
    return F.transform(F.coalesce(tokens(c), F.array().cast("array<string>")), lambda w: F.pmod(F.hash(w), F.lit(FEATURES)))


def _counts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, feature, count)`` of the distinct features of each row, by row."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    key = np.repeat(np.arange(len(sizes)), sizes) * FEATURES + column.flatten().to_numpy(zero_copy_only=False)
    key, count = np.unique(key, return_counts=True)
    return key // FEATURES, key % FEATURES, count


def _packed(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """One binary a row of the values between its ends: Spark moves it whole, where a list is moved number by number."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The number of values of each row, and all rows' values."""
    column = column.cast(pa.binary())
    if len(column) == 0:
        return np.zeros(0, np.int64), np.zeros(0, kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return np.diff(ends) // np.dtype(kind).itemsize, flat.view(kind)


def _featured(batches):
    """Rows with their features and counts packed, made for ``SLICE_ROWS`` texts at a time."""
    for whole in batches:
        for a in range(0, whole.num_rows, SLICE_ROWS):
            b = whole.slice(a, SLICE_ROWS)
            row, feature, count = _counts(b.column("b"))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), b.column("weight"), b.column("valid"), _packed(ends, feature.astype(FEATURE_TYPE)), _packed(ends, count.astype(COUNT_TYPE))],
                ["label", "weight", "valid", "feature", "count"])


def _document_frequencies(batches):
    seen = np.zeros(FEATURES, np.int64)
    for b in batches:
        seen += np.bincount(_unpacked(b.column("feature"), FEATURE_TYPE)[1], minlength=FEATURES)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["feature", "n"])


def _values(row: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """TF-IDF values of unit length a row."""
    x = count * idf[feature]
    size = np.sqrt(np.bincount(row, x * x, rows))
    return x / np.maximum(size, 1e-300)[row]


def _probabilities(row, feature, x, rows: int, w: np.ndarray) -> np.ndarray:
    z = np.empty((rows, w.shape[1]))
    for k in range(w.shape[1]):
        z[:, k] = np.bincount(row, x * w[:, k].take(feature), rows)
    z += w[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _rows_of(b: pa.RecordBatch, at: np.ndarray, idf: np.ndarray):
    part = b.take(pa.array(at))
    sizes, feature = _unpacked(part.column("feature"), FEATURE_TYPE)
    row = np.repeat(np.arange(len(at)), sizes)
    feature, count = feature.astype(np.int64), _unpacked(part.column("count"), COUNT_TYPE)[1].astype(np.int64)
    return row, feature, _values(row, feature, count, idf, len(at)), part.column("label").to_numpy(), part.column("weight").to_numpy()


def _epoch(shared, idf, number: int):
    """One pass over a task's training rows; the weights (and step sizes) it ends with, times its rows, in chunks."""
    def run(batches):
        w, g = (np.array(a, order="F") for a in shared.value)  # a class's weights lie together
        seen = 0
        rng = np.random.default_rng(number)
        met, place_of = np.zeros(FEATURES, bool), np.empty(FEATURES, np.int64)
        for b in batches:
            train = rng.permutation(np.flatnonzero(~b.column("valid").to_numpy(zero_copy_only=False)))
            seen += len(train)
            for start in range(0, len(train), STEPS_ROWS):
                rows, features, values, labels, weights = _rows_of(b, train[start:start + STEPS_ROWS], idf.value)
                for a in range(0, len(labels), BATCH):
                    label, weight = labels[a:a + BATCH], weights[a:a + BATCH]
                    n = len(label)
                    lo, hi = np.searchsorted(rows, (a, a + n))
                    row, feature, x = rows[lo:hi] - a, features[lo:hi], values[lo:hi]
                    error = _probabilities(row, feature, x, n, w)
                    error[np.arange(n), label] -= 1
                    error *= weight[:, None] / n
                    met[feature] = True
                    at = np.flatnonzero(met)  # the distinct features in order, without a sort
                    met[at] = False
                    place_of[at] = np.arange(len(at))
                    place, both = place_of.take(feature), np.append(at, FEATURES)
                    offsets = error.sum(axis=0)
                    for k in range(w.shape[1]):
                        wk, gk = w[:, k], g[:, k]
                        old = wk.take(both)
                        grad = np.append(np.bincount(place, x * error[:, k].take(row), len(at)), offsets[k]) + DECAY * old
                        size = gk.take(both) + grad * grad
                        gk[both] = size
                        wk[both] = old - STEP * grad / np.sqrt(size)
        if seen:
            for c, (part, steps) in enumerate(zip(np.array_split(w, CHUNKS), np.array_split(g, CHUNKS))):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([seen], pa.int64()), pa.array([(part * seen).tobytes()], pa.binary()),
                                                  pa.array([(steps * seen).tobytes()], pa.binary())], ["chunk", "n", "w", "g"])
    return run


def _summed(table: pa.Table) -> pa.Table:
    """One row a chunk: the sums over all tasks, added in a fixed order."""
    order = np.lexsort(([zlib.crc32(x) for x in table.column("w").to_pylist()], table.column("n").to_numpy()))
    add = lambda name: sum(np.frombuffer(table.column(name)[int(i)].as_py(), np.float64) for i in order).tobytes()
    return pa.table({"chunk": table.column("chunk")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                     "w": pa.array([add("w")], pa.binary()), "g": pa.array([add("g")], pa.binary())})


def _confusion(shared, idf, classes: int):
    def run(batches):
        table = np.zeros((classes, classes))
        for b in batches:
            valid = np.flatnonzero(b.column("valid").to_numpy(zero_copy_only=False))
            for start in range(0, len(valid), SLICE_ROWS):
                at = valid[start:start + SLICE_ROWS]
                row, feature, x, label, _ = _rows_of(b, at, idf.value)
                np.add.at(table, (label, np.argmax(_probabilities(row, feature, x, len(at), shared.value[0]), axis=1)), 1)
        a, p = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(p, pa.int32()), pa.array(table[a, p].astype(np.int64))], ["actual", "predicted", "n"])
    return run


def weighted_f1(table: np.ndarray) -> float:
    """Weighted F1 of a confusion matrix (actual by predicted)."""
    hit, actual, predicted = np.diag(table), table.sum(axis=1), table.sum(axis=0)
    f1 = np.where(actual + predicted > 0, 2 * hit / np.maximum(actual + predicted, 1), 0.0)
    return float((f1 * actual).sum() / max(1, actual.sum()))


def train_epochs(df: DataFrame, text_col: str = "clean_text", label_col: str = "urgency", key: str = "row_id", seed: int = L.SEED,
                 max_epochs: int = MAX_EPOCHS, patience: int = PATIENCE, state: str | None = None) -> tuple[EpochModel, DataFrame]:
    """Fit on 80 % of the rows (a fifth of them for validation); returns (model of the best epoch, the other rows).

    ``state``: folder of the epochs' states; an unfinished run with the same folder and data goes on there.
    """
    from .prepare import stratified_split
    from .urgency import with_class_weights

    spark = df.sparkSession
    rows = checkpoint_table(spark, df.select(key, text_col, label_col).where(F.col(label_col).isNotNull()), "epoch-input")
    split = checkpoint_table(spark, stratified_split(rows, label_col, key, 0.2, seed), "epoch-split")
    tr, te = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    labels = sorted(r[0] for r in tr.select(label_col).distinct().collect())  # one row a class
    if not labels:
        raise ValueError("no labelled rows to train on")
    code = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)).cast("int") - 1
    valid = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(5)) == 0
    made = (with_class_weights(tr, label_col).select(code.alias("label"), F.col("weight").cast("double").alias("weight"), valid.alias("valid"), buckets(F.col(text_col)).alias("b"))
            .mapInArrow(_featured, "label int, weight double, valid boolean, feature binary, count binary"))
    made = checkpoint_table(spark, made, "epoch-features")
    idf = np.zeros(FEATURES)
    n = made.count()
    for r in made.select("feature").mapInArrow(_document_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most FEATURES rows
        idf[r["feature"]] = np.log((n + 1) / (r["n"] + 1))
    shared_idf = spark.sparkContext.broadcast(idf)

    state = state or scratch_path(spark, "epochs")
    w, g = np.zeros((FEATURES + 1, len(labels))), np.full((FEATURES + 1, len(labels)), 1e-4)
    best, history, epoch, waited = w, [], 0, 0
    while epoch < max_epochs and waited < patience:
        path = f"{state}/epoch={epoch + 1}"
        if path_exists(spark, path) and is_complete(spark, path):
            r = spark.read.parquet(path).first()
            w, g, f1 = np.frombuffer(r["w"], np.float64).reshape(w.shape), np.frombuffer(r["g"], np.float64).reshape(w.shape), r["f1"]
        else:
            shared = spark.sparkContext.broadcast((w, g))
            out = (made.where("NOT valid").mapInArrow(_epoch(shared, shared_idf, epoch), "chunk int, n long, w binary, g binary").groupBy("chunk")
                   .applyInArrow(_summed, "chunk int, n long, w binary, g binary").collect())  # CHUNKS rows; sorted by Spark, the sums would be made twice
            out.sort(key=lambda r: r["chunk"])
            if out:  # else all rows are for validation
                w, g = (np.concatenate([np.frombuffer(r[c], np.float64) / r["n"] for r in out]).reshape(w.shape) for c in ("w", "g"))
            now = spark.sparkContext.broadcast((w, g))
            table = np.zeros((len(labels), len(labels)))
            for r in made.where("valid").mapInArrow(_confusion(now, shared_idf, len(labels)), "actual int, predicted int, n long").groupBy("actual", "predicted").agg(F.sum("n").alias("n")).collect():
                table[r["actual"], r["predicted"]] = r["n"]
            f1 = weighted_f1(table)
            write_table(spark.createDataFrame([(f1, w.tobytes(), g.tobytes())], "f1 double, w binary, g binary"), path)
            shared.unpersist()
            now.unpersist()
        epoch += 1
        better = not history or f1 > max(f for _, f, _ in history)
        history.append((epoch, f1, better))
        best, waited = (w, 0) if better else (best, waited + 1)
    last = max(e for e, _, k in history if k)
    return EpochModel(labels, text_col, idf, best, [(e, f, e == last) for e, f, _ in history]), te


def predict_epochs(model: EpochModel, df: DataFrame, out: str = "predicted") -> DataFrame:
    """``df`` with the predicted label, its probability (``confidence``) and a label -> probability map."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.idf))
    names, kept = list(model.labels), [c for c in df.columns if c not in (out, "confidence", "probabilities")]

    def run(batches):
        w, idf = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(a, SLICE_ROWS)
                row, feature, count = _counts(b.column("_b"))
                p = _probabilities(row, feature, _values(row, feature, count, idf, b.num_rows), b.num_rows, w)
                offs = pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([names[i] for i in np.argmax(p, axis=1)], pa.string()),
                                                  pa.ListArray.from_arrays(offs, pa.array(p.reshape(-1)))], [*b.schema.names[:-1], out, "_p"])

    rows = df.select(*[F.col(f"`{c}`") for c in kept], buckets(F.col(model.text_col)).alias("_b"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    scored = rows.mapInArrow(run, ", ".join([*fields, f"`{out}` string", "_p array<double>"]))
    return scored.select(*[F.col(f"`{c}`") for c in kept], out, F.round(F.array_max("_p"), 4).alias("confidence"),
                         F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.transform("_p", lambda v: F.round(v, 4))).alias("probabilities"))


def epoch_table(spark: SparkSession, model: EpochModel) -> DataFrame:
    """``(epoch, weighted_f1, kept)`` of a training run."""
    return spark.createDataFrame([(e, round(f, 4), k) for e, f, k in model.history], "epoch int, weighted_f1 double, kept boolean")
