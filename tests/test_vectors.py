"""Hashed embeddings against a plain version; the kernel's memory and its place in the plan."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from civictext.operators import vectors as V


def plain(text, dim):
    v = np.zeros(dim)
    for w in re.findall(r"\w+", (text if (text or "").strip(" ") else "empty").lower()):
        v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    return v / max(np.linalg.norm(v), 1e-300)


def test_equals_a_plain_version_over_several_slices(spark, monkeypatch):
    rows = [(i, " ".join(f"word{(i * j) % 13}" for j in range(i % 9))) for i in range(40)] + [(98, None), (99, "  "), (97, "!!"), (96, "Größe größe STRASSE")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    monkeypatch.setattr(V, "SLICE_ROWS", 7)
    for dim in (5, 384):
        got = {r.id: r.v for r in df.select("id", V.hashed_embedding("text", dim).alias("v")).collect()}
        assert len(got) == 44 and all(np.allclose(got[i], plain(t, dim), atol=1e-15) for i, t in rows)


def test_a_vector_is_made_once_a_row(spark):
    """A filter on the vector must not be pushed below the dedup, where every text would be embedded again."""
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, text string").groupBy("text").agg(F.min("id").alias("id"))
    out = df.select("id", V.hashed_embedding("text", 8).alias("v")).select("id", F.posexplode("v").alias("d", "w")).where("w > 0")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython|ArrowEval", plan)) == 1, plan
    assert {r.id for r in out.collect()} == {1, 3}
