"""Iterative proportional fitting against numpy and SQL."""

import hashlib

import numpy as np
from edge_rows import documents, empty

from llm import mixing as M
from llm.queries import ORACLE, QUERIES


def plain(cells, targets):
    """Weights by a plain loop over dictionaries."""
    w = dict(cells)
    total = sum(cells.values())
    goals = {}
    for m, name in enumerate(M.MARGINALS):
        own = {}
        for k, t in cells.items():
            own[k[m]] = own.get(k[m], 0) + t
        spec = targets[name]
        if isinstance(spec, dict):
            rest = max(0.0, 1 - sum(v for k, v in spec.items() if k in own))
            free = sum(t for k, t in own.items() if k not in spec)
            part = {k: spec[k] if k in spec else rest * t / free for k, t in own.items()}
        else:
            part = {k: t ** spec for k, t in own.items()}
        goals[m] = {k: total * p / sum(part.values()) for k, p in part.items()}
    for _ in range(300):
        for m in range(3):
            now = {}
            for k, v in w.items():
                now[k[m]] = now.get(k[m], 0) + v
            w = {k: v * goals[m][k[m]] / now[k[m]] for k, v in w.items()}
    f = {k: w[k] / cells[k] for k in cells}
    low, high = 0.0, 1e6  # by bisection
    for _ in range(200):
        c = (low + high) / 2
        kept = sum(t * min(1.0, c * f[k]) for k, t in cells.items())
        low, high = (c, high) if kept < M.BUDGET * total else (low, c)
    return f, {k: min(1.0, low * v) for k, v in f.items()}


def some_cells():
    rng = np.random.default_rng(4)
    return {(f"s{a}", f"l{b}", f"t{c}"): int(rng.integers(1, 500)) for a in range(5) for b in range(3) for c in range(3) if rng.random() < 0.9}


def test_both_fits_equal_the_plain_loop(spark):
    targets = {"source": 0.5, "lang": {"l0": 0.5, "l1": 0.2, "absent": 0.1}, "topic": 0.0}
    cells = some_cells()
    f, p = plain(cells, targets)
    df = spark.createDataFrame([(*k, t) for k, t in cells.items()], "source string, lang string, topic string, tokens long")
    for local in (M.LOCAL_CELLS, 0):
        got = {(r.source, r.lang, r.topic): r for r in M.rake(df, targets, local_cells=local, rounds=12 if not local else 200).collect()}
        assert set(got) == set(f)
        for k in f:
            assert abs(got[k].weight / f[k] - 1) < 1e-5 and abs(got[k].probability / p[k] - 1) < 1e-5


def test_sample_has_the_target_mix_in_expectation(spark):
    rows = M.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    total = sum(r.n_tokens * r.rate for r in rows)
    listed = M.TARGETS["lang"]
    for lang, share in listed.items():
        got = sum(r.n_tokens * r.rate for r in rows if r.lang == lang) / total
        assert abs(got - share / sum(listed.values())) < 1e-6
    assert abs(sum(r.n_tokens * r.probability for r in rows) / sum(r.n_tokens for r in rows) - M.BUDGET) < 1e-9
    for r in rows:
        assert r.probability == min(1.0, r.rate)
        u = int(hashlib.md5(f"{M.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.kept == (u < r.probability) and 0 < r.probability <= 1


def test_a_rare_cell_does_not_thin_the_others(spark):
    rows = [(i, "some words of a large source " * 5, "en", "large") for i in range(3000)]
    schema = "doc_id long, text string, lang string, source string"
    alone = M.mix(spark.createDataFrame(rows, schema)).where("source = 'large'").first().probability
    mixed = M.mix(spark.createDataFrame(rows + [(9999, "word", None, "rare")], schema))
    other = mixed.where("source = 'large'").first().probability
    assert abs(alone - M.BUDGET) < 1e-9 and abs(other / alone - 1) < 0.01
    assert mixed.where("source = 'rare'").first().probability == 1.0
    assert M.mix(spark.createDataFrame(rows, schema), budget=1.0).agg({"probability": "min"}).first()[0] == 1.0


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLE["op4_mixing"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in QUERIES["op4_mixing"](spark, sf).collect()) == sorted(want.fetchall())


def test_edge_rows(spark):
    docs = documents(spark)
    out = M.mix(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 < r.probability <= 1 and r.kept is not None for r in rows)
    assert out.columns[:len(docs.columns) - 4] == [c for c in docs.columns if c not in ("n_tokens", "topic", "weight", "kept")]
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert M.mix(empty(spark)).count() == 0
    blank = M.mix(spark.createDataFrame([(1, None, None, None)], "doc_id long, text string, lang string, source string")).first()
    assert (blank.n_tokens, blank.probability) == (0, 1.0)
