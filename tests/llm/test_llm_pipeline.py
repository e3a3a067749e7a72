"""The pipeline's stages against brute-force versions, and its contract."""

import re

from edge_rows import documents, empty
from test_llm_decontaminate import brute as brute_hits
from test_llm_ngram_join import brute as brute_classes

import corpus_pipeline as P
from llm import language_profiles, mixing
from llm.surrogates import PATTERN

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        after = {r.doc_id: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == COLUMNS
        if name == "language":  # nothing clean goes
            assert set(before) - set(after) == {d for d, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")}
        elif name == "near duplicates":
            classes = brute_classes([(d, r.text) for d, r in before.items()], 5, 4, 5)
            assert set(after) == {d for d, c in classes.items() if c[1] == d}
        elif name == "benchmark decontamination":
            hits = {d: n for d, _, n, _ in brute_hits([(d, r.text) for d, r in before.items()], items)}
            assert set(after) == {d for d in before if not hits[d]} and any(hits.values())
        elif name == "personal data":
            assert set(after) == set(before)
            for d, r in after.items():
                assert r.n_chars == len(r.text)
                assert not re.search("mail\\d\\.example|555-\\d{4}", r.text)
        else:
            assert {d for d, r in after.items() if r.probability < 1} <= set(before) and 0 < len(after) < len(before)
            assert all(mixing.SEED and 0 < r.probability <= 1 for r in after.values())
        if name not in ("personal data", "mix"):
            assert all(after[d] == before[d] for d in after)


def test_every_stage_takes_edge_rows(spark, tmp_path):
    for kind, docs in (("edge", documents(spark)), ("empty", empty(spark))):
        for i, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, SF)
            if name != "mix":
                assert [c for c in out.columns] == docs.columns
            out.write.parquet(f"{tmp_path}/{kind}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{kind}{i}")
        assert (docs.count() > 0) == (kind == "edge")


def test_run_and_registration(spark):
    import __spark_entry__ as E

    assert E.queries()["pipeline"] is P.run and {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q)[0] for q in E.queries() if re.match(r"op\d+_", q)}
    rows = P.run(spark, SF).collect()
    assert rows and all(r.lang is not None for r in rows) and language_profiles.UNKNOWN not in {r.lang for r in rows}
    assert len({r.doc_id for r in rows}) == len(rows) and PATTERN


def test_rows_are_judged_one_by_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (3, text + " w60"), (3, other), (None, "x " + other), (7, "y " + item), (7, "clean words"), (None, "z " + item), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    one = P.near_duplicates(spark, docs, SF)
    assert one.columns == docs.columns
    assert got(one) == sorted([rows[3], rows[4], rows[6], rows[7], rows[9]], key=str)  # of the item's two copies the one with an id
    clean = P.benchmark_passages(spark, docs, SF)
    assert clean.columns == docs.columns and got(clean) == sorted([r for i, r in enumerate(rows) if i not in (6, 8)], key=str)
    null_only = docs.where("doc_id is null")
    assert got(P.near_duplicates(spark, null_only.union(null_only), SF)) == sorted([(None, t) for t in (None, None, text, "x " + other, "z " + item)], key=str)
