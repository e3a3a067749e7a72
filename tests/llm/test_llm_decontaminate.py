"""Winnowing against every window of every item."""

import random
import re

from edge_rows import documents, empty

from llm import decontaminate as D
from llm.queries import ORACLE, QUERIES


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            v = words(it)
            size = min(window, len(v))
            for a in range(max(0, len(v) - size + 1) if v else 0):
                for b in range(len(w) - size + 1):
                    if w[b:b + size] == v[a:a + size]:
                        hit.update(range(b, b + size))
                        found.add(str(i))
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs, items):
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got.collect()), key=str)


def test_every_window_is_found(spark):
    rng = random.Random(2)
    for vocabulary in (3, 40):  # three words: ties and overlapping runs everywhere
        word = lambda: f"w{rng.randrange(vocabulary)}"  # noqa: E731,B023
        items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 4, 9, 10, 11, 25, 40, 25])] + [(20, None)]
        items.append((21, items[6][1]))  # an item twice
        docs = []
        for d in range(40):
            w = [word() for _ in range(rng.randint(0, 60))]
            v = words(rng.choice(items)[1])
            if v:
                a = rng.randrange(len(v))
                w[len(w) // 2:len(w) // 2] = v[a:a + rng.randint(5, 20)]
            docs.append((d, "  ".join(w).upper() if d % 3 else ", ".join(w)))
        assert run(spark, docs, items) == brute(docs, items)


def test_edge_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    text = next(t for d, t in rows if d == 5)
    items = [(1, " ".join(text.split()[30:50])), (2, ""), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in D.contamination(docs, bench).collect()), key=str)
    assert got == brute(rows, items)
    assert all(r.n_hit == 0 for r in D.contamination(docs, bench.limit(0)).collect())
    assert D.contamination(empty(spark), bench).count() == 0
    left = D.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()}.isdisjoint({5, 6, 7, 8})


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES["op10_decontaminate"](spark, sf)
    want = con.execute(ORACLE["op10_decontaminate"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
