"""Registered vector queries: hashed embeddings, top-k search, near duplicates,
misinformation verdicts, index sizes and the IVF path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import similarity as S
from ..operators import vector_join as VJ
from ..operators import vectors as V
from ..operators.prepare import with_clean_text
from ..sources.store import checkpoint_table
from ..sources.tables import read_table
from .registry import query
from .sqltext import q, sql_clean
from .text_queries import PREP_SQL, prepared_documents

DIM = L.EMBEDDING_DIM
EMB_THRESHOLD = 0.30  # the 64-dim test vectors top out near .51 cosine
EMB_DUP_THRESHOLD = 0.35


def document_vectors(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """Prepared documents with their hashed embedding: ``(doc_id, clean_text, embedding)``.

    With ``materialize`` the table is written once under the shared checkpoint
    folder; jobs that scan it twice (query side and index side of a search)
    then read files instead of re-running the preparation.
    """
    prep = prepared_documents(spark, sf_dir, detect_lang=False)
    vec = prep.select("doc_id", "clean_text", V.hashed_embedding(F.col("clean_text")).alias("embedding"))
    return checkpoint_table(spark, vec, "document-vectors") if materialize else vec


def benchmark_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    c = with_clean_text(b, "text")
    return c.select("item_id", V.hashed_embedding(F.col("clean_text")).alias("embedding"))


def _sql_weights(src: str, key: str) -> str:
    """SQL: sparse hashed weights ``(key, bucket, weight)`` of ``clean_text`` in relation ``src``."""
    text = "CASE WHEN coalesce(trim(clean_text, ' '), '') = '' THEN 'empty' ELSE clean_text END"
    return f"""
SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM (
  SELECT {key}, CAST(CAST(('0x' || substr(md5(w), 1, 8)) AS UBIGINT) % {DIM} AS INTEGER) AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), {q(r'[\p{L}\p{N}_]+')})) AS w FROM {src})
  GROUP BY ALL)"""


def _sql_dense(weights: str, key: str) -> str:
    return f"""
SELECT k.{key}, list(coalesce(w.weight, 0.0) ORDER BY r.b) AS v
FROM (SELECT DISTINCT {key} FROM {weights}) k CROSS JOIN range({DIM}) r(b)
LEFT JOIN {weights} w ON w.{key} = k.{key} AND w.bucket = r.b
GROUP BY k.{key}"""


DOC_WEIGHTS_SQL = f"""WITH {PREP_SQL}, dw AS ({_sql_weights('d', 'doc_id')})"""
BENCH_SQL = f"""bc AS (SELECT item_id, {sql_clean('text')} AS clean_text FROM benchmark),
bw AS ({_sql_weights('bc', 'item_id')})"""


# --- V1, V10: hashed embedding weights -------------------------------------------
@query("hashed_embedding_weights", f"""{DOC_WEIGHTS_SQL}
SELECT doc_id, bucket, round(weight, 4) AS weight FROM dw""")
def hashed_embedding_weights(spark, sf_dir):
    v = document_vectors(spark, sf_dir)
    e = v.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where(F.col("weight") > 0)
    return e.select("doc_id", "bucket", F.round("weight", 4).alias("weight"))


# --- V9, V10: dimension check and normalisation of stored vectors ------------------
@query("embedding_normalize", """
SELECT vec_id, len(embedding) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm_in,
       round(CAST(embedding[1] AS DOUBLE) /
             sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS first_unit
FROM embeddings""")
def embedding_normalize(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    n = V.l2_normalize("embedding")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda a, x: a + x))
    return e.select("vec_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm_in"),
                    F.round(n[0], 4).alias("first_unit"))


@query("embedding_dimension_check", "SELECT min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, "
                                    "count(*) AS n FROM embeddings")
def embedding_dimension_check(spark, sf_dir):
    return V.dimension_check(read_table(spark, sf_dir, "embeddings", ["embedding"]))


# --- V2, V4, W1: exact top-k over the stored vectors (every vector queries the index) ---
EMB_SEARCH_SQL = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) AS score FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= {L.SEARCH_TOP_K} AND score >= {EMB_THRESHOLD}"""


@query("embedding_search", EMB_SEARCH_SQL)
def embedding_search(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    qv = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return S.search(e, qv, k=L.SEARCH_TOP_K, threshold=EMB_THRESHOLD, index_key="vec_id", query_key="query_id")


def _sql_links(dense: str, key: str, threshold: float) -> str:
    """SQL: all links between classes of equal vectors, and each class's members linked to its smallest id."""
    return f"""g AS (SELECT {key}, v, min({key}) OVER (PARTITION BY v) AS rep FROM {dense})
SELECT a.{key} AS id1, b.{key} AS id2, round(list_dot_product(a.v, b.v), 4) AS score
FROM g a JOIN g b ON a.{key} < b.{key}
WHERE a.{key} = a.rep AND b.{key} = b.rep AND list_dot_product(a.v, b.v) >= {threshold}
UNION ALL SELECT rep, {key}, round(list_dot_product(v, v), 4) FROM g WHERE {key} <> rep AND round(list_dot_product(v, v), 4) >= {threshold}"""


# --- V6 on stored vectors: every pair, no neighbour cap ------------------------------
@query("embedding_near_duplicates", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{_sql_links('e', 'vec_id', EMB_DUP_THRESHOLD)}""")
def embedding_near_duplicates(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return S.near_duplicates(e, key="vec_id", threshold=EMB_DUP_THRESHOLD)


# --- V6, E4 on hashed documents --------------------------------------------------------
@query("document_near_duplicates", f"""{DOC_WEIGHTS_SQL},
dv AS ({_sql_dense('dw', 'doc_id')}),
{_sql_links('dv', 'doc_id', L.DUPLICATE_THRESHOLD)}""")
def document_near_duplicates(spark, sf_dir):
    v = VJ.compact(document_vectors(spark, sf_dir), "doc_id", "embedding", DIM)
    return S.near_duplicates(v, key="doc_id", threshold=L.DUPLICATE_THRESHOLD)


# --- V4, V5, J1, J4: benchmark passages searched in the document index, text attached late ---
DOC_SEARCH_SQL = f"""{DOC_WEIGHTS_SQL}, {BENCH_SQL},
s AS (SELECT bw.item_id, dw.doc_id, sum(bw.weight * dw.weight) AS score
      FROM bw JOIN dw ON bw.bucket = dw.bucket GROUP BY bw.item_id, dw.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query("document_search", f"""{DOC_SEARCH_SQL}
SELECT r.item_id, r.doc_id, round(r.score, 4) AS score, CAST(r.rank AS INTEGER) AS rank, d.clean_text
FROM r JOIN d ON r.doc_id = d.doc_id
WHERE r.rank <= {L.SEARCH_TOP_K} AND r.score >= {L.SEARCH_THRESHOLD}""")
def document_search(spark, sf_dir):
    docs = document_vectors(spark, sf_dir, materialize=True)
    qv = checkpoint_table(spark, benchmark_vectors(spark, sf_dir), "query-vectors")  # size check and search read it
    hits = S.search(docs, qv, k=L.SEARCH_TOP_K, threshold=L.SEARCH_THRESHOLD, index_key="doc_id", query_key="item_id")
    return S.attach_text(hits, docs, "doc_id", "clean_text")


def flat_hits(verdicts: DataFrame) -> DataFrame:
    """The ``similar`` hits as joined ids and scores and the best hit's text."""
    ids = F.array_join(F.transform("similar", lambda h: h["id"].cast("string")), "|")
    scores = F.array_join(F.transform("similar", lambda h: F.format_string("%.4f", h["score"])), "|")
    cols = [c for c in verdicts.columns if c != "similar"]
    return verdicts.select(*cols, ids.alias("similar_ids"), scores.alias("similar_scores"),
                           F.get("similar", F.lit(0))["text"].alias("top_text"))


# --- V7, A5, J7: misinformation verdict per benchmark passage ------------------------------
@query("misinformation_verdicts", f"""{DOC_SEARCH_SQL},
h AS (SELECT item_id, doc_id, round(score, 4) AS score, rank FROM r
      WHERE rank <= {L.MISINFO_TOP_K} AND score >= {L.MISINFO_THRESHOLD}),
a AS (SELECT item_id, count(*) AS num_similar, max(score) AS mx, sum(round(score * 10000)) / count(*) / 10000 AS av,
             round(sum(round(score * 10000)) / count(*)) / 10000 AS av4, string_agg(CAST(h.doc_id AS VARCHAR), '|' ORDER BY rank) AS ids,
             string_agg(printf('%.4f', score), '|' ORDER BY rank) AS scores, min_by(d.clean_text, rank) AS top_text
      FROM h JOIN d ON d.doc_id = h.doc_id GROUP BY item_id)
SELECT b.item_id,
       coalesce(mx > {L.MISINFO_MAX_SUSPICIOUS} OR (num_similar >= {L.MISINFO_MIN_HITS_FOR_AVG}
                AND av > {L.MISINFO_AVG_SUSPICIOUS}), false) AS is_suspicious,
       coalesce(round(mx, 4), 0.0) AS confidence, coalesce(num_similar, 0) AS num_similar,
       coalesce(av4, 0.0) AS avg_similarity, coalesce(ids, '') AS similar_ids,
       coalesce(scores, '') AS similar_scores, top_text,
       CASE WHEN num_similar IS NULL THEN {q(L.REASON_NO_HITS)}
            WHEN mx > {L.MISINFO_MAX_SUSPICIOUS} OR (num_similar >= {L.MISINFO_MIN_HITS_FOR_AVG}
                 AND av > {L.MISINFO_AVG_SUSPICIOUS}) THEN {q(L.REASON_SUSPICIOUS)}
            ELSE {q(L.REASON_ORIGINAL)} END AS reason
FROM benchmark b LEFT JOIN a ON a.item_id = b.item_id""")
def misinformation_verdicts(spark, sf_dir):
    docs = document_vectors(spark, sf_dir, materialize=True)
    qv = checkpoint_table(spark, benchmark_vectors(spark, sf_dir), "query-vectors")  # read three times below
    hits = S.search(docs, qv, k=L.MISINFO_TOP_K, threshold=L.MISINFO_THRESHOLD, index_key="doc_id",
                    query_key="item_id")
    hits = S.attach_text(hits, docs, "doc_id", "clean_text")
    return flat_hits(S.verdicts(qv, hits, "item_id", "doc_id", "clean_text"))


# --- V8, A9: index sizes ------------------------------------------------------------------
@query("index_sizes", f"""WITH {PREP_SQL}
SELECT 'documents' AS index_name, count(*) AS size FROM d
UNION ALL SELECT 'embeddings', count(*) FROM embeddings""")
def index_sizes(spark, sf_dir):
    from ..operators.reports import index_sizes as sizes
    docs = prepared_documents(spark, sf_dir, detect_lang=False)
    return sizes(documents=docs, embeddings=read_table(spark, sf_dir, "embeddings", ["vec_id"]))


# --- V3, J3: IVF approximate search (rows-only: approximate by design) ----------------------
@query("ivf_embedding_search")
def ivf_embedding_search(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    cells, cents = S.build_ivf(e, key="vec_id")
    qv = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return S.ivf_search(cells, cents, qv, k=L.SEARCH_TOP_K, threshold=EMB_THRESHOLD, index_key="vec_id",
                        query_key="query_id")


# --- N3: paraphrase pairs = near-duplicate rule at a lower threshold on IDF-weighted vectors ------
# (plain counts put 13 % of all pairs above .75: frequent words alone make texts of a language alike)
PARAPHRASE_THRESHOLD = 0.75


@query("document_paraphrase_pairs", f"""{DOC_WEIGHTS_SQL},
n AS (SELECT count(DISTINCT doc_id) AS n FROM dw),
idf AS (SELECT bucket, ln((n + 1) / (count(*) + 1)) AS idf FROM dw CROSS JOIN n GROUP BY bucket, n),
iw0 AS (SELECT doc_id, dw.bucket, weight * idf AS w FROM dw JOIN idf ON idf.bucket = dw.bucket),
iw AS (SELECT doc_id, bucket, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0), 0.0) AS weight FROM iw0),
dv AS ({_sql_dense('iw', 'doc_id')}),
{_sql_links('dv', 'doc_id', PARAPHRASE_THRESHOLD)}""")
def document_paraphrase_pairs(spark, sf_dir):
    v = V.idf_weighted(VJ.compact(document_vectors(spark, sf_dir), "doc_id", "embedding", DIM))
    return S.near_duplicates(v, key="doc_id", threshold=PARAPHRASE_THRESHOLD)


# --- V3 + V6 at scale: near duplicates over IVF cells in bounded salted blocks (rows-only) --------
@query("ivf_near_duplicates")
def ivf_near_duplicates(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return S.ivf_near_duplicates(e, key="vec_id", threshold=EMB_DUP_THRESHOLD)
