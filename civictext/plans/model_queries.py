"""Registered topic, classifier and language queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.rules import lowered_text, topic_rule, urgency_label
from ..functions.text import supported_language
from ..operators import density as D
from ..operators import epochs as E
from ..operators import language as LG
from ..operators import prepare as P
from ..operators import topics as T
from ..operators import urgency as U
from ..sources.store import checkpoint_table
from ..sources.tables import read_table
from .registry import query
from .sqltext import q, sql_clean, sql_seeded_hash, sql_supported_language, sql_topic_field, sql_urgency
from .text_queries import FREQUENT_LEXICON, PREP_SQL, prepared_documents

TOKEN_RE = q(r"[\p{L}\p{N}_]+")


def _sql_ctfidf(src: str, cls_expr: str, text: str, top_n: int = T.TOPIC_WORDS) -> str:
    """CTEs ending in ``r(cls, word, weight, rank)`` for class TF-IDF over ``src``."""
    return f"""
t AS (SELECT {cls_expr} AS cls, unnest(regexp_extract_all(lower({text}), {TOKEN_RE})) AS word FROM {src}),
tf AS (SELECT cls, word, count(*) AS tf FROM t WHERE length(word) >= {T.MIN_TOKEN_LENGTH} GROUP BY ALL),
pc AS (SELECT cls, sum(tf) AS class_total FROM tf GROUP BY cls),
fr AS (SELECT word, sum(tf) AS f FROM tf GROUP BY word),
a AS (SELECT floor(avg(class_total)) AS big_a FROM pc),
w AS (SELECT tf.cls, tf.word, (tf.tf / pc.class_total) * ln(1 + a.big_a / fr.f) AS weight
      FROM tf JOIN pc ON tf.cls = pc.cls JOIN fr ON tf.word = fr.word CROSS JOIN a),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY weight DESC, word) AS rank FROM w)
      WHERE rank <= {top_n})"""


# --- K4, W2, A11: class TF-IDF words with a given class column -------------------------
@query("topic_words_by_lang", f"""WITH {PREP_SQL}, {_sql_ctfidf('d', 'lang', 'clean_text')}
SELECT cls AS lang, word, round(weight, 4) AS weight, CAST(rank AS INTEGER) AS rank FROM r""")
def topic_words_by_lang(spark, sf_dir):
    prep = prepared_documents(spark, sf_dir, detect_lang=False)
    return T.class_term_weights(prep, "lang", "clean_text")


@query("topic_words_by_role", f"""WITH cc AS (SELECT role, {sql_clean('text')} AS clean_text FROM conversations),
{_sql_ctfidf('cc', 'role', 'clean_text')}
SELECT cls AS role, word, round(weight, 4) AS weight, CAST(rank AS INTEGER) AS rank FROM r""")
def topic_words_by_role(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", ["role", "text"])
    c = P.with_clean_text(c, "text")
    return T.class_term_weights(c, "role", "clean_text")


# --- K7, K8, K9: topic info (count, name) for rule topics, top 20 ---------------------------
@query("rule_topic_info", f"""WITH {PREP_SQL},
rt AS (SELECT {sql_topic_field('clean_text', 'topic_id')} AS topic_id, clean_text FROM d),
{_sql_ctfidf('rt', 'topic_id', 'clean_text')},
nm AS (SELECT cls AS topic_id, CAST(cls AS VARCHAR) || '_' ||
              string_agg(word, '_' ORDER BY rank) FILTER (WHERE rank <= {T.NAME_WORDS}) AS name
       FROM r GROUP BY cls),
ct AS (SELECT topic_id, count(*) AS count FROM rt GROUP BY topic_id)
SELECT ct.topic_id, ct.count, coalesce(nm.name, CAST(ct.topic_id AS VARCHAR) || '_') AS name
FROM ct LEFT JOIN nm ON ct.topic_id = nm.topic_id ORDER BY ct.count DESC, ct.topic_id LIMIT 20""")
def rule_topic_info(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    # the texts are prepared once: the words and the counts read the written table
    rt = checkpoint_table(spark, prep.select(topic_rule("_low", lowered=True)["topic_id"].alias("topic_id"), "clean_text"), "topic-texts")
    words = T.class_term_weights(rt, "topic_id", "clean_text")
    return T.top_topics(T.topic_info(rt, words), 20)


# --- K1, K2, K3, K5, K6, K8: clustered topics on hashed document vectors (rows-only) ------------
@query("cluster_topics")
def cluster_topics(spark, sf_dir):
    from .vector_queries import document_vectors
    from ..sources.store import checkpoint_table
    vecs = document_vectors(spark, sf_dir, materialize=True)  # read by PCA, KMeans, the sizes and the assignment
    tm = T.fit_topics(vecs, "embedding", n_topics=8, dims=5, min_topic_size=15)
    assigned = checkpoint_table(spark, T.predict_topics(tm, vecs, ["doc_id", "clean_text"]), "assigned-topics")
    words = T.class_term_weights(assigned, "topic_id", "clean_text")
    info = T.topic_info(assigned, words)
    return T.label_topics(assigned.select("doc_id", "topic_id", "confidence", "probabilities"), info)


# --- K2: density clusters of the reduced document vectors, outliers -1 (rows-only; equal to a plain version in the tests) ----
@query("density_topics")
def density_topics(spark, sf_dir):
    from .vector_queries import document_vectors
    vecs = document_vectors(spark, sf_dir, materialize=True).select("doc_id", "embedding")
    reduced = checkpoint_table(spark, T.reduce_vectors(vecs, "embedding", dims=5), "reduced-vectors")
    return D.density_clusters(reduced, "doc_id", "embedding", min_cluster_size=15).withColumnRenamed("cluster", "topic_id")


# --- K10: distances between topic centroids (rows-only: clustering) ----------------------------------------
@query("topic_distances")
def topic_distances(spark, sf_dir):
    from .vector_queries import document_vectors
    vecs = document_vectors(spark, sf_dir, materialize=True)
    return T.centroid_distances(T.fit_topics(vecs, "embedding", n_topics=8, dims=5, min_topic_size=15), spark)


# --- K2, K3: clusters below the least size become -1, the others are numbered by size ---------------------
@query("topic_renumbering", """
WITH s AS (SELECT source AS cluster, count(*) AS size FROM documents GROUP BY 1),
b AS (SELECT cluster, row_number() OVER (ORDER BY size DESC, cluster) - 1 AS topic_id FROM s WHERE size >= 40)
SELECT s.cluster, CAST(coalesce(b.topic_id, -1) AS INTEGER) AS topic_id FROM s LEFT JOIN b ON s.cluster = b.cluster""")
def topic_renumbering(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["source"])
    return T.renumber(d.groupBy(F.col("source").alias("cluster")).agg(F.count(F.lit(1)).alias("size")), 40)


# --- U8: class distribution before training ----------------------------------------------------
@query("urgency_class_distribution", f"""WITH {PREP_SQL}
SELECT {sql_urgency('clean_text', FREQUENT_LEXICON)} AS urgency, count(*) AS n FROM d GROUP BY 1""")
def urgency_class_distribution(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    return prep.groupBy(urgency_label("_low", FREQUENT_LEXICON, lowered=True).alias("urgency")).agg(
        F.count(F.lit(1)).alias("n"))


# --- A7, U7 as aggregates: accuracy and weighted F1 of one labelling against another -----------
@query("rule_agreement_metrics", f"""WITH {PREP_SQL},
lab AS (SELECT {sql_urgency('clean_text', FREQUENT_LEXICON)} AS actual, {sql_urgency('clean_text')} AS predicted FROM d),
cm AS (SELECT actual, predicted, count(*) AS n FROM lab GROUP BY ALL),
pa AS (SELECT actual, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM cm GROUP BY actual),
pp AS (SELECT predicted AS actual, sum(n) AS pred_n FROM cm GROUP BY predicted),
cls AS (SELECT pa.*, coalesce(pp.pred_n, 0) AS pred_n FROM pa LEFT JOIN pp ON pa.actual = pp.actual)
SELECT round(sum(tp) / sum(support), 4) AS accuracy,
       round(sum(CASE WHEN support + pred_n > 0 THEN 2 * tp / (support + pred_n) END * support) / sum(support), 4)
         AS weighted_f1,
       CAST(sum(support) AS BIGINT) AS n
FROM cls""")
def rule_agreement_metrics(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    lab = prep.select(urgency_label("_low", FREQUENT_LEXICON, lowered=True).alias("actual"),
                      urgency_label("_low", lowered=True).alias("predicted"))
    return U.evaluate(lab, "actual", "predicted")


# --- U1-U7: weighted multinomial classifier, held-out evaluation (rows-only) --------------------
@query("urgency_classifier_eval")
def urgency_classifier_eval(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    lab = prep.select(F.col("doc_id").alias("row_id"), "clean_text",
                      urgency_label("_low", FREQUENT_LEXICON, lowered=True).alias("urgency"))
    model, test = E.train_epochs(lab, "clean_text", "urgency", key="row_id")
    pred = U.predict(model, test)
    return U.evaluate(pred, "urgency", "predicted")


# --- U5: weighted F1 of every epoch, and which one is kept (rows-only) ------------------------------
@query("classifier_epochs")
def classifier_epochs(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    lab = prep.select(F.col("doc_id").alias("row_id"), "clean_text", urgency_label("_low", FREQUENT_LEXICON, lowered=True).alias("urgency"))
    return E.epoch_table(spark, E.train_epochs(lab, "clean_text", "urgency", key="row_id")[0])


@query("quality_classifier_eval")
def quality_classifier_eval(spark, sf_dir):
    prep = prepared_documents(spark, sf_dir, detect_lang=False)
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    rows = prep.join(lab, "doc_id").select(F.col("doc_id").alias("row_id"), "clean_text",
                                           F.col("quality").cast("string").alias("quality"))
    model, test = E.train_epochs(rows, "clean_text", "quality", key="row_id")
    return U.evaluate(U.predict(model, test), "quality", "predicted")


# --- LANG, F7, Q11: word naive Bayes trained on 80 %, applied to the held-out 20 % ---------------
LANG_SPLIT_SQL = f"""
sp AS (SELECT doc_id, lang, clean_text,
              row_number() OVER (PARTITION BY lang ORDER BY {sql_seeded_hash('doc_id')}, doc_id) AS rk,
              count(*) OVER (PARTITION BY lang) AS n_class FROM d),
tr AS (SELECT * FROM sp WHERE rk > ceil(0.2 * n_class)),
te AS (SELECT * FROM sp WHERE rk <= ceil(0.2 * n_class)),
tok AS (SELECT lang, unnest(regexp_extract_all(lower(clean_text), {TOKEN_RE})) AS token FROM tr),
cnt AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY ALL),
v AS (SELECT count(DISTINCT token) AS v FROM cnt),
tot AS (SELECT lang, sum(n) AS total FROM cnt GROUP BY lang),
docs AS (SELECT lang, count(*) AS docs FROM tr GROUP BY lang),
alld AS (SELECT sum(docs) AS all_docs FROM docs),
st AS (SELECT tot.lang, ln(1.0 / (total + v)) AS fl, ln(docs / all_docs) AS prior, total + v AS denom
       FROM tot JOIN docs ON tot.lang = docs.lang CROSS JOIN v CROSS JOIN alld),
prof AS (SELECT cnt.lang, token, ln((n + 1) / denom) - fl AS delta FROM cnt JOIN st ON cnt.lang = st.lang),
qt AS (SELECT doc_id, unnest(regexp_extract_all(lower(clean_text), {TOKEN_RE})) AS token FROM te),
ntok AS (SELECT doc_id, count(token) AS ntok FROM qt GROUP BY doc_id),
ms AS (SELECT qt.doc_id, prof.lang, sum(delta) AS s FROM qt JOIN prof ON qt.token = prof.token GROUP BY ALL),
sc AS (SELECT te.doc_id, st.lang, coalesce(ntok.ntok, 0) * st.fl + st.prior + coalesce(ms.s, 0) AS score
       FROM te CROSS JOIN st LEFT JOIN ntok ON ntok.doc_id = te.doc_id
       LEFT JOIN ms ON ms.doc_id = te.doc_id AND ms.lang = st.lang),
best AS (SELECT doc_id, lang AS raw_language FROM sc
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1),
det AS (SELECT te.doc_id, te.lang, best.raw_language FROM te JOIN best ON te.doc_id = best.doc_id)"""


def _language_split(spark, sf_dir):
    from ..sources.store import checkpoint_table
    prep = prepared_documents(spark, sf_dir, detect_lang=False).select("doc_id", "lang", "clean_text")
    # the split reads its input three times: clean the text once, into the shared folder
    prep = checkpoint_table(spark, prep, "language-prep")
    # written once: the profile (train side) and the detection (test side) both read it
    split = checkpoint_table(spark, P.stratified_split(prep, "lang", "doc_id"), "language-split")
    return split.where(~F.col("is_test")), split.where(F.col("is_test"))


@query("language_detection", f"""WITH {PREP_SQL}, {LANG_SPLIT_SQL}
SELECT doc_id, lang, raw_language, {sql_supported_language('raw_language')} AS language FROM det""")
def language_detection(spark, sf_dir):
    train, test = _language_split(spark, sf_dir)
    profile = LG.train_language_profile(train, "clean_text", "lang")
    det = LG.detect_language(test, profile, "clean_text", "doc_id", keep=("lang",))
    return det.select("doc_id", "lang", "raw_language",
                      supported_language(F.col("raw_language"), L.SUPPORTED_LANGUAGES).alias("language"))


@query("language_accuracy", f"""WITH {PREP_SQL}, {LANG_SPLIT_SQL}
SELECT lang, count(*) AS n, CAST(sum(CASE WHEN lang = raw_language THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(sum(CASE WHEN lang = raw_language THEN 1 ELSE 0 END) / count(*), 4) AS accuracy
FROM det GROUP BY lang""")
def language_accuracy(spark, sf_dir):
    train, test = _language_split(spark, sf_dir)
    profile = LG.train_language_profile(train, "clean_text", "lang")
    det = LG.detect_language(test, profile, "clean_text", "doc_id", keep=("lang",))
    return LG.language_accuracy(det, "lang").select("lang", "n", F.col("correct").cast("long"), "accuracy")


# --- LANG by character n-grams: the same split, 1- to 3-letter n-grams of marked words -----------------
GRAMS = ("flatten(list_transform([1, 2, 3], lambda s: list_transform(range(1, greatest(len(word) + 2 - s + 1, 0) + 1), "
         "lambda i: substring('_' || word || '_', i, s))))")
NGRAM_SQL = f"""
{LANG_SPLIT_SQL.split("tok AS (SELECT lang")[0]}
trw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(clean_text), {q(LG.NGRAM_WORD)})) AS word FROM tr) GROUP BY ALL),
cnt AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, n, unnest({GRAMS}) AS gram FROM trw) GROUP BY ALL),
v AS (SELECT count(DISTINCT gram) AS v FROM cnt),
st AS (SELECT c.lang, ln(1.0 / (total + v)) AS fl, ln(docs / (SELECT count(*) FROM tr)) AS prior, total + v AS denom
       FROM (SELECT lang, sum(n) AS total FROM cnt GROUP BY 1) c JOIN (SELECT lang, count(*) AS docs FROM tr GROUP BY 1) d ON c.lang = d.lang, v),
prof AS (SELECT cnt.lang, gram, ln((n + 1) / denom) - fl AS delta FROM cnt JOIN st ON cnt.lang = st.lang),
tew AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(clean_text), {q(LG.NGRAM_WORD)})) AS word FROM te) GROUP BY ALL),
wg AS (SELECT word, unnest({GRAMS}) AS gram FROM (SELECT DISTINCT word FROM tew)),
wn AS (SELECT word, count(*) AS g FROM wg GROUP BY 1),
ws AS (SELECT word, lang, sum(delta) AS s FROM wg JOIN prof USING (gram) GROUP BY ALL),
ng AS (SELECT doc_id, sum(n * g) AS g FROM tew JOIN wn USING (word) GROUP BY 1),
ds AS (SELECT doc_id, lang, sum(n * s) AS s FROM tew JOIN ws USING (word) GROUP BY ALL),
best AS (SELECT te.doc_id, st.lang AS raw_language FROM te CROSS JOIN st LEFT JOIN ng ON ng.doc_id = te.doc_id LEFT JOIN ds ON ds.doc_id = te.doc_id AND ds.lang = st.lang
         QUALIFY row_number() OVER (PARTITION BY te.doc_id ORDER BY coalesce(ng.g, 0) * fl + prior + coalesce(ds.s, 0) DESC, st.lang) = 1),
det AS (SELECT te.doc_id, te.lang, best.raw_language FROM te JOIN best ON te.doc_id = best.doc_id)"""


def _detected_by_ngrams(spark, sf_dir):
    train, test = _language_split(spark, sf_dir)
    return LG.detect_by_ngrams(test, LG.train_ngram_profile(train, "clean_text", "lang"), "clean_text", "doc_id", keep=("lang",))


@query("language_ngram_detection", f"""WITH {PREP_SQL}, {NGRAM_SQL}
SELECT doc_id, lang, raw_language, {sql_supported_language('raw_language')} AS language FROM det""")
def language_ngram_detection(spark, sf_dir):
    return _detected_by_ngrams(spark, sf_dir).select("doc_id", "lang", "raw_language",
                                                     supported_language(F.col("raw_language"), L.SUPPORTED_LANGUAGES).alias("language"))


@query("language_ngram_accuracy", f"""WITH {PREP_SQL}, {NGRAM_SQL}
SELECT lang, count(*) AS n, CAST(sum(CASE WHEN lang = raw_language THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(sum(CASE WHEN lang = raw_language THEN 1 ELSE 0 END) / count(*), 4) AS accuracy
FROM det GROUP BY lang""")
def language_ngram_accuracy(spark, sf_dir):
    return LG.language_accuracy(_detected_by_ngrams(spark, sf_dir), "lang").select("lang", "n", F.col("correct").cast("long"), "accuracy")


# --- K10: chart rows, words of the largest topics ------------------------------------------------
@query("rule_topic_word_chart", f"""WITH {PREP_SQL},
rt AS (SELECT {sql_topic_field('clean_text', 'topic_id')} AS topic_id, clean_text FROM d),
{_sql_ctfidf('rt', 'topic_id', 'clean_text')},
ct AS (SELECT topic_id, count(*) AS count FROM rt WHERE topic_id <> -1 GROUP BY topic_id
       ORDER BY count DESC, topic_id LIMIT 8)
SELECT r.cls AS topic_id, r.word, round(r.weight, 4) AS weight, CAST(r.rank AS INTEGER) AS rank
FROM r JOIN ct ON r.cls = ct.topic_id""")
def rule_topic_word_chart(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    rt = checkpoint_table(spark, prep.select(topic_rule("_low", lowered=True)["topic_id"].alias("topic_id"), "clean_text"), "topic-texts")
    words = T.class_term_weights(rt, "topic_id", "clean_text")
    return T.topic_word_chart(T.topic_info(rt, words), words, 8)
