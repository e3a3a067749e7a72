"""Registered text queries: cleaning, rules, filters, sampling, dedup, reports.

Each query reads the driver tables at ``sf_dir`` and is paired with DuckDB SQL
over the same tables (views ``documents``, ``labels``, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.rules import api_urgency, lowered_text, topic_rule, urgency_label
from ..functions.text import clean_text
from ..operators import prepare as P
from ..operators import reports as R
from ..sources.tables import read_table
from .registry import query
from .sqltext import (q, sql_api_urgency_field, sql_clean, sql_script_language, sql_seeded_hash,
                      sql_topic_field, sql_urgency)

# Default preparation of the documents table: min length 10, whole texts, keep-first dedup.
DOC_MIN_LENGTH = 10
TRUNCATED_WORDS = 512  # the cut of the truncated preparation, 5 characters a word


def prepared_documents(spark: SparkSession, sf_dir: str, detect_lang: bool = True,
                       max_length: int | None = None) -> DataFrame:
    """``(doc_id, lang, source, clean_text[, language])`` after the default preparation (no cut)."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return P.prepare(docs, "text", key="doc_id", min_length=DOC_MIN_LENGTH, max_length=max_length,
                     detect_lang=detect_lang, keep_text=False)


def prep_sql(max_chars: int | None = None) -> str:
    kept = f"substring(clean_text, 1, {max_chars})" if max_chars else "clean_text"
    return f"""
c AS (SELECT doc_id, text, lang, source, {sql_clean('text')} AS clean_text FROM documents),
f AS (SELECT doc_id, text, lang, source, {kept} AS clean_text
      FROM c WHERE length(clean_text) >= {DOC_MIN_LENGTH}),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) = 1),
p AS (SELECT *, {sql_script_language('clean_text')} AS language FROM d)
"""


PREP_SQL = prep_sql()


# --- C1 + R1 + A1/A2: the flagship ------------------------------------------
@query("urgency_by_language", f"""
WITH {PREP_SQL},
u AS (SELECT language, {sql_urgency('clean_text')} AS urgency FROM p)
SELECT language, urgency, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM u GROUP BY language, urgency
""")
def urgency_by_language(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir))
    return R.distribution(prep.withColumn("urgency", urgency_label("_low", lowered=True)), "language", "urgency")


# --- T1-T8 on three text sources ---------------------------------------------
@query("clean_documents", f"SELECT doc_id, {sql_clean('text')} AS clean_text FROM documents")
def clean_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", clean_text(F.coalesce(F.col("text"), F.lit("nan"))).alias("clean_text"))


@query("clean_pages", f"SELECT page_id, {sql_clean('html')} AS clean_html FROM pages")
def clean_pages(spark, sf_dir):
    d = read_table(spark, sf_dir, "pages", ["page_id", "html"])
    return d.select("page_id", clean_text(F.coalesce(F.col("html"), F.lit("nan"))).alias("clean_html"))


@query("clean_conversations", f"""
SELECT conv_id, turn, role, {sql_clean('text')} AS clean_text FROM conversations""")
def clean_conversations(spark, sf_dir):
    d = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return d.select("conv_id", "turn", "role", clean_text(F.coalesce(F.col("text"), F.lit("nan"))).alias("clean_text"))


# --- R3, W5: rule topics -------------------------------------------------------
@query("rule_topics", f"""
WITH {PREP_SQL}
SELECT doc_id, {sql_topic_field('clean_text', 'topic_id')} AS topic_id,
       {sql_topic_field('clean_text', 'topic_label')} AS topic_label,
       {sql_topic_field('clean_text', 'confidence')} AS confidence,
       {sql_topic_field('clean_text', 'keywords')} AS top_keywords,
       'rule-based' AS method
FROM p""")
def rule_topics(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    t = prep.select("doc_id", topic_rule("_low", lowered=True).alias("t"))
    return t.select("doc_id", "t.topic_id", "t.topic_label", "t.confidence",
                    F.array_join("t.top_keywords", "|").alias("top_keywords"), F.lit("rule-based").alias("method"))


# --- R2, X2 (flattened): request-time urgency ------------------------------------
@query("api_urgency", f"""
WITH {PREP_SQL}
SELECT doc_id, {sql_api_urgency_field('clean_text', 'urgency')} AS urgency,
       {sql_api_urgency_field('clean_text', 'confidence')} AS confidence,
       {sql_api_urgency_field('clean_text', 'p_low')} AS p_low,
       {sql_api_urgency_field('clean_text', 'p_medium')} AS p_medium,
       {sql_api_urgency_field('clean_text', 'p_high')} AS p_high,
       {sql_api_urgency_field('clean_text', 'p_critical')} AS p_critical,
       'rule-based' AS method
FROM p""")
def api_urgency_query(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    u = prep.select("doc_id", api_urgency("_low", lowered=True).alias("u"))
    return u.select("doc_id", "u.*", F.lit("rule-based").alias("method"))


# --- R1 with a caller lexicon that reaches every branch on these tables --------
FREQUENT_LEXICON = [("CRITICAL", ["sich"]), ("HIGH", ["pour"]), ("MEDIUM", ["tion", "that"])]


@query("urgency_custom_lexicon", f"""
WITH {PREP_SQL}
SELECT doc_id, {sql_urgency('clean_text', FREQUENT_LEXICON)} AS urgency FROM p""")
def urgency_custom_lexicon(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    return prep.select("doc_id", urgency_label("_low", FREQUENT_LEXICON, lowered=True).alias("urgency"))


# --- E1, W7: keep-first dedup of whole texts -----------------------------------
@query("dedup_documents", f"WITH {PREP_SQL} SELECT doc_id, clean_text FROM d")
def dedup_documents(spark, sf_dir):
    return prepared_documents(spark, sf_dir, detect_lang=False).select("doc_id", "clean_text")


# --- P10, E1: the cut as a feature: truncated texts, then keep-first dedup -----
@query("truncated_dedup", f"WITH {prep_sql(TRUNCATED_WORDS * 5)} SELECT doc_id, clean_text FROM d")
def truncated_dedup(spark, sf_dir):
    return prepared_documents(spark, sf_dir, detect_lang=False, max_length=TRUNCATED_WORDS).select(
        "doc_id", "clean_text")


# --- E3, A6: removed-row accounting ---------------------------------------------
@query("prepare_accounting", f"""
WITH {PREP_SQL}
SELECT (SELECT count(*) FROM c) AS rows_in,
       (SELECT count(*) FROM c) - (SELECT count(*) FROM f) AS removed_short,
       (SELECT count(*) FROM f) - (SELECT count(*) FROM d) AS removed_duplicate,
       (SELECT count(*) FROM d) AS rows_out""")
def prepare_accounting(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    c = P.with_clean_text(d, "text")
    # one pass: short rows fall into the NULL group, kept rows group by text
    t = F.when(F.length("clean_text") >= DOC_MIN_LENGTH, F.col("clean_text"))
    groups = c.groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("k"))
    kept = F.col("t").isNotNull()
    return groups.agg(
        F.sum("k").alias("rows_in"),
        F.coalesce(F.sum(F.when(~kept, F.col("k"))), F.lit(0)).alias("removed_short"),
        (F.coalesce(F.sum(F.when(kept, F.col("k"))), F.lit(0)) - F.count(F.when(kept, 1))).alias("removed_duplicate"),
        F.count(F.when(kept, 1)).alias("rows_out"))


# --- D1: seeded fixed-size sample -------------------------------------------------
SAMPLE_N = 100


@query("seeded_sample", f"""
SELECT doc_id, lang FROM documents ORDER BY {sql_seeded_hash('doc_id')}, doc_id LIMIT {SAMPLE_N}""")
def seeded_sample(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    return P.seeded_sample(d, SAMPLE_N, "doc_id")


# --- D2 + X1: per-class capped sample, union ----------------------------------------
PER_CLASS_N = 25


@query("per_class_sample", f"""
SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {sql_seeded_hash('doc_id')}, doc_id) <= {PER_CLASS_N}""")
def per_class_sample(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    return P.per_class_sample(d, "lang", PER_CLASS_N, "doc_id")


# --- D3: stratified 80/20 split -------------------------------------------------------
SPLIT_SQL = f"""
s AS (SELECT doc_id, quality, toxic,
             row_number() OVER (PARTITION BY quality ORDER BY {sql_seeded_hash('doc_id')}, doc_id) AS rk,
             count(*) OVER (PARTITION BY quality) AS n_class FROM labels),
sp AS (SELECT doc_id, quality, toxic, rk <= ceil(0.2 * n_class) AS is_test FROM s)
"""


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT doc_id, quality, is_test FROM sp")
def stratified_split(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return P.stratified_split(lab, "quality", "doc_id").select("doc_id", "quality", "is_test")


# --- U2, A8: balanced class weights on the training rows ---------------------------------
@query("class_weights", f"""
WITH {SPLIT_SQL},
t AS (SELECT quality, count(*) AS n FROM sp WHERE NOT is_test GROUP BY quality)
SELECT quality, n, round(sum(n) OVER () / ((count(*) OVER ()) * n), 4) AS weight FROM t""")
def class_weights_query(spark, sf_dir):
    from ..operators.urgency import class_weights
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    train = P.stratified_split(lab, "quality", "doc_id").where(~F.col("is_test"))
    return class_weights(train, "quality")


# --- A4, P3: mean string length per column and content-based text column --------------
@query("text_column_means", """
WITH m AS (SELECT avg(length(text)) AS avg_text, avg(length(lang)) AS avg_lang,
                  avg(length(source)) AS avg_source FROM documents)
SELECT round(avg_lang, 4) AS avg_lang, round(avg_source, 4) AS avg_source, round(avg_text, 4) AS avg_text,
       CASE WHEN avg_lang > 20 THEN 'lang' WHEN avg_source > 20 THEN 'source'
            WHEN avg_text > 20 THEN 'text' END AS text_column
FROM m""")
def text_column_means(spark, sf_dir):
    from ..sources.csvfiles import find_text_column, mean_lengths
    d = read_table(spark, sf_dir, "documents", ["lang", "source", "text"])
    means = mean_lengths(d)
    # no candidate name: the first column whose mean length exceeds 20
    pick = find_text_column(d, (), L.COMPLAINT_MIN_MEAN_LENGTH, means)
    row = [means["lang"], means["source"], means["text"], pick]
    named = spark.createDataFrame([row], "lang double, source double, text double, text_column string")
    return named.select(F.round("lang", 4).alias("avg_lang"), F.round("source", 4).alias("avg_source"),
                        F.round("text", 4).alias("avg_text"), "text_column")


# --- C3: complaint preparation (P6, P8, P9, F1, F2, language, R1; no dedup, every row) ------
def complaints_311(spark, sf_dir) -> DataFrame:
    """Documents laid out as a 311 extract: Category, Request Type, Request Details, Neighborhood."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return (d.join(lab, "doc_id", "left")
            .select("doc_id", F.col("source").alias("Category"),
                    F.col("quality").cast("string").alias("Request Type"),
                    F.col("text").alias("Request Details"),
                    F.col("toxic").cast("string").alias("Neighborhood")))


@query("complaints_prepare", f"""
WITH raw AS (SELECT d.doc_id, d.source AS Category, CAST(l.quality AS VARCHAR) AS request_type,
                    d.text AS details, CAST(l.toxic AS VARCHAR) AS neighborhood
             FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT * FROM raw WHERE Category IS NOT NULL AND details IS NOT NULL),
t AS (SELECT doc_id, Category AS category,
             coalesce(Category, 'nan') || ' - ' || coalesce(request_type, 'nan') || ' - ' ||
             coalesce(details, 'nan') || ' at ' || coalesce(neighborhood, 'Unknown') AS text FROM s),
c AS (SELECT doc_id, category, {sql_clean('text')} AS clean_text FROM t)
SELECT doc_id, category, clean_text, {sql_script_language('clean_text')} AS language,
       {sql_urgency('clean_text')} AS urgency
FROM c WHERE length(clean_text) >= 20""")
def complaints_prepare(spark, sf_dir):
    raw = complaints_311(spark, sf_dir)
    raw = P.drop_null_rows(raw, ["Category", "Request Details"])
    t = raw.select("doc_id", F.col("Category").alias("category"), P.composite_complaint_text().alias("text"))
    from ..operators.language import with_script_language
    c = lowered_text(with_script_language(P.with_clean_text(t, "text", min_length=20), "clean_text", "language"))
    return c.select("doc_id", "category", "clean_text", "language",
                    urgency_label("_low", lowered=True).alias("urgency"))


# --- X1 + P7 + C4: news preparation, every row of both labels, whole texts ---------------------
@query("news_prepare", f"""
WITH raw AS (SELECT d.doc_id, d.source AS title, d.text,
                    CASE WHEN l.toxic = 1 THEN 'FAKE' ELSE 'REAL' END AS label
             FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT doc_id, label, {sql_clean("coalesce(title, '') || '. ' || coalesce(text, '')")} AS clean_text FROM raw),
f AS (SELECT * FROM c WHERE length(clean_text) >= 30)
SELECT doc_id, label, clean_text FROM f
QUALIFY row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) = 1""")
def news_prepare(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    raw = d.join(lab, "doc_id").select("doc_id", F.col("source").alias("title"), "text", "toxic")
    fake = raw.where(F.col("toxic") == 1).withColumn("label", F.lit("FAKE"))
    real = raw.where(~(F.col("toxic") == 1) | F.col("toxic").isNull()).withColumn("label", F.lit("REAL"))
    both = fake.unionByName(real)
    t = both.select("doc_id", "label", P.composite_news_text("title", "text").alias("full_text"))
    c = P.with_clean_text(t, "full_text", min_length=30)
    return P.keep_first(c.select("doc_id", "label", "clean_text"), ["clean_text"], "doc_id")


# --- F3: request validation --------------------------------------------------------------------
@query("request_validation", """
SELECT conv_id, turn, coalesce(length(text), 0) >= 5 AS valid,
       CASE WHEN coalesce(length(text), 0) >= 5 THEN NULL ELSE 'text shorter than 5 characters' END AS reason
FROM conversations""")
def request_validation(spark, sf_dir):
    d = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    ok = F.coalesce(F.length("text"), F.lit(0)) >= 5
    return d.select("conv_id", "turn", ok.alias("valid"),
                    F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("text shorter than 5 characters"))
                    .alias("reason"))


# --- S13: table preview (row count, column count, first 20 rows) --------------------------------
@query("table_preview", """
SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS row_count, 5 AS column_count
FROM documents ORDER BY doc_id LIMIT 20""")
def table_preview(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    n = d.count()
    return (d.orderBy("doc_id").limit(20)
            .select("doc_id", "n_chars", F.lit(n).cast("long").alias("row_count"),
                    F.lit(len(d.columns)).alias("column_count")))


# --- A10: rollup with grand total ------------------------------------------------------------------
@query("urgency_rollup", f"""
WITH {PREP_SQL},
u AS (SELECT {sql_urgency('clean_text')} AS urgency FROM p)
SELECT coalesce(urgency, 'TOTAL') AS urgency, count(*) AS n FROM u GROUP BY ROLLUP (urgency)""")
def urgency_rollup(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    return R.rollup_counts(prep.withColumn("urgency", urgency_label("_low", lowered=True)), "urgency")


# --- A3: topic volume and mean urgency -----------------------------------------------------------
@query("topic_urgency_volume", f"""
WITH {PREP_SQL},
u AS (SELECT {sql_topic_field('clean_text', 'topic_id')} AS topic_id, {sql_urgency('clean_text')} AS urgency FROM p)
SELECT topic_id, count(*) AS n,
       round(avg(CASE urgency WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END),
             4) AS mean_urgency
FROM u GROUP BY topic_id""")
def topic_urgency_volume(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir, detect_lang=False))
    t = prep.select(topic_rule("_low", lowered=True)["topic_id"].alias("topic_id"),
                    urgency_label("_low", lowered=True).alias("urgency"))
    return R.topic_volume(t)


# --- N1: daily trend with change vs previous day -------------------------------------------------
@query("daily_trend", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT day, event_type, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM d""")
def daily_trend(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["ts", "event_type"])
    return R.daily_trend(e, "ts", "event_type")


# --- N1 by the calendar: days without rows count 0 (single users leave days out) -------------------
@query("calendar_trend", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
f AS (SELECT s.day, s.user_id, coalesce(d.n, 0) AS n FROM s LEFT JOIN d ON s.user_id IS NOT DISTINCT FROM d.user_id AND s.day = d.day)
SELECT day, user_id, n, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS change FROM f""")
def calendar_trend(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["ts", "user_id"])
    return R.calendar_trend(e, "ts", "user_id")


# --- N2: region x class heatmap (pivot) -----------------------------------------------------------
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("region_priority_heatmap", "SELECT r_name, " + ", ".join(
    f"count(*) FILTER (WHERE o_orderpriority = {q(p)}) AS {q(p).replace(chr(39), chr(34))}" for p in PRIORITIES) + """
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def region_priority_heatmap(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # nation and region are dimension tables of fixed size (25 and 5 rows)
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    cust = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey).select("c_custkey", "r_name")
    # pre-aggregate orders per (customer, priority) so the join moves counts, not orders
    per_cust = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("k"))
    j = per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
    return (j.groupBy("r_name").pivot("o_orderpriority", PRIORITIES).agg(F.sum("k"))
            .na.fill(0, subset=PRIORITIES))


# --- N2: neighbourhood x topic heatmap of the complaints (pivot) -------------------------------------
TOPIC_IDS = [str(i) for i in range(-1, len(L.TOPICS))]


@query("neighborhood_topic_heatmap", f"""
WITH t AS (SELECT coalesce(CAST(l.toxic AS VARCHAR), 'Unknown') AS neighborhood, {sql_topic_field(sql_clean('d.text'), 'topic_id')} AS topic_id
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT neighborhood, """ + ", ".join(f'count(*) FILTER (WHERE topic_id = {i}) AS "{i}"' for i in TOPIC_IDS) + " FROM t GROUP BY neighborhood")
def neighborhood_topic_heatmap(spark, sf_dir):
    c = lowered_text(P.with_clean_text(complaints_311(spark, sf_dir).withColumnRenamed("Request Details", "details"), "details"))
    t = c.select(F.coalesce("Neighborhood", F.lit("Unknown")).alias("neighborhood"),
                 topic_rule("_low", lowered=True)["topic_id"].cast("string").alias("topic_id"))
    return R.pivot_counts(t, "neighborhood", "topic_id", TOPIC_IDS)


# --- C11: the report of a prepared table: row count and class shares in one pass ----------------------
@query("prepared_report", f"""WITH {PREP_SQL},
u AS (SELECT language, source, {sql_urgency('clean_text')} AS urgency FROM p),
r AS (SELECT 'rows' AS section, 'all' AS class, count(*) AS n FROM u
      UNION ALL SELECT 'language', language, count(*) FROM u GROUP BY language
      UNION ALL SELECT 'source', source, count(*) FROM u GROUP BY source
      UNION ALL SELECT 'urgency', urgency, count(*) FROM u GROUP BY urgency)
SELECT section, class, n, round(n / (SELECT count(*) FROM u), 4) AS share FROM r""")
def prepared_report(spark, sf_dir):
    prep = lowered_text(prepared_documents(spark, sf_dir))
    return R.report(prep.withColumn("urgency", urgency_label("_low", lowered=True)), "language", "source", "urgency")


# --- A1: language distribution of the prepared table ------------------------------------------
@query("language_distribution", f"""WITH {PREP_SQL}
SELECT language, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM p GROUP BY language""")
def language_distribution(spark, sf_dir):
    return R.distribution(prepared_documents(spark, sf_dir), "language")


# --- P11: dense row numbers in key order (skew-safe, no one-partition sort) ---------------------
@query("dense_row_ids", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_num "
                        "FROM documents")
def dense_row_ids(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    return P.dense_row_ids(d, "doc_id")
