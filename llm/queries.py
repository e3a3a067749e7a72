"""The registered queries ``opN_<name>`` of the operators, with their DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import context_tree, decontaminate, language_profiles, license_scan, mixing, ngram_join, periodic_runs, prefix_forest, prefix_trie, quality_rules, surrogates, token_counts, url_filter
from .shared import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP2_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
         JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM dw UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM dw d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY 1) k USING (doc_id)
"""


@query("op2_ngram_join", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
spot AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS t
         FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hit AS (SELECT s.doc_id, s.i, s.size, n.item_id FROM spot s JOIN win n ON s.t = n.t AND s.size = n.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op10_decontaminate", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op7_context_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context_tree.score_texts(table(spark, sf_dir, "documents"))
    return found.withColumn("bits_per_byte", -F.col("score") * 3.321928094887362 / F.greatest("n_bytes", F.lit(1)))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_profiles.identify(table(spark, sf_dir, "documents"))


@query("op1_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_private(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities", "entity_kinds")


def op4_sql(rounds: int = 25) -> str:
    """The fit unrolled: one CTE a marginal and round; targets as in ``mixing.TARGETS``."""
    lang = mixing.TARGETS["lang"]
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lang.items())
    parts = [r"""
WITH t AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
    CASE WHEN contains(x, 'License') THEN 'licensed' WHEN contains(x, '@') OR contains(x, 'token = ') THEN 'personal' WHEN contains(x, ' | ') THEN 'table'
         WHEN contains(x, '%%%') OR contains(x, '!!') THEN 'noise' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM t GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for m in mixing.MARGINALS:
        spec = mixing.TARGETS[m]
        parts.append(f"o_{m} AS (SELECT {m}, sum(tokens) AS own FROM cells GROUP BY 1)")
        if isinstance(spec, dict):
            parts.append(f"f_{m} AS (SELECT {m}, own, CASE {m} {cases} END AS fixed FROM o_{m})")
            parts.append(f"p_{m} AS (SELECT {m}, own, coalesce(fixed, greatest(0.0, 1 - coalesce(sum(fixed) OVER (), 0)) * own / sum(own) FILTER (WHERE fixed IS NULL) OVER ()) AS part FROM f_{m})")
        else:
            parts.append(f"p_{m} AS (SELECT {m}, own, pow(own, {spec}) AS part FROM o_{m})")
        parts.append(f"g_{m} AS (SELECT {m}, sum(own) OVER () * part / sum(part) OVER () AS goal FROM p_{m})")
    parts.append("w0 AS (SELECT *, tokens AS w FROM cells)")
    k = 0
    for _ in range(rounds):
        for m in mixing.MARGINALS:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT w{k}.* REPLACE (w * goal / sum(w) OVER (PARTITION BY w{k}.{m}) AS w) FROM w{k} JOIN g_{m} ON w{k}.{m} = g_{m}.{m})")
            k += 1
    parts.append(f"""f0 AS (SELECT source, lang, topic, tokens, w / tokens AS weight FROM w{k}),
f1 AS (SELECT *, {mixing.BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
              sum(tokens * weight) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM f0),
c AS (SELECT max_by(open / below, weight) AS number FROM f1 WHERE open / below * weight <= 1),
fit AS (SELECT source, lang, topic, weight, least(1.0, weight * number) AS probability FROM f0, c)""")
    return ",\n".join(parts) + f"""
SELECT doc_id, t.source, t.lang, t.topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
       CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS kept
FROM t LEFT JOIN fit USING (source, lang, topic)
"""


@query("op4_mixing", op4_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce("source", F.lit("(null)")).alias("source"), F.coalesce("lang", F.lit("(null)")).alias("lang"), "topic", "n_tokens",
                        F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_sql() -> str:
    """Every block against every template of fitting size."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in sorted(license_scan.TEMPLATES.items()) for text in texts)
    t = license_scan.THRESHOLD
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE [] END"
    return rf"""
WITH t(name, text) AS (VALUES {quoted}),
tg AS (SELECT name, {grams} AS g FROM (SELECT name, {words.format('text')} AS w FROM t)),
b AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)),
        regexp_split_to_array(coalesce(text, ''), '
[ 	-
]*
'), [coalesce(text, '')])) AS b FROM documents),
bg AS (SELECT doc_id, b, {grams} AS g FROM (SELECT doc_id, b, {words.format('b')} AS w FROM b)),
d AS (SELECT doc_id, b, name, 2.0 * len(list_intersect(bg.g, tg.g)) / (len(bg.g) + len(tg.g)) AS dice
      FROM bg JOIN tg ON len(bg.g) BETWEEN len(tg.g) * {t / (2 - t)} AND len(tg.g) * {(2 - t) / t} WHERE len(bg.g) > 0),
f AS (SELECT * FROM d WHERE dice >= {t} QUALIFY row_number() OVER (PARTITION BY doc_id, b ORDER BY dice DESC, name) = 1),
best AS (SELECT doc_id, name, dice FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) = 1),
every AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM (SELECT DISTINCT doc_id, name FROM f) GROUP BY 1)
SELECT doc_id, best.name AS license, coalesce(dice, 0.0) AS score, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id)
"""


@query("op8_license_scan", op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


CRC32_SQL = """crc_step AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY b) AS t
             FROM range(256) r(b))"""


def crc32_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of an ASCII text, by the byte table of ``CRC32_SQL`` (in scope as ``crc_step``)."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1])), 4294967295)"


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the words of a tenth of the documents, with a tail that repeats itself; the others' texts as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    sized = lambda w: F.struct(w.alias("w"), F.size(w).cast("long").alias("n"), F.floor(h / 10).alias("g"))
    placed = lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), (s["g"] % s["n"]).alias("a"), (s["g"] % 8 + 3).alias("k"))
    tail = lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"), (F.floor((s["n"] - s["a"]) / s["k"]) + 1).alias("p"))
    moved = lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(
        s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))), " ")
    steps = F.filter(F.transform(F.array(words), sized), lambda s: s["n"] > 0)  # one element: each step is evaluated once
    text = F.transform(F.transform(F.transform(steps, placed), tail), moved)
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(text, F.lit(0))).otherwise(F.col("text")).alias("text"))


OP13_SQL = rf"""
WITH {CRC32_SQL},
d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql('CAST(doc_id AS VARCHAR)')} AS h FROM documents, crc_step),
d1 AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w FROM d1),
x AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM d),
same AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND b.i - a.i <= a.n // 2),
island AS (SELECT doc_id, p, min(i) AS s, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM same) GROUP BY doc_id, p, g HAVING count(*) + p >= greatest(12, 2 * p)),
run AS (SELECT doc_id, s AS start, m + p AS length, min(p) AS period FROM island GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
left_over AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY 1),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
every AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(every.n, 0) AS BIGINT) AS n_runs, start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(every.t, '')) AS runs_sha256, sha256(coalesce(left_over.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.m")).alias("length"), "best.period",
        F.floor(F.lit(-1000) * F.col("best.m") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = rf"""
WITH {CRC32_SQL},
t AS (SELECT conv_id, turn, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, dg, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_step),
r AS (SELECT c.conv_id, 0 AS part, pos, dg, bytes FROM c JOIN own ON own.conv_id = c.base AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, dg, bytes FROM c JOIN own USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, string_agg(dg, '' ORDER BY part, pos) AS k, list(bytes ORDER BY part, pos) AS b FROM r GROUP BY 1),
full_ AS (SELECT conv_id, coalesce(k, '') AS k, coalesce(b, []) AS b FROM c LEFT JOIN p USING (conv_id)),
pre AS (SELECT conv_id, d, k[1:32 * d] AS key, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes, len(b) = d AS ends FROM (SELECT *, unnest(range(len(b) + 1)) AS d FROM full_)),
node AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM pre GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, key[1:32 * (d - 1)] AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
up AS (SELECT u AS d, key[1:32 * u] AS key, leaf, saved FROM (SELECT n.key, unnest(range(n.d + 1)) AS u, CAST(kids.n IS NULL AS INTEGER) AS leaf, (n_convs - 1) * bytes AS saved
       FROM node n LEFT JOIN kids USING (d, key))),
sums AS (SELECT d, key, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM node n LEFT JOIN kids USING (d, key) JOIN sums USING (d, key) LEFT JOIN node m ON m.d = n.d - 1 AND m.key = n.key[1:32 * (n.d - 1)]
"""


def crossed_conversations(conversations: DataFrame) -> DataFrame:
    """``paths`` of the conversations with the first turns of another in front; see the contract of operator 12."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", prefix_trie.turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    placed = saved(turns.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))), "turns")
    ids = placed.select("conv_id").distinct()
    lead = placed.where("place <= 8").select(F.col("conv_id").alias("base"), (F.col("place") - 9).alias("place"), "digest", "size")
    lead = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(lead, "base").where(F.col("place") <= h - 9)
    rest = placed.where(F.col("place") > h)
    return prefix_trie.paths(rest.select("conv_id", "place", "digest", "size").unionByName(lead.select("conv_id", "place", "digest", "size")), ids)


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = saved(crossed_conversations(table(spark, sf_dir, "conversations")), "paths")
    nodes = prefix_trie.prefix_trie(paths)
    found = nodes.join(prefix_trie.ended_digests(paths), "ended", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


@query("op11_prefix_forest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = prefix_forest.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, key="vec_id", vec="embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
