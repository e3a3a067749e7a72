"""Mixing sources to target weights by iterative proportional fitting (operator 4).

``mix`` rakes the token weights of the cells (source, language, topic) until the weighted
tokens of every source, language and topic have their target shares. The rate of a cell is its
factor times one number for all cells, set so that the share ``budget`` of all tokens is kept. Taken
at their rates, the tokens have the target mix in expectation. A document counts at most once, so its probability is the
rate up to 1; a cell of a greater rate is kept whole, falls short of its target by what its rate is above 1, and the number
for all cells makes up for it in the others. So a small cell, however rare, moves the others by no more than its own tokens.
A document is kept when the uniform number made of its id is below its probability, so a run can be repeated.

Targets, one for each marginal: a number ``a`` tempers the natural shares (share ** a, made to
sum to one); a dict fixes the shares of some values, and the others share the rest by their tokens.
Values without tokens have no target.

The documents meet one partial aggregate (a hot source collapses before the shuffle) and one join
with the cell table, which Spark broadcasts only below its size threshold. The fit runs on the
cells: on the driver when a count shows at most ``LOCAL_CELLS`` of them, else as windows over the
cell table; both do the same steps.

Defined results: a null source, language or topic is the value ``(null)``. A null or wordless
text has no tokens; its document takes the probability of its cell, or that of the product of
its marginals' factors where the cell has no tokens at all. Very long texts count all their tokens. Repeated rows count each,
and are kept or left out together, as their ids are equal. A null id counts as the empty string. An empty table gives an
empty result. Extra columns stay, but for those named like the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, saved, with_columns_set

LOCAL_CELLS = 100_000
ROUNDS = 200
CLOSE = 1e-10
FAR = 230.0  # logarithm: the furthest a factor moves in one step, as to a target of none
MOST = 690.0  # logarithm: a weight stays a number
MARGINALS = ("source", "lang", "topic")

#: Moderate targets: the further they lie from the natural shares, the more documents go.
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.8, "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.12}, "topic": 0.9}

BUDGET = 0.5  # share of all tokens that is kept, in expectation

SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """A stand-in topic by the form of the text, for tables without a topic column: the first that fits. ``mix`` takes any other."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("License"), "licensed").when(t.contains("@") | t.contains("token = "), "personal")
            .when(t.contains(" | "), "table").when(t.contains("%%%") | t.contains("!!"), "noise").otherwise("prose"))


def unit_of(key: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) made of the key."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def target_shares(cells: DataFrame, name: str, spec: float | dict[str, float]) -> DataFrame:
    """``(name, goal)``: target tokens of each value with tokens; they sum to all tokens."""
    own = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("own")).where("own > 0")
    every = Window.partitionBy(F.lit(0))  # one row a value
    if isinstance(spec, dict):
        listed = F.create_map(*[x for k, v in spec.items() for x in (F.lit(k), F.lit(float(v)))]) if spec else F.create_map().cast("map<string,double>")
        own = own.withColumn("fixed", F.try_element_at(listed, F.col(name)))
        rest = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("fixed").over(every), F.lit(0.0)))
        free = F.sum(F.when(F.col("fixed").isNull(), F.col("own"))).over(every)
        own = own.withColumn("part", F.coalesce("fixed", rest * F.col("own") / free))
    else:
        own = own.withColumn("part", F.pow("own", F.lit(float(spec))))
    return own.select(name, (F.sum("own").over(every) * F.col("part") / F.sum("part").over(every)).alias("goal"))


def _fit_rows(rows: list[dict], goals: dict[str, dict[str, float]], rounds: int) -> dict[str, dict[str, float]]:
    """Logarithms of the multipliers of every marginal value, by numpy on the driver.

    Multipliers of targets that contradict each other drift apart without end; as logarithms their products stay exact.
    """
    import numpy as np

    if not rows:
        return {m: {} for m in MARGINALS}
    weight = np.array([r["tokens"] for r in rows], float)
    names, at = {}, {}
    for m in MARGINALS:
        names[m] = sorted(goals[m])
        place = {v: i for i, v in enumerate(names[m])}
        at[m] = np.array([place[r[m]] for r in rows], np.int64)
    goal = {m: np.array([goals[m][v] for v in names[m]]) for m in MARGINALS}
    factor = {m: np.zeros(len(names[m])) for m in MARGINALS}
    for _ in range(rounds):
        off = 0.0
        for m in MARGINALS:
            now = np.bincount(at[m], weight, len(names[m]))
            step = np.where(now > 0, goal[m] / np.where(now > 0, now, 1), 1.0)
            weight *= step[at[m]]
            factor[m] += np.log(np.clip(step, np.exp(-FAR), np.exp(FAR)))
            off = max(off, float(np.abs(step - 1).max()))
        if off < CLOSE:
            break
    return {m: dict(zip(names[m], factor[m].tolist())) for m in MARGINALS}


def _fit_table(cells: DataFrame, goals: dict[str, DataFrame], rounds: int) -> DataFrame:
    """The same fit with windows, for more cells than the driver takes; a table is written each round."""
    out = cells.where("tokens > 0").withColumn("w", F.col("tokens").cast("double"))
    for m in MARGINALS:
        out = out.join(goals[m].withColumnRenamed("goal", f"goal_{m}"), m).withColumn(f"f_{m}", F.lit(0.0))
    for _ in range(rounds):
        off = F.lit(0.0)
        for m in MARGINALS:
            out = out.withColumn("step", F.col(f"goal_{m}") / F.sum("w").over(Window.partitionBy(m)))
            out = out.withColumn("w", F.col("w") * F.col("step")).withColumn(f"f_{m}", F.col(f"f_{m}") + F.log(F.greatest(F.exp(F.lit(-FAR)), F.least(F.exp(F.lit(FAR)), F.col("step"))))).withColumn(f"off_{m}", F.abs(F.col("step") - 1))
            off = F.greatest(off, F.col(f"off_{m}"))
        out = saved(out.withColumn("off", off).drop("step", *[f"off_{m}" for m in MARGINALS]), "fit")
        if (out.agg(F.max("off")).first()[0] or 0.0) < CLOSE:
            break
        out = out.drop("off")
    return out


def calibrate(weights: DataFrame, budget: float) -> float:
    """The number that, times the weights and cut at 1, keeps the share ``budget`` of the tokens; each step is an aggregate over cells.

    A cell that reaches rate 1 stays there, as the number only grows from step to step.
    """
    total = weights.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return float("inf")
    number = 0.0
    while True:
        full = F.col("weight") * number >= 1
        s = weights.agg(F.sum(F.when(full, F.col("tokens"))).alias("whole"), F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).alias("open")).first()
        if not s["open"]:
            return float("inf")  # the budget asks for everything
        step = (budget * total - (s["whole"] or 0)) / s["open"]
        if step <= number * (1 + 1e-12):
            return number
        number = step


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]] = TARGETS, rounds: int = ROUNDS, local_cells: int = LOCAL_CELLS,
         budget: float = BUDGET) -> DataFrame:
    """``(source, lang, topic, weight, rate, probability)`` of every cell of ``cells (source, lang, topic, tokens)``."""
    spark = cells.sparkSession
    goals = {m: target_shares(cells, m, targets.get(m, 1.0)) for m in MARGINALS}
    if cells.count() <= local_cells:
        full = [r.asDict() for r in cells.where("tokens > 0").collect()]
        fitted = _fit_rows(full, {m: {r[m]: r["goal"] for r in goals[m].collect()} for m in MARGINALS}, rounds)
        factors = {m: spark.createDataFrame(list(fitted[m].items()) or [("", 0.0)], f"{m} string, f_{m} double") for m in MARGINALS}
    else:
        fitted_cells = _fit_table(cells, goals, rounds)
        factors = {m: fitted_cells.groupBy(m).agg(F.max(f"f_{m}").alias(f"f_{m}")) for m in MARGINALS}
    out = cells
    for m in MARGINALS:
        out = out.join(factors[m], m, "left").withColumn(f"f_{m}", F.coalesce(f"f_{m}", F.lit(0.0)))
    far = F.col("f_source") + F.col("f_lang") + F.col("f_topic")
    out = saved(out.withColumn("weight", F.exp(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), far)))), "weights")
    rate = F.col("weight") * F.lit(calibrate(out.where("tokens > 0"), budget))
    return out.select(*MARGINALS, "weight", rate.alias("rate"), F.least(F.lit(1.0), rate).alias("probability"))


def mix(docs: DataFrame, targets: dict[str, float | dict[str, float]] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
        topic: Column | None = None, tokens: Column | None = None, rounds: int = ROUNDS, local_cells: int = LOCAL_CELLS, budget: float = BUDGET) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, ``weight``, ``rate``, ``probability`` and ``kept`` for every row.

    ``topic`` and ``tokens``: expressions for the topic (default ``form_topic``) and the tokens (default words).
    """
    text = F.col(f"`{text_col}`")
    value = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    staged = with_columns_set(docs, {"topic": value(form_topic(text) if topic is None else topic), "n_tokens": word_count(text) if tokens is None else tokens})
    marks = staged.select(value(F.col("source")).alias("source"), value(F.col("lang")).alias("lang"), "topic", "n_tokens")
    cells = saved(marks.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    s, l, t, w, r, p = names = free(staged, "_source", "_lang", "_topic", "_weight", "_rate", "_probability")
    found = saved(rake(cells, targets, rounds, local_cells, budget), "probabilities").toDF(*names)
    out = staged.join(found, (value(F.col("source")) == F.col(s)) & (value(F.col("lang")) == F.col(l)) & (F.col("topic") == F.col(t)), "left")
    out = with_columns_set(out, {"weight": F.col(w), "rate": F.col(r), "probability": F.col(p), "kept": unit_of(F.col(f"`{id_col}`")) < F.col(p)})
    return out.drop(*names)
