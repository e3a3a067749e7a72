"""SQL text of the same expressions, for the independent DuckDB oracle.

These mirror ``functions.text`` / ``functions.rules`` with the identical regex
strings, so each Spark query can be checked against plain SQL on the same
parquet tables.
"""

from __future__ import annotations

from ..functions import lexicons as L
from ..functions.text import TOKEN_PATTERN, clean_steps


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_clean(expr: str, extended_scripts: bool = False, nan_for_null: bool = True) -> str:
    out = f"coalesce(CAST({expr} AS VARCHAR), 'nan')" if nan_for_null else f"coalesce({expr}, '')"
    for pattern, repl in clean_steps(extended_scripts):
        out = f"regexp_replace({out}, {q(pattern)}, {q(repl)}, 'g')"
    return f"trim({out}, ' ')"


def sql_contains_any(lowered: str, keywords) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {q(k)})" for k in keywords) + ")"


def sql_urgency(expr: str, lexicon=None) -> str:
    lexicon = L.TRAINING_URGENCY if lexicon is None else lexicon
    low = f"lower({expr})"
    whens = " ".join(f"WHEN {sql_contains_any(low, kws)} THEN {q(label)}" for label, kws in lexicon)
    return f"(CASE {whens} ELSE 'LOW' END)"


def sql_api_urgency_field(expr: str, field: str) -> str:
    """One field of the request-time urgency result: urgency, confidence or p_low..p_critical."""
    low = f"lower({expr})"
    idx = {"p_low": 0, "p_medium": 1, "p_high": 2, "p_critical": 3}

    def val(label, conf):
        if field == "urgency":
            return q(label)
        if field == "confidence":
            return f"CAST({conf} AS DOUBLE)"
        return f"CAST({L.API_URGENCY_PROBABILITIES[label][idx[field]]} AS DOUBLE)"

    whens = " ".join(f"WHEN {sql_contains_any(low, kws)} THEN {val(label, conf)}" for label, conf, kws in L.API_URGENCY)
    d_label, d_conf = L.API_URGENCY_DEFAULT
    return f"(CASE {whens} ELSE {val(d_label, d_conf)} END)"


def sql_topic_field(expr: str, field: str) -> str:
    """topic_id, topic_label, confidence or keywords (joined with '|')."""
    low = f"lower({expr})"
    no_id, no_label, no_conf = L.NO_TOPIC

    def val(tid, label, conf, kws):
        return {"topic_id": f"CAST({tid} AS INTEGER)", "topic_label": q(label),
                "confidence": f"CAST({conf} AS DOUBLE)", "keywords": q("|".join(kws))}[field]

    whens = " ".join(
        f"WHEN {sql_contains_any(low, kws)} THEN {val(i, label, L.TOPIC_CONFIDENCE, kws[:L.TOPIC_KEYWORDS_SHOWN])}"
        for i, (label, kws) in enumerate(L.TOPICS))
    return f"(CASE {whens} ELSE {val(no_id, no_label, no_conf, [])} END)"


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(TOKEN_PATTERN)})"


def sql_seeded_hash(key: str, seed: int = L.SEED) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def sql_script_language(expr: str) -> str:
    from ..operators.language import INDIC_RANGE, LETTER_CLASS, SCRIPT_BLOCKS
    indic = f"regexp_replace({expr}, {q('[^' + INDIC_RANGE + ']')}, '', 'g')"
    letters = f"length(regexp_replace({expr}, {q('[^' + LETTER_CLASS + ']')}, '', 'g'))"
    counts = [(code, f"length(regexp_replace({indic}, {q('[^' + rng + ']')}, '', 'g'))") for code, rng in SCRIPT_BLOCKS]
    best_n = "greatest(" + ", ".join(c for _, c in counts) + ")"
    # the struct comparison in Spark breaks count ties by the larger code
    best_lang = "(CASE " + " ".join(
        f"WHEN {c} = {best_n} THEN {q(code)}" for code, c in sorted(counts, key=lambda t: t[0], reverse=True)) + " END)"
    return (f"(CASE WHEN NOT regexp_matches(coalesce({expr}, ''), {q('[' + LETTER_CLASS + ']')}) THEN 'unknown' "
            f"WHEN length({indic}) = 0 THEN 'en' "
            f"WHEN {best_n} * 2 > {letters} THEN {best_lang} ELSE 'en' END)")


def sql_supported_language(expr: str) -> str:
    codes = ", ".join(q(c) for c in L.SUPPORTED_LANGUAGES)
    return f"(CASE WHEN {expr} IN ({codes}) THEN {expr} ELSE 'en' END)"
