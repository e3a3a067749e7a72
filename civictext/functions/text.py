"""Text scalar functions as Spark Column expressions (JVM-side, codegen'd).

The cleaning chain replaces each match with one space, in a fixed order:
URLs, e-mail addresses, HTML tags, emoji ranges, then any character outside
the keep set; whitespace runs are collapsed and the result is trimmed.

Whitespace is spelled out as Python's Unicode whitespace set, because Java's
``\\s`` (and RE2's) only covers ASCII. The same pattern text is valid in Java
regex and in RE2, so the DuckDB oracle uses the identical strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (patterns whose matches must equal the source system's)
# ---------------------------------------------------------------------------
WS_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
URL_PATTERN = rf"https?://[^{WS_CHARS}]+|www\.[^{WS_CHARS}]+"
EMAIL_PATTERN = rf"[^{WS_CHARS}]+@[^{WS_CHARS}]+\.[^{WS_CHARS}]+"
HTML_PATTERN = r"<[^>]+>"
EMOJI_PATTERN = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
# Indic blocks kept by default: Devanagari, Telugu, Tamil, Bengali.
KEPT_SCRIPT_RANGES = r"\x{0900}-\x{097F}\x{0C00}-\x{0C7F}\x{0B80}-\x{0BFF}\x{0980}-\x{09FF}"
# Opt-in extension: Gujarati, Kannada, Malayalam.
EXTENDED_SCRIPT_RANGES = r"\x{0A80}-\x{0AFF}\x{0C80}-\x{0CFF}\x{0D00}-\x{0D7F}"
WHITESPACE_RUN = rf"[{WS_CHARS}]+"
# Same matches as EMAIL_PATTERN: a match always spans a whole whitespace-delimited
# run (the last part is greedy to the run's end), so it can only start where a run
# starts. Anchoring there skips the per-position backtracking of the original.
EMAIL_PATTERN_RUN_START = rf"(?<![^{WS_CHARS}])" + EMAIL_PATTERN
# Same matches as EMOJI_PATTERN: one range holding all of its ranges is tested first, so
# that a character of an ordinary text costs one comparison. (``&&`` is Java's.)
EMOJI_PATTERN_IN_RANGE = rf"[[\x{{24C2}}-\x{{1F6FF}}]&&{EMOJI_PATTERN[:-1]}]+"
# Word tokens: Unicode letters, digits and underscore.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def disallowed_char_pattern(extended_scripts: bool = False) -> str:
    """One character outside letters, digits, ``_``, ``.,!?;:-``, kept scripts and whitespace."""
    extra = EXTENDED_SCRIPT_RANGES if extended_scripts else ""
    return rf"[^\p{{L}}\p{{N}}_.,!?;:\-{KEPT_SCRIPT_RANGES}{extra}{WS_CHARS}]"


def clean_steps(extended_scripts: bool = False) -> list[tuple[str, str]]:
    """The (pattern, replacement) chain, in application order."""
    return [
        (URL_PATTERN, " "),
        (EMAIL_PATTERN, " "),
        (HTML_PATTERN, " "),
        (EMOJI_PATTERN, " "),
        (disallowed_char_pattern(extended_scripts), " "),
        (WHITESPACE_RUN, " "),
    ]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Literals a text must contain for a step to change it (checked before the regex runs).
_STEP_GUARD = {URL_PATTERN: ("://", "www."), EMAIL_PATTERN: ("@",), HTML_PATTERN: ("<",)}
# Steps that have a faster pattern of the same matches.
_JAVA_PATTERN = {EMAIL_PATTERN: EMAIL_PATTERN_RUN_START, EMOJI_PATTERN: EMOJI_PATTERN_IN_RANGE}


def _collapse_pattern(extended_scripts: bool) -> str:
    """Disallowed characters and whitespace in one class: replacing each disallowed
    character by a space and then collapsing whitespace runs equals replacing every
    run of (disallowed or whitespace) characters by one space."""
    extra = EXTENDED_SCRIPT_RANGES if extended_scripts else ""
    return runs_to_one_space(rf"[^\p{{L}}\p{{N}}_.,!?;:\-{KEPT_SCRIPT_RANGES}{extra}]")


def runs_to_one_space(char_class: str) -> str:
    """Java pattern of the runs of ``char_class`` (blanks in it, ``a-z`` not) that are no single blank yet.

    Replacing them by one space equals replacing every run. Most runs of a text are the single
    blanks between its words: they are not matches, and ``a-z`` is told apart by one comparison.
    """
    one = rf"[[^a-z]&&{char_class}]"
    return rf"{one}(?:{one}+|(?<! ))"


def clean_text(c, extended_scripts: bool = False) -> Column:
    """Cleaned text; NULL becomes ``""`` and blank text falls out as ``""``.

    Same result as applying ``clean_steps`` in order (the SQL oracle does
    exactly that); here steps that need a literal (``://``/``www.``, ``@``,
    ``<``) run only on rows containing it, and the last two steps share one pass.
    """
    raw = F.coalesce(_col(c), F.lit(""))
    out = raw
    steps = clean_steps(extended_scripts)
    for pattern, repl in steps[:4]:
        guard = _STEP_GUARD.get(pattern)
        replaced = F.regexp_replace(out, _JAVA_PATTERN.get(pattern, pattern), repl)
        if guard:
            # Steps only turn characters into spaces, so a literal missing from the
            # raw text is missing from every later stage too. Testing the raw text
            # keeps each stage's value referenced once (inside the taken branch).
            cond = None
            for g in guard:
                cond = (F.instr(raw, g) > 0) if cond is None else cond | (F.instr(raw, g) > 0)
            out = F.when(cond, replaced).otherwise(out)
        else:
            out = replaced
    out = F.regexp_replace(out, _collapse_pattern(extended_scripts), " ")
    return F.btrim(out, F.lit(" "))


def null_as_nan(c) -> Column:
    """String form of a value the way a dataframe ``astype(str)`` writes NULL."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))


def tokens(c) -> Column:
    """Lower-cased word tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), 0)


def spaced_tokens(c) -> Column:
    """The word tokens of ``tokens`` as one string, one space between them."""
    return F.btrim(F.regexp_replace(F.lower(_col(c)), runs_to_one_space(rf"[^{TOKEN_PATTERN[1:-2]}]"), " "), F.lit(" "))


def contains_any(lowered: Column, keywords) -> Column:
    """Plain substring test against any keyword (no word boundaries)."""
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | lowered.contains(kw)
    return cond


def blank_as_empty_word(c) -> Column:
    """Blank text is embedded as the word ``empty``."""
    col = _col(c)
    return F.when(F.coalesce(F.btrim(col, F.lit(" ")), F.lit("")) == "", F.lit("empty")).otherwise(col)


def truncate(c, n: int) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(_col(c), 1, n)


def supported_language(c, supported) -> Column:
    """Keep a supported language code; anything else is reported as ``en``."""
    col = _col(c)
    return F.when(col.isin(list(supported)), col).otherwise(F.lit("en"))


def once(expr: Column) -> Column:
    """Evaluate an expensive expression once even when a filter follows it.

    A filter on a projected column is pushed below the projection with the
    expression copied into it, so a regex chain would run twice. Producing the
    value through a one-element generator keeps the filter above it; the whole
    thing still compiles into one codegen stage. Use with ``select``.
    """
    return F.explode(F.array(expr))
