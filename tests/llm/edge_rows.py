"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

#: Names that the operators use inside.
CLASHES = ("n", "node", "sig", "row", "kind", "kept", "weight", "topic", "n_tokens", "lang_pred", "score", "attempt", "words", "_found", "key", "rep")


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(120))
    near = base.split()
    near[60] = "changed"
    out = [None, "", "   \n\t ", "word", "two words", base, base, " ".join(near), base.upper(), "Ünïcode ÉÈ straße 水 \U0001f642 x_1 " * 5,
           "!!! ... 12345 678", "same same same same same same", "z" * 70_000, " ".join(word() for _ in range(20_000)),
           "Call +1 (830) 555-5433 or mail a.b9@mail3.example.com from 10.20.30.40.", "a\nb\na\n\nb\n  \nb"]
    return out


def documents(spark):
    """``documents`` with a null id, repeated rows, null languages and sources, and clashing extra columns."""
    langs, rows = ["en", "de", None], []
    for i, t in enumerate(texts()):
        rows.append((i, t, langs[i % 3], None if i % 5 == 4 else f"s{i % 2}", len(t or "")) + ("clash",) * len(CLASHES))
    rows.append((5,) + rows[5][1:])  # a repeated row
    rows.append((None,) + rows[6][1:])
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return documents(spark).limit(0)
