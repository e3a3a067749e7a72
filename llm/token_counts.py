"""Token counts of whole texts with overlap resynchronisation (operator 3).

Texts of at most ``chunk`` characters are counted in one task. A longer text becomes chunks
that overlap by ``overlap`` characters and are dealt over the tasks, so one huge document is
neither one task nor one encoding; the overlaps are encoded with offsets, and each chunk returns the
pre-token starts inside its overlaps with the number of tokens before them.

Splice. For a byte-level BPE whose pre-tokeniser is the left-to-right pattern without
look-behind, and without a normaliser, tokens never cross pre-tokens and a scan that
starts at a pre-token start goes on alike whatever lies before it. The first chunk is
right from its start on; a pre-token start that two neighbouring chunks share, and
that lies ``margin`` before the end of the left one (so no cut special token or look-ahead
reaches it), is a boundary of the whole text, and the right chunk is right from it on.
Then  tokens = sum over splices (tokens left of it in the left chunk - tokens left of it
in the right chunk) + tokens of the last chunk. Texts in which some overlap has no shared
boundary (a very long word, say) are done again with an overlap four times as wide, until
all fit; at the latest a text is one chunk.

Inside a task texts are encoded in pieces of about ``PIECE`` characters, which the library does
faster than long ones. They are cut between a character that is no white space and a blank or
line end: no pre-token of the pattern holds white space after another character, so such a
cut is a pre-token start in every scan.

Other tokenizers lack that proof: ``spliceable`` refuses them and whole texts are encoded.

Defined results: null text: 0 bytes, 0 tokens. Every input row gives one row, also when
ids repeat or are null. Special strings inside a text count as the library counts them.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

CHUNK = 32_768
OVERLAP = 1_024
PIECE = 1_024
BATCH_CHARS = 1 << 19


def vocabulary(name: str) -> str:
    """Where the tokenizer file lies on this machine; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def spliceable(name: str) -> tuple[bool, int]:
    """Whether the proof above holds for a ``.json`` tokenizer, and the margin its special tokens need."""
    with open(vocabulary(name), encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) \
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return plain, 2 + max([14, *(len(t["content"]) for t in spec.get("added_tokens", []))])


def _open(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is what Spark gave it
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def starts_in(e, start: int, low: int, high: int) -> dict[int, int]:
    """Pre-token starts ``low <= p <= high`` of an encoding that begins at ``start``, with the tokens before each."""
    out: dict[int, int] = {}
    t = e.char_to_token(max(0, low - start))
    n = len(e)
    while t is not None and t < n:
        p = start + e.token_to_chars(t)[0]
        if p > high:
            break
        if p >= low and (t == 0 or e.token_to_word(t) != e.token_to_word(t - 1)):
            out[p] = t
        t += 1
    return out


_STABLE = re.compile(r"\S[ \n]")


def stable_cuts(text: str, piece: int | None) -> list[int]:
    """0, the length, and between them about every ``piece`` characters a position that is a pre-token start in every scan."""
    cuts, at = [0], piece or len(text)
    while at < len(text) and (m := _STABLE.search(text, at - 1)):
        cuts.append(m.start() + 1)
        at = cuts[-1] + piece
    return [*cuts, len(text)]


def token_totals(tokenizer, texts: list[str], piece: int | None) -> list[int]:
    """Tokens of each text; all their pieces are encoded together."""
    cuts = [stable_cuts(t, piece) for t in texts]
    found = tokenizer.encode_batch_fast([t[a:b] for t, c in zip(texts, cuts) for a, b in zip(c, c[1:])], add_special_tokens=False)
    sizes = iter(len(e) for e in found)
    return [sum(next(sizes) for _ in c[1:]) for c in cuts]


def _short(name: str, piece: int | None):
    """Counts of whole texts; a text that comes again in the task is not encoded again."""
    def run(batches):
        tokenizer = _open(name)
        seen: dict[bytes, int] = {}  # 128-bit digests: as many as the split has different texts
        for b in batches:
            text, marks, some, size = b.column(2), [], {}, 0
            for i in range(len(text)):
                t = text[i].as_py()
                mark = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                marks.append(mark)
                if mark not in seen and mark not in some:
                    some[mark] = t
                    size += len(t)
                if size > BATCH_CHARS or (some and i + 1 == len(text)):
                    seen.update(zip(some, token_totals(tokenizer, list(some.values()), piece)))
                    some, size = {}, 0
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([seen[m] for m in marks], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    return run


def chunk_marks(tokenizer, text: str, chunk: int, overlap: int, margin: int) -> tuple[int, dict[int, int], dict[int, int]]:
    """``(tokens, starts of the head overlap, starts of the tail overlap)`` of a chunk; the latter with the tokens before each.

    Only the overlaps are encoded with offsets, up to the next stable cut; what lies between them is counted.
    """
    high = chunk + overlap - margin
    first, tail = _STABLE.search(text, overlap), None
    if first and first.end() < chunk:
        for m in _STABLE.finditer(text, max(first.end(), chunk - PIECE), chunk):
            tail = m.start() + 1
    if tail is None:  # no stable cut to part them
        e = tokenizer.encode(text, add_special_tokens=False)
        return len(e), starts_in(e, 0, 0, overlap - margin), starts_in(e, 0, chunk, high)
    head = first.start() + 1
    e = tokenizer.encode(text[:head], add_special_tokens=False)
    f = tokenizer.encode(text[tail:], add_special_tokens=False)
    before = len(e) + token_totals(tokenizer, [text[head:tail]], PIECE)[0]
    return before + len(f), starts_in(e, 0, 0, overlap - margin), {p: before + t for p, t in starts_in(f, tail, chunk, high).items()}


def _cut(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)  # the last chunk is no shorter than an overlap
                for i in range(last + 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([i]), pa.array([i == last]), pa.array([i * chunk]), pa.array([text[i * chunk:(i + 1) * chunk + overlap]])],
                        ["row", "idx", "last", "start", "piece"])
    return run


MARK = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))


def _encode(name: str, chunk: int, overlap: int, margin: int):
    """Per chunk: its tokens, and the pre-token starts of the overlap with the next and with the previous chunk."""
    def run(batches):
        tokenizer = _open(name)
        for b in batches:
            n, right, left = [], [], []
            for start, last, text in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), b.column(4)):
                tokens, head, tail = chunk_marks(tokenizer, text.as_py(), chunk, overlap, margin)
                n.append(tokens)
                left.append([{"at": start + p, "before": t} for p, t in head.items()] if start else [])
                right.append([] if last else [{"at": start + p, "before": t} for p, t in tail.items()])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(left, MARK), pa.array(right, MARK)],
                                             ["row", "idx", "last", "n", "left", "right"])
    return run


def splice(long_texts: DataFrame, name: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(row, n_tokens)`` of long texts ``(row, text)``; see the module text."""
    margin = spliceable(name)[1]
    done, todo = [], long_texts
    while not todo.isEmpty():
        chunk = max(chunk, 4 * overlap)
        mark = "array<struct<at:long,before:long>>"
        parts = saved(todo.mapInArrow(_cut(chunk, overlap), "row long, idx long, last boolean, start long, piece string")
                      .repartition("row", "idx")
                      .mapInArrow(_encode(name, chunk, overlap, margin), f"row long, idx long, last boolean, n long, left {mark}, right {mark}"), "chunks")
        after = parts.select("row", (F.col("idx") - 1).alias("idx"), F.col("left").alias("next"))
        joint = F.array_min(F.array_intersect(F.col("right.at"), F.col("next.at")))
        before = lambda marks: F.element_at(F.map_from_entries(marks), F.col("joint"))
        part = (parts.join(after, ["row", "idx"], "left").withColumn("joint", joint)
                .select("row", "last", F.when(F.col("last"), F.col("n")).otherwise(before("right") - before("next")).alias("n")))
        sums = saved(part.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.bool_and(F.col("n").isNotNull()).alias("whole")), "spliced")
        done.append(sums.where("whole").select("row", "n_tokens"))
        todo = todo.join(sums.where("not whole").select("row"), "row", "left_semi")
        overlap *= 4
    out = done[0] if done else long_texts.select("row", F.lit(0).cast("long").alias("n_tokens"))
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    sound = spliceable(name)[0]
    if not sound:
        chunk = 1 << 62
    is_long = F.char_length("text") > min(chunk, 2**31 - 1)
    fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    short = sized.where(~is_long).mapInArrow(_short(name, PIECE if sound else None), fields)
    # long texts are written once with a row number of their own: later rounds read them again
    long_texts = saved(sized.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    counted = splice(long_texts.select("row", "text"), name, chunk, overlap)
    return short.unionByName(long_texts.select("row", "doc_id", "n_bytes").join(counted, "row").select("doc_id", "n_bytes", "n_tokens"))
