"""Line-first cleaning.

Each line with a word is judged on its own: navigation (separators between short items), symbols, shouting, one word over
and over, boilerplate, short fragments that end without punctuation, and copies of an earlier line. Failing lines
are removed; a document that loses more than a share of its words is rejected, as is one that fails the base rules (too few
words, or too many words in repeated three-word windows).

Boilerplate is learned from the whole corpus, whatever its languages: a line, of any length, that stands between at least
LEAST different pairs of neighbouring lines, and between a pair of its own in at least a share SHARE of the different texts
that hold it. Neither bound depends on the size of the corpus. Exact copies of a document teach nothing; near copies mostly
repeat the neighbours too, but not beside a line that differs in each of them. A text most of whose words are in such lines
is a copy itself, not boilerplate, and keeps them. Up to SENT such lines are sent to the tasks; more are joined to the
texts that hold them, with the same results. Common phrases that are known from the start are a parameter.

Defined cases: null text has no words, is its own cleaned text and is rejected as too short; a text of any length is
judged whole; repeated rows are judged each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, tidied

MIN_WORDS, MAX_REPEAT = 50, 50
MAX_LOST = 0.4
#: The pairs of neighbours that boilerplate needs: a number, and a share of the different texts with the line.
LEAST, SHARE = 20, 0.2
#: Hashes of boilerplate lines that are broadcast at most (8 MB).
SENT = 1 << 20
NONE = np.empty(0, np.int64)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SEPARATORS = {b"|", b">", b"\xc2\xbb", b"\xc2\xb7", b"\xe2\x80\xa2", b"/"}
ENDS = tuple(x.encode() for x in ".!?;:\"')]}…。！？”’»")
BOILERPLATE = re.compile(rb"(?i)\b(?:enable (?:javascript|cookies)|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|lorem ipsum|click here|sign in|log in)\b")


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand in the text twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    _, pairs = np.unique(codes[:-1] * len(seen) + codes[1:], return_inverse=True)
    keys = pairs[:-1] * len(seen) + codes[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def fails(line: bytes, words: list[bytes], phrases: re.Pattern = BOILERPLATE) -> str | None:
    """The rule that a line with words fails, or None."""
    n = len(words)
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and separators * 5 >= n:
        return "navigation"
    if sum(line.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"|")) * 2 > n:
        return "symbols"
    if n >= 3 and line.count(b"!!") * 2 >= n:
        return "shouting"
    if n >= 10 and len(set(words)) * 3 < n:
        return "repetition"
    if n < 40 and phrases.search(line):
        return "boilerplate"
    if n < 4 and not words[-1].endswith(ENDS):
        return "punctuation"
    return None


def line_hash(words: list[bytes]) -> int:
    """A signed 64-bit hash of a line's words, lower-cased."""
    h = xxhash.xxh64_intdigest(b" ".join(words).lower())
    return h - (1 << 64) if h >> 63 else h


def of_text(data: bytes) -> int:
    """A text's hash, the one that Spark's xxhash64 gives."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def common_lines(docs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """line: the hash of each line that the whole corpus shows to be boilerplate."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column(0).cast(pa.binary()):
                data = text.as_py() or b""
                lines, own = [w for x in data.split(b"\n") if (w := x.split())], of_text(data)
                hashes = [0, *map(line_hash, lines), 0]
                seen.update((hashes[k], hash((hashes[k - 1], hashes[k + 1])), own) for k in range(1, len(lines) + 1))
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in seen], pa.int64()) for i in range(3)], ["line", "between", "own"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    # Dealt by all three, so that a line of very many texts is counted by many tasks; then sums with a partial phase.
    places = texts.mapInArrow(tidied(run), "line long, between long, own long").distinct()
    pairs = places.groupBy("line", "between").agg(F.count("*").alias("texts"))
    lines = pairs.groupBy("line").agg(F.count("*").alias("pairs"), F.sum("texts").alias("texts"))
    return lines.filter((F.col("pairs") >= least) & (F.col("pairs") >= share * F.col("texts"))).select("line")


def held_lines(docs: DataFrame, common: DataFrame) -> DataFrame:
    """own, lines: of each different text that holds boilerplate, its hash and the boilerplate lines it holds."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column(0).cast(pa.binary()):
                data = text.as_py() or b""
                own = of_text(data)
                seen.update((line_hash(w), own) for x in data.split(b"\n") if (w := x.split()))
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in seen], pa.int64()) for i in range(2)], ["line", "own"])

    places = docs.select("text").mapInArrow(tidied(run), "line long, own long")
    return places.join(common, "line").groupBy("own").agg(F.collect_set("line").alias("lines"))


def judge(data: bytes, max_lost: float = MAX_LOST, common: np.ndarray = NONE, phrases: re.Pattern = BOILERPLATE) -> tuple[list[int], bool, bool, bytes]:
    """The counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed, kept, and the cleaned text.

    common holds hashes of boilerplate lines, sorted.
    """
    text, words = data.decode("utf-8", "replace"), data.split()
    repeats, lost, dups, seen, left = repeat_words(words), 0, 0, set(), []
    lines = [(line, line.split()) for line in data.split(b"\n")]
    known = [False] * len(lines)
    if len(common):
        hashes = np.array([line_hash(w) if w else 0 for _, w in lines], np.int64)
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        known = ((common[at] == hashes) & np.array([bool(w) for _, w in lines])).tolist()
        if 2 * sum(len(w) for (_, w), k in zip(lines, known, strict=True) if k) > len(words):
            known = [False] * len(lines)
    for (line, inside), boilerplate in zip(lines, known, strict=True):
        if not inside:
            left.append(line)
            continue
        copy = line in seen
        seen.add(line)
        dups += copy
        if copy or boilerplate or fails(line, inside, phrases):
            lost += len(inside)
        else:
            left.append(line)
    n = len(words)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
    counts = [n, len(text) - sum(text.count(c) for c in BLANKS), sum(text.count(c) for c in SYMBOLS), dups, repeats]
    return counts, base, not base and lost <= max_lost * n, b"\n".join(left)


def clean(docs: DataFrame, max_lost: float = MAX_LOST, keep_text: bool = True, least: int = LEAST, share: float = SHARE, phrases: re.Pattern = BOILERPLATE, sent: int = SENT) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept, and with keep_text its text without failing lines."""
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    learned = materialise(common_lines(docs, least, share), "quality-lines")
    few = np.sort(learned.limit(sent + 1).toArrow().column(0).to_numpy())
    joined = len(few) > sent
    common = docs.sparkSession.sparkContext.broadcast(NONE if joined else few)
    if joined:
        held = held_lines(rows, learned)
        rows = rows.withColumn("own", F.xxhash64(F.coalesce("text", F.lit("")))).join(held, "own", "left").select("doc_id", "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = (np.sort(np.array(x.as_py() or [], np.int64)) for x in batch.column(2)) if joined else repeat(common.value)
            found = [judge(t.as_py() or b"", max_lost, k, phrases) for t, k in zip(batch.column(1).cast(pa.binary()), known, strict=False)]
            columns = [batch.column(0), *(pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(names)))]
            columns += [pa.array([f[k] for f in found], pa.bool_()) for k in (1, 2)]
            if keep_text:
                columns.append(pa.array([f[3].decode("utf-8", "replace") for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept", *["text"] * keep_text])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean" + ", text string" * keep_text
    return rows.mapInArrow(tidied(run), schema)
