"""Image links of Markdown text as rows.

Balanced parentheses are not regular, so a pandas-free Arrow pass parses whole texts; `brackets.images_balanced` gives the
same rows with DataFrame functions, and `images_native` is a column for texts without nesting, escapes and angle brackets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

IMAGE = "struct<alt:string,dest:string,attrs:string,original:string,start:int,end:int>"
_OPEN = re.compile(r"!\[")
_ALT = re.compile(r"((?:[^\]\\]|\\.)*)\]\(", re.S)
_ANGLE = re.compile(r"<((?:\\.|(?!>\))[^\\])*)>\)", re.S)
_PAREN = re.compile(r"\\.|[()]", re.S)
_ATTRS = re.compile(r"[^\S\n]*\{")
_BRACE = re.compile(r"[{}]")


def _balanced(tokens: re.Pattern, text: str, at: int, opens: str, shuts: str) -> int | None:
    """The position of the token that closes what was open at `at`."""
    depth = 0
    for m in tokens.finditer(text, at):
        if m[0] == opens:
            depth += 1
        elif m[0] == shuts:
            if not depth:
                return m.start()
            depth -= 1
    return None


def parse(text: str) -> Iterator[tuple[str, str, str, str, int, int]]:
    """alt, dest, attrs, original, start, end of every image link; positions are code points, the span covers attributes."""
    at = 0
    while m := _OPEN.search(text, at):
        at = m.start() + 1
        alt = _ALT.match(text, m.end())
        if not alt or len(text) - m.start() <= 3:
            continue
        if text.startswith("<", alt.end()):
            angle = _ANGLE.match(text, alt.end())
            if not angle:
                continue
            dest, end = angle[1], angle.end()
        else:
            close = _balanced(_PAREN, text, alt.end(), "(", ")")
            if close is None:
                continue
            dest, end = text[alt.end() : close], close + 1
        attrs = ""
        if opened := _ATTRS.match(text, end):
            close = _balanced(_BRACE, text, opened.end(), "{", "}")
            if close is not None:
                attrs, end = text[opened.end() - 1 : close + 1], close + 1
        yield alt[1], dest.strip(), attrs, text[m.start() : end], m.start(), end
        at = end


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether only blanks stand before and after a span on its line."""
    after = text.find("\n", end)
    return not text[text.rfind("\n", 0, start) + 1 : start].strip() and not text[end : after if after >= 0 else len(text)].strip()


def images(docs: DataFrame, column: str = "markdown", alone: bool = False) -> DataFrame:
    """One row an image: the other columns of docs, then alt, dest, attrs, original, start, end; if asked, whether it is
    alone on its line.

    Texts with "![" alone reach Python; all others end where they are read.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != column]
    names = ["alt", "dest", "attrs", "original", "start", "end", *["alone"] * alone]
    types = [*[pa.string()] * 4, *[pa.int32()] * 2, *[pa.bool_()] * alone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                for image in parse(text):
                    row.append(i), found.append((*image, stands_alone(text, *image[4:])) if alone else image)
            at = pa.array(row, pa.int64())
            new = [pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).take(at) for k in range(len(keep))), *new], [*keep, *names])

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "alt string, dest string, attrs string, original string, start int, end int" + ", alone boolean" * alone
    return docs.filter(F.contains(column, F.lit("!["))).select(column, *keep).mapInArrow(run, schema)


def images_native(text: Column) -> Column:
    """ARRAY of IMAGE structs for texts without nested parentheses, backslashes and angle brackets; stays in the JVM."""
    pattern = r"!\[[^\]]*\]\([^()]*\)(?:[^\S\n]*\{[^{}]*\})?"
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        part = lambda p: F.regexp_extract(x["m"], p, 1)
        one = F.struct(part(r"\A!\[([^\]]*)\]").alias("alt"), F.trim(part(r"\]\(([^()]*)\)")).alias("dest"), part(r"\)[^\S\n]*(\{[^{}]*\})\z").alias("attrs"), x["m"].alias("original"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{IMAGE}>").alias("out"))
    return F.aggregate(pairs, begin, step, lambda s: s["out"])
