"""Putting formulas back into text: matching by path, assignment, span checks, rewriting, and what remains wrong."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import growing, materialise, ship
from ..functions.paths import basename, has_extension, normalise
from ..functions.text import let, strip
from ..sources.markdown import images

FAR = 10**12


class MergeError(RuntimeError):
    """A strict merge that left issues: how many there are, and the first rows of them."""

    def __init__(self, n: int, rows: list):
        super().__init__(f"{n} merge issues, of which {len(rows)} are given")
        self.n, self.rows = n, rows

    @classmethod
    def check(cls, issues: DataFrame, shown: int = 100) -> None:
        if rows := issues.take(shown):
            raise cls(len(rows) if len(rows) < shown else issues.count(), rows)


def distance(image_start: Column, image_end: Column, start: Column, end: Column) -> Column:
    """How far a formula's recorded span lies from an image's; unknown positions are farthest."""
    return F.when(start.isNull(), F.lit(FAR)).otherwise(F.abs(start - image_start) + F.coalesce(F.abs(end - image_end), F.lit(0)))


def name_of(ref: Column) -> Column:
    """What an image and its formula have in common: the last segment of the path, or all of it where that is empty."""
    return F.when(basename(ref) != "", basename(ref)).otherwise(normalise(ref))


def named(formulas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, start, end, name: a row for each different name that a formula's paths have."""
    names = F.array_distinct(F.array(*(name_of(F.col(c)) for c in ("dest", "png_path") if c in formulas.columns)))
    return formulas.select(*keys, "id", "start", "end", F.explode(names).alias("name")).filter("name <> ''")


def match(parsed: DataFrame, formulas: DataFrame, keys: list[str]) -> DataFrame:
    """(image, formula) pairs of a document that name the same file: an equi-join, and never a pair twice.

    Every spelling of a path ends in the same name, so names decide; only formulas have more than one.
    """
    left = parsed.select(*keys, F.col("start").alias("image_start"), F.col("end").alias("image_end"), "dest", "original", name_of(F.col("dest")).alias("name"))
    return left.join(named(formulas, keys), [*keys, "name"]).drop("name")


def take_in_turn(images: list[tuple[int, int, str]], formulas: list[tuple[str, int | None, int | None, str]]) -> Iterator[tuple[int, str]]:
    """(image start, formula id) of one document: each image in its turn takes the free formula of its name with its own
    span, else the nearest one, ties by id. images are (start, end, name), formulas (id, start, end, name).
    """
    by_name: dict[str, list] = defaultdict(list)
    for f in sorted(formulas, key=lambda f: f[0]):
        by_name[f[3]].append(f)
    spans = {name: np.array([(FAR if s is None else s, -1 if e is None else e) for _, s, e, _ in rows], np.int64) for name, rows in by_name.items()}
    free = {name: np.ones(len(rows), bool) for name, rows in by_name.items()}
    where: dict[str, list[tuple[str, int]]] = defaultdict(list)
    exact: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    for name, rows in by_name.items():
        for k, (i, s, e, _) in enumerate(rows):
            where[i].append((name, k))
            if s is not None and e is not None:
                exact[name, s, e].append(k)
    for start, end, name in sorted(images):
        if name not in by_name or not free[name].any():
            continue
        k = next((k for k in exact.get((name, start, end), ()) if free[name][k]), None)
        if k is None:
            s, e = spans[name].T
            away = np.where(s == FAR, FAR, np.abs(s - start) + np.where(e < 0, 0, np.abs(e - end)))
            away[~free[name]] = np.iinfo(np.int64).max
            k = int(away.argmin())
        taken = by_name[name][k][0]
        for other, at in where[taken]:
            free[other][at] = False
        yield start, taken


def assign(parsed: DataFrame, formulas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, image_start, image_end, id: one formula an image, in document order. Its exact span first, else the nearest
    free one, ties by id.

    Where every image of a document finds its exact span, joins settle it, as no image can take another's formula; that is
    every text that was not edited. Only documents with another image are taken in turn, a row of spans each: images and
    formulas of one name are never paired with each other.
    """
    ship(parsed.sparkSession)
    names = named(formulas, keys)
    images_ = parsed.select(*keys, F.col("start").alias("image_start"), F.col("end").alias("image_end"), name_of(F.col("dest")).alias("name"))
    images_ = images_.join(growing(names.select(*keys, "name").distinct()), [*keys, "name"], "left_semi")
    spans = names.groupBy(*keys, "name", F.col("start").alias("image_start"), F.col("end").alias("image_end")).agg(F.min("id").alias("id"))
    found = images_.join(growing(spans), [*keys, "name", "image_start", "image_end"], "left")
    found = materialise(found.withColumn("__open", F.count_if(F.col("id").isNull()).over(Window.partitionBy(*keys)) > 0), "merge-exact", "__open")
    done = found.filter("not __open").select(*keys, "image_start", "image_end", "id")
    late = found.filter("__open")
    lists = late.groupBy(*keys).agg(F.collect_list(F.struct("image_start", "image_end", "name")).alias("__i"))
    theirs = names.join(late.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("id", "start", "end", "name")).alias("__f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, taken = [], [], []
            for i, r in enumerate(batch.select(["__i", "__f"]).to_pylist()):
                for s, f in take_in_turn([tuple(x.values()) for x in r["__i"]], [tuple(x.values()) for x in r["__f"]]):
                    row.append(i), start.append(s), taken.append(f)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(start, pa.int32()), pa.array(taken, pa.string())], [*keys, "image_start", "id"])

    kinds = dict(found.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "image_start int, id string"
    turns = lists.join(theirs, keys).select(*keys, "__i", "__f").mapInArrow(run, schema)
    turns = turns.join(late.select(*keys, "image_start", "image_end"), [*keys, "image_start"])
    return done.unionByName(turns.select(*keys, "image_start", "image_end", "id"))


#: Patterns that are searched in one pass over a text; a text with more is read once for each so many.
PATTERNS = 20_000


#: Texts up to this length are searched one by one: there are few of them, and an automaton would tell each of their very many places.
SHORT = 2


def first_places(text: str, wanted: set[str]) -> dict[str, int]:
    """The first place of each wanted text that is there.

    One automaton finds those of up to PATTERNS in one pass; it stops when each was seen.
    """
    alone = {t for t in wanted if len(t) <= SHORT or len(wanted) <= 4}
    first = {t: k for t in alone if (k := text.find(t)) >= 0}
    rest = iter(wanted - alone)
    while part := list(islice(rest, PATTERNS)):
        automaton = ahocorasick.Automaton()
        for t in part:
            automaton.add_word(t, t)
        automaton.make_automaton()
        missing = len(part)
        for end, t in automaton.iter(text):
            if t not in first:
                first[t] = end - len(t) + 1
                missing -= 1
                if not missing:
                    break
    return first


def locate(docs: DataFrame, wanted: DataFrame, keys: list[str], column: str = "markdown") -> DataFrame:
    """keys, id, start, end, length, same, first of wanted (keys, id, start, end, original_match): whether its text stands at
    its span, and where it stands first. A text meets its formulas as one row, never one copy a formula.
    """
    numbered = wanted.select(*keys, F.struct("id", "start", "end", F.col("original_match").alias("original")).alias("w"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    part = F.pmod(F.xxhash64("w"), F.ceil(F.col("n") / PATTERNS))
    lists = numbered.groupBy(*keys, part.alias("part")).agg(F.collect_list("w").alias("__w"))
    return locate_listed(lists.join(docs.select(*keys, F.col(column).alias("__t")), keys), keys, "__w", "__t")


def locate_listed(rows: DataFrame, keys: list[str], listed: str, column: str = "markdown") -> DataFrame:
    """What locate() returns, for rows whose formulas are already a list of (id, start, end, original) beside their text.

    Each row is looked at where it lies: nothing is dealt out, sorted or joined, and formulas return as rows, not as lists.
    """
    ship(rows.sparkSession)
    rows = rows.select(*keys, listed, column)
    kinds = dict(rows.dtypes) | dict(rows.select(F.inline(listed)).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = batch.column(len(keys)), batch.column(len(keys) + 1).fill_null("")
            counts = pc.list_value_length(lists).fill_null(0).to_numpy()
            row = np.repeat(np.arange(len(batch)), counts)
            ids, start, end, original = (lists.flatten().field(c) for c in ("id", "start", "end", "original"))
            length = pc.utf8_length(original)
            s, e, n = (c.fill_null(-1).to_numpy() for c in (start, end, length))
            fits = ((0 <= s) & (s <= e) & (n >= 0) & (np.minimum(e, pc.utf8_length(texts).to_numpy()[row]) - s == n)).tolist()
            s, wanted = s.tolist(), original.to_numpy(zero_copy_only=False).tolist()
            same, first, at = [], [], 0
            for text, to in zip(texts.to_pylist(), np.cumsum(counts).tolist(), strict=True):
                mine = wanted[at:to]
                first += map(first_places(text, {t for t in mine if t}).get, mine)
                same += [ok and text.startswith(t, k) for ok, t, k in zip(fits[at:to], mine, s[at:to], strict=True)]
                at = to
            told = [ids, start, end, length, pa.array(same, pa.bool_()), pa.array(first, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in range(len(keys))), *told], [*keys, "id", "start", "end", "length", "same", "first"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in [*keys, "id", "start", "end"]) + "length int, same boolean, first int"
    return rows.mapInArrow(run, schema)


def fall_back(docs: DataFrame, formulas: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Formulas without an image: their recorded span where the text there is still the same, else the first place of it."""
    left = formulas.join(growing(assigned.select(*keys, "id")), [*keys, "id"], "left_anti")
    found = locate(docs, left, keys)
    start = F.when(F.col("same"), F.col("start")).otherwise(F.col("first"))
    end = F.when(F.col("same"), F.col("end")).otherwise(F.col("first") + F.col("length"))
    return found.select(*keys, "id", start.alias("start"), end.alias("end")).filter("start is not null")


def neighbours(spans: DataFrame, keys: list[str], against: str = "neighbour") -> DataFrame:
    """spans with the earlier span that each is held against, in the order (start, end, id): the one before it, or, against
    "farthest", the one of all before it that ends last.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end", "id")
    one = F.struct("id", "start", "end")
    before = F.lag(one).over(order)
    if against == "farthest":
        before = F.max_by(one, F.struct("end", "start", "id")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.select(*keys, "id", "start", "end", before.alias("prev"))


def span_problems(spans: DataFrame, keys: list[str], against: str = "neighbour") -> DataFrame:
    """Impossible spans, and spans that overlap the one before them by (start, end).

    Against "farthest", each is held against the one that reaches farthest, so a span within a long one is told as well
    when another stands between them.
    """
    rows = neighbours(spans, keys, against)
    impossible = rows.filter("start < 0 or end < start").select(*keys, F.lit("invalid replacement range").alias("reason"), F.array("id").alias("formula_ids"), F.array(F.array("start", "end")).alias("ranges"))
    overlaps = rows.filter("start < prev.end").select(*keys, F.lit("overlapping replacements").alias("reason"), F.array("prev.id", "id").alias("formula_ids"), F.array(F.array("prev.start", "prev.end"), F.array("start", "end")).alias("ranges"))
    return impossible.unionByName(overlaps)


#: Characters of the pieces that a text is cut into once, so that a span is cut from a piece and not from the whole text.
PIECE = 4096


def rewrite(docs: DataFrame, replacements: DataFrame, keys: list[str], column: str = "markdown", out: str = "merged") -> DataFrame:
    """docs with every span replaced; spans must not overlap. One row a document comes together, never its neighbours.

    The gaps between spans are cut from pieces of bounded size and joined once with the new texts: linear in the spans.
    Spans are looked up by their document, so no text is sorted.
    """
    spans = replacements.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("__s"))
    rows = docs.join(spans.hint("shuffle_hash"), keys, "left")
    piece = lambda n: F.floor(n / PIECE).cast("int")

    def text(cut_up: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            part = lambda k: F.substring(F.get(cut_up, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
            return F.when(b > a, F.array_join(F.transform(F.sequence(piece(a), piece(b - 1)), part), "")).otherwise("")

        before = lambda i: F.when(i == 0, 0).otherwise(F.get("__s", i - 1)["end"])
        segments = F.transform("__s", lambda x, i: F.concat(between(before(i), x["start"]), F.coalesce(x["text"], F.lit(""))))
        return F.concat(F.array_join(segments, ""), between(F.element_at("__s", -1)["end"], F.length(column)))

    pieces = F.transform(F.sequence(F.lit(0), piece(F.length(column))), lambda k: F.substring(F.col(column), k * PIECE + 1, F.lit(PIECE)))
    return rows.withColumn(out, F.when(F.col("__s").isNull(), F.col(column)).otherwise(let(pieces, text))).drop("__s")


def forbidden_refs(texts: DataFrame, formulas: DataFrame, extensions: list[str], keys: list[str], column: str = "merged") -> DataFrame:
    """Formula images that are still in a text, with the formulas they belong to, and selected formulas whose link remains."""
    parsed = images(texts.select(*keys, F.col(column).alias("markdown"))).filter(has_extension(normalise(F.col("dest")), extensions))
    held = match(parsed, formulas, keys).groupBy(*keys, "image_start", "dest", "original").agg(F.array_sort(F.collect_set("id")).alias("formula_ids"))
    held = held.select(*keys, F.lit("forbidden reference").alias("reason"), "dest", "original", "formula_ids")
    done = formulas.filter((strip(F.coalesce("selected_latex", F.lit(""))) != "") & (F.coalesce("original_match", F.lit("")) != ""))
    here = locate(texts, done, keys, column).filter("first is not null").select(*keys, "id")
    remains = done.join(here, [*keys, "id"], "left_semi")
    return held.unionByName(remains.select(*keys, F.lit("selected formula original_match remains").alias("reason"), "dest", F.col("original_match").alias("original"), F.array("id").alias("formula_ids")))


def merge(docs: DataFrame, formulas: DataFrame, text_of: Column, extensions: list[str], keys: list[str], strict: bool = True, parsed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged texts and the issues left. text_of is the replacement of a formula row. Strict raises on any issue.
    Each step is written once to the shared folder, as several later ones read it. parsed has the texts' images where they
    were parsed before.

    Spans that overlap are not applied: their ids become issues.
    """
    formulas = materialise(formulas.withColumn("__text", text_of), "merge-formulas")
    taken = materialise(assign(images(docs.select(*keys, "markdown")) if parsed is None else parsed, formulas, keys), "merge-taken")
    spans = taken.select(*keys, "id", F.col("image_start").alias("start"), F.col("image_end").alias("end"))
    spans = materialise(spans.unionByName(fall_back(docs, formulas, taken, keys)), "merge-spans")
    problems = span_problems(spans, keys)
    bad = problems.select(*keys, F.explode("formula_ids").alias("id")).distinct()
    texts = formulas.select(*keys, "id", F.col("__text").alias("text"))
    applied = spans.join(bad, [*keys, "id"], "left_anti").join(growing(texts), [*keys, "id"])
    merged = materialise(rewrite(docs, applied, keys), "merged")
    none = F.lit(None).cast("string")
    missing = formulas.join(growing(spans.select(*keys, "id")), [*keys, "id"], "left_anti").select(*keys, F.lit("formula image match not found during merge").alias("reason"), none.alias("dest"), none.alias("original"), F.array("id").alias("formula_ids"))
    issues = problems.select(*keys, "reason", none.alias("dest"), none.alias("original"), "formula_ids").unionByName(forbidden_refs(merged, formulas, extensions, keys)).unionByName(missing)
    if strict:
        MergeError.check(issues)
    return merged, issues


def assert_no_forbidden(texts: DataFrame, formulas: DataFrame, extensions: list[str], keys: list[str], column: str = "merged") -> None:
    MergeError.check(forbidden_refs(texts, formulas, extensions, keys, column))
