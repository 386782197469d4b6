"""Image links of Markdown text as rows, nested brackets and escapes included, with DataFrame functions only.

A text is cut into bracket tokens once. Running sums over them give each bracket's depth, so the bracket that closes it is
the next one of its level: a `lead` in the window of that level. All openers before one "](" share its fate; of links that
overlap, the earlier one that closes stays. Every window is dealt by the document's keys alone, so tokens are shuffled
once, and a text of any length costs a sort of its tokens; texts without "![" have none.

Defined cases: null and empty texts have no images; keys may be null, but no two rows of docs may share them; brackets
that are never closed belong to no link; all columns of docs but the text come along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, strip

#: Blanks but the newline, as attributes may follow a link behind them.
_BLANK = r"[\t\x0b\x0c\r\x1c-\x1f\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Escaped characters, openers, ends of alternative texts with what they open, closers with the attributes they start.
#: The look-ahead passes most characters by in one test.
TOKEN = rf"(?=[\\!\]>(){{}}])(?:\\!\[|\\[\s\S]|!\[|\](?:\(<?)?|>?\)(?:{_BLANK}*+\{{)?|[({{}}])"
#: Characters of the pieces that a text is cut into once, so that an image is cut from a piece and not from the whole text.
PIECE = 4096


def tokens(docs: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, k, m, pos, end of every bracket token; p and b are its steps of round and curly depth, 0 for none."""
    text, m = F.col(column), F.col("t.m")
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("m"), F.transform(F.split(text, TOKEN, -1), F.length).alias("g"))
    rows = docs.filter(F.contains(text, F.lit("!["))).select(*keys, F.posexplode(pairs).alias("k", "t")).filter(m.isNotNull())
    rows = rows.select(*keys, "k", m.alias("m"), F.sum(F.col("t.g") + F.length(m)).over(_upto(keys)).cast("int").alias("end"))
    m = F.col("m")
    round_ = F.when((m == "(") | m.startswith("]("), 1).when(m.startswith(")") | m.startswith(">"), -1).otherwise(0)
    curly = F.when(m.endswith("{"), 1).when(m.endswith("}"), -1).otherwise(0)
    return rows.withColumn("pos", F.col("end") - F.length("m")).withColumn("p", round_).withColumn("b", curly)


def _upto(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _closes(rows: DataFrame, keys: list[str], step: str, value: Column) -> Column:
    """value of the bracket that closes each opening one; the two are neighbours within their level."""
    level = F.col(f"{step}_depth") + F.when(F.col(step) == -1, 1).otherwise(0)
    after = F.lead(value).over(Window.partitionBy(*keys, F.when(F.col(step) != 0, level)).orderBy("k"))
    return F.when(F.col(step) == 1, after)


def links(docs: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and, for each "](" that closes: at, openers (ascending), to (the destination's end), end, attrs (where they start)."""
    m = F.col("m")
    rows = tokens(docs, keys, column)
    before = lambda c: F.sum(c.cast("int")).over(_upto(keys)) - c.cast("int")
    sums = {"p_depth": F.sum("p").over(_upto(keys)), "b_depth": F.sum("b").over(_upto(keys)), "alts": before(m.startswith("]")), "angles": before(m.startswith(">"))}
    # Other escaped characters only had to be stepped over.
    rows = rows.withColumns(sums).filter("p <> 0 or b <> 0 or m = ']' or endswith(m, '![')")
    rows = rows.withColumn("curly_end", _closes(rows, keys, "b", F.col("end")))
    has = F.col("curly_end").isNotNull()
    bracket = F.col("pos") + F.when(m.startswith(">"), 1).otherwise(0)
    closer = F.struct(F.col("pos").alias("to"), F.when(has, F.col("curly_end")).otherwise(bracket + 1).alias("end"), F.when(has, F.col("end") - 1).alias("attrs"), bracket.alias("bracket"))
    rows = rows.withColumn("closer", closer)
    angle = F.max(F.when(m.startswith(">"), F.col("closer"))).over(Window.partitionBy(*keys, "angles"))
    rows = rows.withColumns({"round": _closes(rows, keys, "p", F.col("closer")), "angle": angle})
    target = F.when(m == "](", F.struct(F.col("round.bracket").alias("to"), "round.end", "round.attrs")).when(m == "](<", F.struct("angle.to", "angle.end", "angle.attrs"))
    opener, alt = m.endswith("!["), m.startswith("](")
    ends = rows.filter(opener | alt).groupBy(*keys, "alts").agg(
        F.array_sort(F.collect_list(F.when(opener, F.col("end") - 2))).alias("openers"),
        F.max(F.when(alt, F.col("pos"))).alias("at"), F.max(F.when(alt, F.col("end"))).alias("since"), F.max(F.when(alt, target)).alias("target"),
    )
    return ends.filter((F.size("openers") > 0) & F.col("target.end").isNotNull()).select(*keys, "openers", "at", "since", "target.*")


def spans(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the document's images that stay, in order: (start, at, since, to, end, attrs).

    Only links that reach into one another are looked at in turn: each starts at its first opener that no earlier image
    has taken, or is none.
    """
    order = Window.partitionBy(*keys).orderBy("at")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("apart", F.coalesce(F.get("openers", 0) >= reach, F.lit(True)).cast("int")).withColumn("cluster", F.sum("apart").over(order))
    one = ["at", "since", "to", "end", "attrs"]
    image = "array<struct<start:int,at:int,since:int,to:int,end:int,attrs:int>>"

    def step(s: Column, x: Column) -> Column:
        start = F.get(F.filter(x["openers"], lambda o: o >= s["done"]), 0)
        new = F.struct(start.alias("start"), *(x[c].alias(c) for c in one))
        return F.when(start.isNull(), s).otherwise(F.struct(x["end"].alias("done"), F.concat(s["out"], F.array(new)).alias("out")))

    begin = F.struct(F.lit(0).alias("done"), F.array().cast(image).alias("out"))
    tied = rows.groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(F.struct("at", "openers", *one[1:]))).alias("all"))
    kept = tied.select(*keys, "cluster", F.aggregate("all", begin, step, lambda s: s["out"]).alias("kept"))
    return kept.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "kept"))), lambda x: x["kept"])).alias("images"))


def images_balanced(docs: DataFrame, keys: list[str], column: str = "markdown") -> DataFrame:
    """One row an image: the other columns of docs, then alt, dest, attrs, original, start, end, as `markdown.images` gives them."""
    named = [f"__key{i}" for i in range(len(keys))]
    bare = docs.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(column).alias("__text"))
    held = spans(links(bare, named, "__text"), named)
    rows = docs.join(held, reduce(lambda a, b: a & b, (docs[k].eqNullSafe(held[n]) for k, n in zip(keys, named, strict=True))))
    piece = lambda n: F.floor(n / PIECE).cast("int")
    cut_up = let(docs[column], lambda t: F.transform(F.sequence(F.lit(0), piece(F.length(t))), lambda k: F.substring(t, k * PIECE + 1, F.lit(PIECE))))

    def parts(pieces: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            low = lambda k: F.greatest(a - k * PIECE, F.lit(0))
            part = lambda k: F.substring(F.get(pieces, k), low(k) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - low(k))
            return F.when(b > a, F.array_join(F.transform(F.sequence(piece(a), piece(b - 1)), part), "")).otherwise("")

        attrs = lambda i: F.when(i["attrs"].isNull(), "").otherwise(cut(i["attrs"], i["end"]))
        return F.transform("images", lambda i: F.struct(cut(i["start"] + 2, i["at"]).alias("alt"), cut(i["since"], i["to"]).alias("dest"), attrs(i).alias("attrs"), cut(i["start"], i["end"]).alias("original"), i["start"].alias("start"), i["end"].alias("end")))

    found = rows.select(*(docs[c] for c in docs.columns if c != column), F.explode(let(cut_up, parts)).alias("__image"))
    return found.select(*(c for c in docs.columns if c != column), "__image.alt", strip(F.col("__image.dest")).alias("dest"), "__image.attrs", "__image.original", "__image.start", "__image.end")
