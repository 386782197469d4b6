"""Formulas out of documents: image links with ids and display types, TeX fragments, and their positional zip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import has_extension
from ..functions.text import clean_latex
from ..sources.markdown import images

#: Patterns of TeX fragments in order, and the raster sizes that mean display.
FRAGMENTS = [
    r"(?s)\\\[(.*?)\\\]",
    r"(?s)\$\$(.*?)\$\$",
    r"(?s)\\begin\{(?:equation\*?|align\*?|gather\*?|multline\*?)\}(.*?)\\end\{(?:equation\*?|align\*?|gather\*?|multline\*?)\}",
    r"(?s)\\\((.*?)\\\)",
    r"(?s)(?<!\\)\$(?!\$)(.*?)(?<!\\)\$",
]
TALL, WIDE, MIN_WIDTH = 80, 8, 360


def display_guess(alone: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """display for a formula alone on its line, or one with a tall or very wide raster."""
    large = F.lit(False)
    if width is not None:
        large = F.coalesce((height >= TALL) | ((height > 0) & (width / height >= WIDE) & (width >= MIN_WIDTH)), F.lit(False))
    return F.when(alone | large, "display").otherwise("inline")


def formulas_of(docs: DataFrame, extensions: list[str], keys: list[str] | None = None, sizes: DataFrame | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """One row a formula image: keys, seq, id, dest, alt, original_match, position, display_type_auto, png_path.

    docs holds the keys and markdown. Ids number formula images only, in document order; no text leaves the task
    that parses it. parsed has the texts' images (with alone) where they were parsed before.
    """
    keys = keys or ["doc_id"]
    found = images(docs.select(*keys, "markdown"), alone=True) if parsed is None else parsed
    rows = found.filter(has_extension(F.col("dest"), extensions))
    if sizes is not None:
        rows = rows.join(sizes.select(*keys, "dest", "width", "height"), [*keys, "dest"], "left")
    guess = display_guess(F.col("alone"), *((F.col("width"), F.col("height")) if sizes is not None else ()))
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    rows = rows.withColumn("seq", seq).withColumn("id", F.format_string("f%04d", F.col("seq")))
    return rows.select(*keys, "seq", "id", "alt", "dest", F.col("original").alias("original_match"), "start", "end", guess.alias("display_type_auto"), F.concat(F.lit("formulas/png/"), "id", F.lit(".png")).alias("png_path"))


def fragments(tex: DataFrame, keys: list[str], column: str = "tex") -> DataFrame:
    """Math fragments: keys, pos (from 1 over all), pattern_no, match_no, latex; pattern by pattern, as found, cleaned, none empty."""
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all(F.col(column), F.lit(p), F.lit(1)), _numbered(n)) for n, p in enumerate(FRAGMENTS, 1))))
    rows = tex.select(*keys, F.explode(found).alias("f")).select(*keys, "f.pattern_no", "f.match_no", "f.raw")
    rows = clean_latex(rows, "raw", "latex").filter("latex <> ''")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pattern_no", "match_no"))
    return rows.select(*keys, place.alias("pos"), "pattern_no", "match_no", "latex")


def _numbered(pattern_no: int):
    return lambda x, i: F.struct(F.lit(pattern_no).alias("pattern_no"), (i + 1).alias("match_no"), x.alias("raw"))


def zip_fragments(formulas: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th fragment belongs to the n-th formula; the shorter side wins."""
    return formulas.join(found.withColumnRenamed("pos", "seq"), [*keys, "seq"]).withColumn("source", F.lit("docx2tex"))
