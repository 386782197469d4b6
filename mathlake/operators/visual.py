"""How alike a formula's raster and a candidate's preview look: both on one white canvas, compared pixel by pixel.

Rasters are grey: width, height and the pixels row by row, 0 to 255. Everything is array functions of the JVM. A raster
larger than the canvas is shrunk in its proportions, each new pixel the mean of those it covers; smaller ones stay as they
are; both stand in the middle. Where one side is missing, empty, or has a null or another number of pixels than its size
says, there is no score: null, never 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import growing
from ..functions.text import TASKS, clean_latex, let

#: The canvas, its background, and the decimals of a stored score.
CANVAS, WHITE, DECIMALS = (160, 80), 255, 4


def _whole(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def is_raster(r: Column) -> Column:
    """Whether a struct of width, height and pixels is a whole raster."""
    sized = (r["width"] > 0) & (r["height"] > 0) & (F.size(r["pixels"]) == r["width"] * r["height"])
    return F.coalesce(r.isNotNull() & sized & ~F.exists(r["pixels"], lambda p: p.isNull()), F.lit(False))


def fitted_size(width: Column, height: Column, canvas: tuple[int, int] = CANVAS) -> tuple[Column, Column]:
    """Width and height on the canvas: one side fills it, the other is the whole number nearest in proportion."""
    w, h = canvas
    shape = width / height

    def nearest(exact: Column, off) -> Column:
        low, high = F.floor(exact), F.ceil(exact)
        return F.greatest(F.when(off(high) < off(low), high).otherwise(low).cast("int"), F.lit(1))

    fits, tall = (width <= w) & (height <= h), F.lit(w / h) >= shape
    # A side of 0 is no raster: it counts as the worst of the two.
    by_height = nearest(h * shape, lambda n: F.abs(shape - n / F.lit(h)))
    by_width = nearest(w / shape, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.abs(shape - F.lit(w) / F.greatest(n, F.lit(1)))))
    return F.when(fits, width).when(tall, by_height).otherwise(w), F.when(fits, height).when(tall, h).otherwise(by_width)


def shrunk(r: Column, width: Column, height: Column) -> Column:
    """Rows of the raster at a smaller size: sums along each old row first, then over the rows that a new one covers."""
    cut = lambda k, n, m: _whole(k * n, m)

    def sums(row: Column) -> Column:
        part = lambda x: F.slice(row, cut(x, r["width"], width) + 1, cut(x + 1, r["width"], width) - cut(x, r["width"], width))
        return F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.aggregate(part(x), F.lit(0).cast("long"), lambda s, p: s + p))

    lines = F.transform(F.sequence(F.lit(0), r["height"] - 1), lambda y: sums(F.slice(r["pixels"], y * r["width"] + 1, r["width"])))

    def row(y: Column, lines: Column) -> Column:
        first, n = cut(y, r["height"], height), cut(y + 1, r["height"], height) - cut(y, r["height"], height)

        def mean(x: Column, part: Column) -> Column:
            count = n * (cut(x + 1, r["width"], width) - cut(x, r["width"], width))
            total = F.aggregate(part, F.lit(0).cast("long"), lambda s, line: s + F.get(line, x))
            return _whole(2 * total + count, 2 * count)

        return let(F.slice(lines, first + 1, n), lambda part: F.transform(F.sequence(F.lit(0), width - 1), lambda x: mean(x, part)))

    return let(lines, lambda ls: F.transform(F.sequence(F.lit(0), height - 1), lambda y: row(y, ls)))


def placed(raster: Column, canvas: tuple[int, int] = CANVAS) -> Column:
    """left, top, width, height, pixels of the raster in the middle of the canvas; null for what is no raster."""
    w, h = canvas

    def put(d: Column) -> Column:
        r, width, height = d["r"], d["w"], d["h"]
        small = (r["width"] == width) & (r["height"] == height)
        pixels = F.when(small, r["pixels"]).otherwise(F.flatten(shrunk(r, width, height)))
        return F.struct(_whole(w - width, F.lit(2)).alias("left"), _whole(h - height, F.lit(2)).alias("top"), width.alias("width"), height.alias("height"), pixels.alias("pixels"))

    def sized(r: Column) -> Column:
        width, height = fitted_size(r["width"], r["height"], canvas)
        return let(F.struct(r.alias("r"), width.alias("w"), height.alias("h")), put)

    whole = F.struct(raster["width"].cast("int").alias("width"), raster["height"].cast("int").alias("height"), raster["pixels"].cast("array<int>").alias("pixels"))
    return F.when(is_raster(raster), let(whole, sized))


def canvas_similarity(a: Column, b: Column, canvas: tuple[int, int] = CANVAS) -> Column:
    """The similarity of two placed rasters over the whole canvas; null unless both are there.

    Outside the box around both the canvas is white on either side, so only the box is drawn and compared.
    """
    edge = lambda r, at, size: r[at] + r[size]

    def draw(r: Column, box: Column) -> Column:
        blank = lambda n: F.array_repeat(F.lit(WHITE), n)
        left, right = r["left"] - box["left"], box["right"] - edge(r, "left", "width")
        line = lambda y: F.slice(r["pixels"], y * r["width"] + 1, r["width"])
        rows = F.flatten(F.transform(F.sequence(F.lit(0), r["height"] - 1), lambda y: F.concat(blank(left), line(y), blank(right))))
        wide = box["right"] - box["left"]
        return F.concat(blank(wide * (r["top"] - box["top"])), rows, blank(wide * (box["bottom"] - edge(r, "top", "height"))))

    def compare(d: Column) -> Column:
        x, y = d["a"], d["b"]
        box = F.struct(
            F.least(x["left"], y["left"]).alias("left"), F.least(x["top"], y["top"]).alias("top"),
            F.greatest(edge(x, "left", "width"), edge(y, "left", "width")).alias("right"), F.greatest(edge(x, "top", "height"), edge(y, "top", "height")).alias("bottom"),
        )
        differences = let(box, lambda at: F.zip_with(draw(x, at), draw(y, at), lambda p, q: F.abs(p - q)))
        total = F.aggregate(differences, F.lit(0).cast("long"), lambda s, v: s + v)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total / (255.0 * canvas[0] * canvas[1])))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), compare))


def similarity(a: Column, b: Column) -> Column:
    """One less the mean absolute difference of two equally long arrays of grey values; null unless both are such."""
    differences = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    total = F.aggregate(differences, F.lit(0).cast("long"), lambda s, d: s + d.cast("long"))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & total.isNotNull()
    return F.when(a.isNotNull() & b.isNotNull() & fits, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total / (255.0 * F.size(a)))))


def difference_histogram(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, value, n: how many pixels of two equally long arrays differ by each value; summed before it is shuffled."""
    rows = pairs.filter((F.size(a) == F.size(b)) & (F.size(a) > 0))
    values = rows.select(*keys, F.explode(F.zip_with(a, b, lambda x, y: F.abs(x - y))).alias("value"))
    return values.filter("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))


def raster() -> Column:
    """The raster that a row's columns width, height and pixels are."""
    return F.struct("width", "height", "pixels")


def score_candidates(candidates: DataFrame, rasters: DataFrame, previews: DataFrame, keys: list[str], canvas: tuple[int, int] = CANVAS) -> DataFrame:
    """candidates whose valid rows without a visual_score have it, where the formula's raster and the preview are there.

    rasters has one raster for each formula's keys, previews one for each latex_hash: what several candidates render is
    drawn once, and a formula's candidates of one text are compared once. Pairs are dealt out before: comparing costs far
    more than reading, and very many small rasters would be one task.
    """
    tasks = TASKS * candidates.sparkSession.sparkContext.defaultParallelism
    wanted = F.when((F.col("validation_status") == "valid") & F.col("visual_score").isNull(), F.col("latex_hash"))
    rows = candidates.withColumn("__hash", wanted)
    todo = rows.filter("__hash is not null").select(*keys, "__hash").repartition(tasks, *keys).distinct()
    left = rasters.select(*keys, placed(raster(), canvas).alias("__a")).repartition(tasks, *keys)
    right = previews.select(F.col("latex_hash").alias("__hash"), placed(raster(), canvas).alias("__b"))
    scored = todo.join(growing(left), keys).join(right, "__hash").select(*keys, "__hash", F.round(canvas_similarity(F.col("__a"), F.col("__b"), canvas), DECIMALS).alias("__score"))
    out = rows.join(growing(scored), [*keys, "__hash"], "left")
    return out.select(*(F.coalesce("visual_score", "__score").alias(c) if c == "visual_score" else c for c in candidates.columns))


def texts_to_draw(candidates: DataFrame) -> DataFrame:
    """latex_hash, latex of the valid candidates, each text once: what a renderer has to draw. Equal texts are cleaned once."""
    rows = clean_latex(candidates.filter("validation_status = 'valid'").select("latex_hash", "latex").distinct(), "latex", "clean")
    return rows.groupBy("latex_hash").agg(F.first("clean").alias("latex"))
