"""Calls of outside tools, and rasters, as rows: a call's outcome is data and never fails the job.

A tool is a function of one value; `command` makes one of a program. Several tools for one job are asked in order, row
by row, and the first that succeeds counts.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

#: Return codes of a program that is missing and of one that took too long.
MISSING, TIMED_OUT = 127, -1
Tool = Callable[[str], str]
RASTER = "width int, height int, pixels array<int>"
WHITE = 255


def call(argv: list[str], timeout: float | None = None) -> tuple[int, str, str, bool]:
    """returncode, stdout, stderr (bytes that are not UTF-8 replaced) and whether the time ran out."""
    text = lambda b: (b or b"").decode("utf-8", "replace")
    try:
        done = subprocess.run(argv, stdin=subprocess.DEVNULL, capture_output=True, timeout=timeout)
    except FileNotFoundError as e:
        return MISSING, "", str(e), False
    except subprocess.TimeoutExpired as e:
        return TIMED_OUT, text(e.stdout), text(e.stderr), True
    return done.returncode, text(done.stdout), text(done.stderr), False


def run_commands(work: DataFrame, keys: list[str], argv: str = "argv", timeout: float | None = None) -> DataFrame:
    """keys, returncode, stdout, stderr, timed_out of the program that each row names."""
    ship(work.sparkSession)
    kinds = dict(work.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [call([str(x) for x in a], timeout) for a in part[argv]]
            yield part[keys].assign(**{n: [f[i] for f in found] for i, n in enumerate(("returncode", "stdout", "stderr", "timed_out"))})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", returncode int, stdout string, stderr string, timed_out boolean"
    return work.select(*keys, argv).mapInPandas(run, schema)


def command(template: list[str], timeout: float | None = None) -> Tool:
    """A tool that runs a program with the value in place of {}; what it prints is the result."""

    def tool(value: str) -> str:
        code, out, err, _ = call([p.replace("{}", value) for p in template], timeout)
        if code:
            raise RuntimeError(f"{template[0]} failed ({code}): {(out + err)[-300:].strip()}")
        return out

    return tool


def convert(work: DataFrame, keys: list[str], column: str, tools: dict[str, Tool], have: str | None = None, force: bool = False) -> DataFrame:
    """keys, status, tool, result, error: the first tool that makes something of the column's value.

    status is skipped where the column `have` holds a result already and nothing forces a new one, missing for a null
    value, converted, or failed with the errors of all tools.
    """
    ship(work.sparkSession)
    kinds = dict(work.dtypes)

    def one(value: str | None, old: str | None) -> tuple[str, str | None, str | None, str | None]:
        if old is not None and not force:
            return "skipped", None, old, None
        if value is None:
            return "missing", None, None, None
        errors = []
        for name, tool in tools.items():
            try:
                return "converted", name, tool(value), None
            except Exception as e:  # noqa: BLE001  a row's failure is data
                errors.append(f"{name}: {e}")
        return "failed", None, None, "; ".join(errors)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(v, o) for v, o in zip(part["__value"], part["__have"], strict=True)]
            yield part[keys].assign(**{n: [f[i] for f in found] for i, n in enumerate(("status", "tool", "result", "error"))})

    rows = work.select(*keys, F.col(column).alias("__value"), (F.col(have) if have else F.lit(None).cast("string")).alias("__have"))
    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", status string, tool string, result string, error string")


def trimmed(pixels: np.ndarray, background: int = WHITE) -> np.ndarray:
    """Without the rows and columns at the edges that hold the background alone; an empty raster stays as it is."""
    rows, columns = np.flatnonzero((pixels != background).any(1)), np.flatnonzero((pixels != background).any(0))
    return pixels[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if len(rows) else pixels


def contrast(pixels: np.ndarray, factor: float = 2.0) -> np.ndarray:
    """Distances from the mean brightness times a factor."""
    mean = int(pixels.mean() + 0.5)
    return np.clip(mean + factor * (pixels.astype(float) - mean), 0, 255).astype(int)


#: Fixed value: pixels up to this brightness are ink (60 %).
INK = 153
VARIANTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "original": lambda p: p,
    "padded": lambda p: p,
    "trimmed_padded": trimmed,
    "grayscale_contrast": contrast,
    "binarized": lambda p: np.where(p > INK, 255, 0),
}


def fitted(pixels: np.ndarray, most: int) -> np.ndarray:
    """A raster no side of which is longer than `most`, by the nearest pixel."""
    scale = most / max(pixels.shape)
    if scale >= 1:
        return pixels
    h, w = (max(1, int(n * scale)) for n in pixels.shape)
    return pixels[(np.arange(h) * pixels.shape[0] // h)[:, None], np.arange(w) * pixels.shape[1] // w]


def raster_variants(rasters: DataFrame, keys: list[str], variants: list[str], padding: int = 24, most: int | None = None, background: int = WHITE) -> DataFrame:
    """keys, variant, width, height, pixels: grey rasters row by row; each variant but the original gets a border.

    An unknown variant, and one that a raster makes impossible, is the original.
    """
    ship(rasters.sparkSession)
    kinds = dict(rasters.dtypes)

    def make(pixels: np.ndarray, variant: str) -> np.ndarray:
        if variant != "original" and variant in VARIANTS and pixels.size:
            pixels = np.pad(VARIANTS[variant](pixels), padding, constant_values=background)
        return fitted(pixels, most) if most and pixels.size else pixels

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [make(np.asarray(p, int).reshape(h, w), v) for p, h, w in zip(part["pixels"], part["height"], part["width"], strict=True) for v in variants]
            out = part.loc[part.index.repeat(len(variants)), keys].reset_index(drop=True)
            yield out.assign(variant=variants * len(part), width=[m.shape[1] for m in made], height=[m.shape[0] for m in made], pixels=[m.ravel() for m in made])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", variant string, " + RASTER
    return rasters.select(*keys, "width", "height", "pixels").mapInPandas(run, schema)


def build(texts: DataFrame, forbidden: DataFrame, keys: list[str], column: str, to_tex: dict[str, Tool], have: str | None = None, force: bool = False) -> DataFrame:
    """keys, status, tool, result, error of texts made TeX; texts with forbidden references are refused, not converted."""
    held = forbidden.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = texts.join(held, keys, "left")
    done = convert(rows.filter("__n is null"), keys, column, to_tex, have, force)
    none: Column = F.lit(None).cast("string")
    why = F.concat(F.col("__n").cast("string"), F.lit(" forbidden references remain"))
    return done.unionByName(rows.filter("__n is not null").select(*keys, F.lit("refused").alias("status"), none.alias("tool"), none.alias("result"), why.alias("error")))
