"""Reading LaTeX out of command output and errors out of TeX logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_END, strip

#: Words of progress and footer lines, and the shapes of a formula line.
NOISE = ["progress", "download", "loaded", "loading", "elapsed", "it/s", "%|", "warning", "error:", "footer", "done", "saved"]
PERCENT = r"(?U)\A[\[\]=>#.*\-\s]*\d+%"
MATHY = r"\\[A-Za-z]+|[_^{}=+\-*/<>]|\p{Nd}"
FENCED = r"(?isU)```(?:latex|tex|math)?\s*(.*?)\s*```"
LABELLED = r"(?iU)(?:predicted\s+latex|latex|formula|result)\s*[:：]\s*(.+)\z"


def plausible(line: Column) -> Column:
    """Whether a line may be a formula."""
    s = strip(line)
    low = F.lower(s)
    noisy = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in NOISE))
    return (s != "") & ~noisy & ~s.rlike(PERCENT) & s.rlike(MATHY)


def latex_of_output(stdout: Column) -> Column:
    """A fenced block; else the first labelled line that may be a formula; else the last line that may be one; else empty."""
    text = strip(F.coalesce(stdout, F.lit("")))
    lines = F.split(text, LINE_END)
    labelled = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, LABELLED, 1)), lambda x: (x != "") & plausible(x))
    likely = F.filter(lines, plausible)
    last = F.when(F.size(likely) > 0, strip(F.try_element_at(likely, F.lit(-1)))).otherwise("")
    return F.when(text.rlike(FENCED), strip(F.regexp_extract(text, FENCED, 1))).when(F.size(labelled) > 0, strip(F.try_element_at(labelled, F.lit(1)))).otherwise(last)


def latex_error(log: Column, stdout: Column, stderr: Column, most: int = 8, tail: int = 1200) -> Column:
    """The first error lines of the log, or of the output without one; without such lines the end of the text."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.when(blank(log) != "", log).when(blank(stdout) != "", stdout).otherwise(blank(stderr))
    error = lambda x: x.startswith("!") | F.contains(x, F.lit("Undefined control sequence")) | F.contains(x, F.lit("Emergency stop"))
    found = F.array_join(F.transform(F.slice(F.filter(F.split(text, LINE_END), error), 1, most), strip), "\n")
    return F.when(found != "", found).when(text != "", F.right(text, F.lit(tail))).otherwise("xelatex failed")
