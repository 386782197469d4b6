"""Image references as comparable paths. Pure text: nothing looks at a file system, and links are not resolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def bare(ref: Column) -> Column:
    """A reference without blanks, angle brackets and quotes around it, percent-decoded; + stays +, malformed % stays."""
    s = F.regexp_replace(strip(F.coalesce(ref, F.lit(""))), r"\A[<>]+|[<>]+\z", "")
    s = F.regexp_replace(F.regexp_replace(s, r'\A"+|"+\z', ""), r"\A'+|'+\z", "")
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def normalise(ref: Column) -> Column:
    return F.lower(F.translate(bare(ref), "\\", "/"))


def without_query(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "?", 1), "#", 1)


def basename(ref: Column) -> Column:
    return F.substring_index(without_query(normalise(ref)), "/", -1)


def has_extension(ref: Column, extensions: list[str]) -> Column:
    path = F.lower(without_query(ref))
    tests = [path.endswith(e.lower()) for e in extensions]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.rlike(r"\A[a-z]:/")


def collapse(path: Column) -> Column:
    """Drops . segments and folds .. segments of a normalised path."""
    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 1)
        return F.when(part.isin(".", ""), kept).when(up, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    root = F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("."))
    folded = F.aggregate(F.split(path, "/"), F.array(root), step, lambda kept: F.array_join(kept, "/"))
    return F.regexp_replace(folded, r"\A\./", "")


def variants(ref: Column, workdir: str, markdown_dir: str) -> Column:
    """Every spelling under which a reference may be known: as written, under either folder, relative, and its last segment."""
    root = workdir.lower().rstrip("/")
    folders = [d.lower().rstrip("/") for d in (markdown_dir, workdir)]

    def spellings(path: Column) -> Column:
        under = [F.when(~is_absolute(path), F.concat(F.lit(f"{d}/"), path)) for d in dict.fromkeys(folders)]
        written = F.transform(F.array(path, *under), collapse)
        inside = F.when(path.startswith(root + "/"), F.substring(path, F.lit(len(root) + 2), F.length(path)))
        return F.concat(F.array(path), written, F.array(inside, F.substring_index(without_query(path), "/", -1)))

    return F.array_distinct(F.filter(let(normalise(ref), spellings), lambda v: v.isNotNull() & (v != "")))


def relative(path: Column, root: str) -> Column:
    """The path from root on, or the path itself where it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
