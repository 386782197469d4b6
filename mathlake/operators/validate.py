"""Validation behind a content-hash cache: repairs are added, equal work is done once, and what was done is not repeated."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import growing, materialise, ship
from ..functions.gates import balanced, embedded_wrappers, needs_validation, stale
from ..functions.latex import candidate_key, effective_display, latex_hash, validation_body
from ..functions.text import clean_latex, repairs
from .select import choose, manual_rows

Validator = Callable[[pd.Series], list[tuple[bool, str | None]]]


def with_repairs(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with their repairs appended as pending ones of source <source>_repair, numbered after the others.

    A (source, latex) pair a formula already has is not added again; of equal repairs the first in list order stays.
    """
    own = candidates.filter(F.col("repair_of").isNull()) if "repair_of" in candidates.columns else candidates
    text = F.when(F.coalesce("latex", F.lit("")) != "", F.col("latex")).otherwise(F.col("raw") if "raw" in candidates.columns else F.lit(""))
    key = candidate_key(F.col("candidate_key") if "candidate_key" in candidates.columns else F.lit(None), F.col("source"), F.col("variant"), F.col("idx"))
    rows = repairs(own.select(*keys, "idx", "source", "variant", key.alias("repair_of"), text.alias("text")), [*keys, "idx", "source", "variant", "repair_of"], "text")
    rows = rows.withColumn("source", F.concat(F.coalesce("source", F.lit("unknown")), F.lit("_repair"))).withColumnRenamed("repaired", "latex")
    first = rows.groupBy(*keys, "source", "latex").agg(F.min(F.struct("idx", "repair_pos", "variant", "repair_of")).alias("f"))
    fresh = first.join(growing(candidates.select(*keys, "source", "latex").distinct()), [*keys, "source", "latex"], "left_anti")
    last = candidates.groupBy(*keys).agg(F.max("idx").alias("__last"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("f.idx", "f.repair_pos"))
    new = fresh.withColumn("__p", place).join(growing(last), keys).select(*keys, (F.col("__last") + F.col("__p")).alias("idx"), "source", "f.variant", "latex", "f.repair_of", F.lit("pending").alias("validation_status"))
    return candidates.unionByName(new, allowMissingColumns=True)


def work(candidates: DataFrame, force: bool = False) -> DataFrame:
    """candidates with clean, current_hash and todo: what a run has to validate."""
    rows = clean_latex(candidates, "latex", "clean").withColumn("current_hash", latex_hash(F.col("clean")))
    old = F.col("artifact_hash") if "artifact_hash" in candidates.columns else F.lit(None).cast("string")
    is_stale = stale(F.col("latex_hash"), F.col("current_hash"), old)
    return rows.withColumn("todo", F.lit(True) if force else needs_validation(F.col("validation_status"), F.col("latex"), is_stale))


def artifact_currency(rendered: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, current: whether the files of a compile exist and its TeX is what would be written now.

    rendered has the document of each row; artifacts the TeX that was compiled and whether its PDF and log exist.
    """
    there = artifacts.select(*keys, F.sha2(F.col("tex").cast("binary"), 256).alias("__old"), (F.col("has_pdf") & F.col("has_log")).alias("__files"))
    rows = rendered.select(*keys, F.sha2(F.col("document").cast("binary"), 256).alias("__now")).join(there, keys, "left")
    return rows.select(*keys, F.coalesce(F.col("__files") & (F.col("__now") == F.col("__old")), F.lit(False)).alias("current"))


ESCAPED = re.compile(r"\\.", re.S)


def structural(bodies: pd.Series) -> list[tuple[bool, str | None]]:
    """A stand-in for a TeX run: a body whose braces close compiles."""
    out = []
    for body in bodies:
        depth, ok = 0, True
        for c in ESCAPED.sub("", body):  # an escaped backslash escapes nothing
            depth += (c == "{") - (c == "}")
            ok &= depth >= 0
        out.append((True, None) if ok and not depth else (False, "! Missing } inserted."))
    return out


def validate(candidates: DataFrame, keys: list[str], validator: Validator = structural, cache: DataFrame | None = None, display: str = "display", force: bool = False, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """candidates with status, error and hash after validation, and the verdicts (current_hash, display, ok, error).

    Cheap checks come first; what is left is one row per hash and display type, less what the cache holds, and only that
    reaches the validator. Write the verdicts to a table and pass it as the cache of the next run, which then does no work.
    """
    ship(candidates.sparkSession)
    shown = F.col(display) if display in candidates.columns else F.lit(display)
    early = F.when(F.col("clean") == "", "empty candidate").when(embedded_wrappers(F.col("clean")), "embedded math wrappers in candidate")
    seen = lambda some: work(some, force).withColumn("__display", shown).withColumn("__early", early)
    rows = seen(candidates)
    # What candidates have in common is cleaned once for the validator.
    told_by = [c for c in dict.fromkeys(("latex", "validation_status", "latex_hash", "artifact_hash", display)) if c in candidates.columns]
    jobs = (rows if force else seen(candidates.select(*told_by).distinct())).filter("todo and __early is null").select("current_hash", F.col("__display").alias("display"), "clean").distinct()
    if cache is not None and not force:
        jobs = jobs.join(cache.select("current_hash", "display"), ["current_hash", "display"], "left_anti")
    jobs = jobs.select("current_hash", "display", validation_body(F.col("clean"), F.col("display"), mode).alias("body"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            verdicts = validator(part["body"])
            yield part[["current_hash", "display"]].assign(ok=[v[0] for v in verdicts], error=[v[1] for v in verdicts])

    done = jobs.mapInPandas(run, "current_hash string, display string, ok boolean, error string")
    known = done if cache is None else cache.select("current_hash", "display", "ok", "error").unionByName(done)
    out = rows.join(known.withColumnRenamed("display", "__display"), ["current_hash", "__display"], "left")
    status = F.when(~F.col("todo"), F.col("validation_status")).when(F.col("__early").isNotNull() | ~F.coalesce("ok", F.lit(False)), "invalid").otherwise("valid")
    error = F.when(~F.col("todo"), F.col("validation_error") if "validation_error" in candidates.columns else F.lit(None)).otherwise(F.coalesce("__early", "error"))
    hash_ = F.when(F.col("todo"), F.col("current_hash")).otherwise(F.col("latex_hash"))
    names = [c for c in candidates.columns if c not in ("validation_status", "validation_error", "latex_hash")]
    return out.select(*names, status.alias("validation_status"), error.alias("validation_error"), hash_.alias("latex_hash"), balanced(F.col("clean")).alias("is_balanced")), known


def compile_and_choose(formulas: DataFrame, candidates: DataFrame, manual: DataFrame, keys: list[str], validator: Validator = structural, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """formulas and candidates after manual LaTeX (keys, latex) was added, compiled and selected, valid or not.

    Only the new candidates are compiled, each text once; of several for one formula the last one is selected. It is looked
    up among the new ones: an older candidate of the same key is not meant, and the others stay where they are.
    """
    shown = {c: F.col(c) if c in formulas.columns else F.lit(None).cast("string") for c in ("display_type_manual", "display_type_auto")}
    new = manual_rows(candidates, manual, keys).withColumn("latex_hash", F.lit(None).cast("string"))
    new = new.join(formulas.select(*keys, effective_display(*shown.values()).alias("display")), keys)
    done = materialise(validate(new, keys, validator, force=True, mode=mode)[0], "compiled")
    both = candidates.unionByName(done.drop("display", "is_balanced"), allowMissingColumns=True)
    last = done.groupBy(*keys).agg(F.max_by("candidate_key", "idx").alias("candidate_key"))
    return choose(formulas, done, last, keys), both


def compile_runs(tex: DataFrame, runner: Callable[[str], tuple[int, str]], most: int = 2) -> DataFrame:
    """Final compiles: a second pass only if the first asks for it; one row a pass."""
    ship(tex.sparkSession)
    #: What a TeX run says when it wants another pass.
    markers = ("Rerun to get cross-references right", "Label(s) may have changed", "There were undefined references", "Rerun LaTeX")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[dict[str, Any]] = []
            for doc, text in zip(part["doc_id"], part["tex"], strict=True):
                for k in range(1, most + 1):
                    code, said = runner(text)
                    rows.append({"doc_id": doc, "run": k, "returncode": code, "output": said})
                    if code or not any(m in said for m in markers):
                        break
            yield pd.DataFrame(rows, columns=["doc_id", "run", "returncode", "output"])

    return tex.select("doc_id", "tex").mapInPandas(run, "doc_id long, run int, returncode int, output string")
