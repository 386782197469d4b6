"""Recognition: which engines run, what is left to do, running engines over tasks, and the log of attempts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialise, ship
from ..config import ENGINE_SECTIONS
from ..functions.gates import empty_reason, usable
from ..functions.text import clean_latex

Engine = Callable[[pd.DataFrame], pd.Series]
#: The index of a batch of one row.
ALONE = pd.RangeIndex(1)


def engine_plan(spark: SparkSession, settings: dict[str, Any], availability: dict[str, tuple[bool, str | None]] | None = None) -> DataFrame:
    """One row a requested engine: position, engine, status (will_run, disabled, unavailable, unknown), reason.

    A missing `enabled` counts as enabled. Availability comes from probes; the vision engine counts as available.
    """
    rows = []
    for i, name in enumerate(map(str, settings.get("ocr", {}).get("engines", ["pix2tex"]))):
        ok, why = (availability or {}).get(name, (True, None))
        if name not in ENGINE_SECTIONS:
            status, why = "unknown", "unknown OCR engine"
        elif not settings.get(ENGINE_SECTIONS[name], {}).get("enabled", True):
            status, why = "disabled", None
        else:
            status, why = ("will_run", None) if ok else ("unavailable", why)
        rows.append((i, name, status, why))
    return spark.createDataFrame(rows, "position int, engine string, status string, reason string")


def priority_warnings(plan: DataFrame, priority: list[str]) -> DataFrame:
    """A row a listed source that will not run."""
    listed = plan.sparkSession.createDataFrame(list(enumerate(priority)), "place int, engine string")
    text = F.when(F.col("status") == "disabled", F.concat(F.lit("priority lists the disabled engine "), "engine", F.lit("; its existing candidates can still be selected"))).when(F.col("status").isin("unavailable", "unknown"), F.concat(F.lit("priority lists the unavailable engine "), "engine", F.lit(": "), F.coalesce("reason", F.lit(""))))
    return listed.join(plan, "engine").withColumn("warning", text).filter("warning is not null").select("place", "engine", "warning")


def with_candidates(plan: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A plan's rows with usable, how many usable candidates its engine has, and of how many formulas.

    Candidates are counted by engine and formula before they are counted by engine, so no engine is a hot key.
    """
    good = candidates.filter(usable(F.col("latex"), F.col("validation_status")))
    each = good.groupBy(F.col("source").alias("engine"), *keys).agg(F.count("*").alias("n"))
    counts = each.groupBy("engine").agg(F.sum("n").alias("usable"), F.count("*").alias("formulas"))
    return plan.join(counts, "engine", "left").na.fill(0, ["usable", "formulas"]).select(*plan.columns, "usable", "formulas")


def tasks(formulas: DataFrame, engines: list[str], variants: list[str] | None = None) -> DataFrame:
    """formulas x engines x variants, as two literal arrays exploded: no join at all."""
    variants = [v for v in variants or ["original"] if v.strip()] or ["original"]
    rows = formulas.withColumn("e", F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.lit(e).alias("n")) for i, e in enumerate(engines)))))
    rows = rows.withColumn("v", F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.lit(v).alias("n")) for i, v in enumerate(variants)))))
    return rows.select(*formulas.columns, F.col("e.n").alias("source"), F.col("v.n").alias("variant"), F.col("e.p").alias("engine_pos"), F.col("v.p").alias("variant_pos"))


def pending(all_tasks: DataFrame, candidates: DataFrame, keys: list[str], by_variant: bool = True) -> DataFrame:
    """Tasks without a usable candidate of their source and variant."""
    on = [*keys, "source", *(["variant"] if by_variant else [])]
    done = candidates.filter(usable(F.col("latex"), F.col("validation_status"))).select(*on).distinct()
    return all_tasks.join(done, on, "left_anti")


def ocr_plan(work: DataFrame, key: str = "formula_id", doc: str = "doc_id") -> DataFrame:
    """Per document and engine the ids still to do."""
    return work.groupBy(doc, "source").agg(F.array_sort(F.collect_list(key)).alias("ids"))


def run_engines(work: DataFrame, engines: dict[str, Engine], keys: list[str], image: str = "png_path", partitions: int | None = None) -> DataFrame:
    """Runs each task's engine: keys, source, variant, raw, latex, validation_status, validation_error, elapsed.

    Tasks are dealt by task, not by document, so a document with very many formulas is no hot key. An engine gets the
    rows of its tasks in a batch and returns raw texts; where that fails it is asked row by row, and a failure becomes
    that row's error, never the job's. The result is
    materialised by the caller before it is used twice.
    """
    ship(work.sparkSession)
    names = [*keys, "source", "variant"]
    kinds = dict(work.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for rows in parts:
            rows = rows.reset_index(drop=True)
            raw, error, took = [None] * len(rows), [None] * len(rows), [0.0] * len(rows)

            def call(mine: pd.DataFrame, source: str, at: list[int], raw=raw, error=error, took=took) -> None:
                began = time.time()
                try:
                    found = [str(x) for x in engines[source](mine)]
                    if len(found) != len(mine):
                        raise ValueError(f"{len(found)} results for {len(mine)} tasks")
                    for i, x in zip(at, found, strict=True):
                        raw[i] = x
                except Exception as e:  # noqa: BLE001  a row's failure is data
                    if len(mine) > 1:
                        for k, i in enumerate(at):
                            one = mine.iloc[k : k + 1]
                            one.index = ALONE
                            call(one, source, [i])
                        return
                    error[at[0]] = f"{type(e).__name__}: {e}"
                each = (time.time() - began) / len(mine)
                for i in at:
                    took[i] = each

            for source, mine in rows.groupby("source", sort=False):
                call(mine.reset_index(drop=True), source, list(mine.index))
            yield rows[names].assign(raw=raw, __error=error, elapsed_seconds=took)

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", raw string, __error string, elapsed_seconds double"
    dealt = work.select(*names, *([image] if image in work.columns else [])).repartition(partitions or work.sparkSession.sparkContext.defaultParallelism, *names)
    out = clean_latex(dealt.mapInPandas(run, schema), "raw", "latex")
    why = F.coalesce("__error", empty_reason(F.col("raw"), F.col("latex"), F.col("source")))
    return out.withColumn("validation_error", why).withColumn("validation_status", F.when(why.isNotNull(), "error").otherwise("pending")).drop("__error")


def run_with_originals(work: DataFrame, engines: dict[str, Engine], keys: list[str], retry: list[str], image: str = "png_path", original: str = "original_png") -> DataFrame:
    """run_engines, and once more with the original image where an engine of `retry` made nothing of another one.

    Adds retried. A failure of the engine itself is not tried again.
    """
    on = [*keys, "source", "variant"]
    first = materialise(run_engines(work, engines, keys, image), "recognised-first")
    nothing = first.filter(F.col("source").isin(retry) & F.col("raw").isNotNull() & (F.col("validation_status") == "error")).select(*on)
    again = work.join(nothing, on, "left_semi").filter(F.col(image) != F.col(original)).withColumn(image, F.col(original))
    second = materialise(run_engines(again, engines, keys, image), "recognised-again")
    kept = first.join(second.select(*on), on, "left_anti")
    return kept.withColumn("retried", F.lit(False)).unionByName(second.withColumn("retried", F.lit(True)))


def purge_source(candidates: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """A re-run replaces a source's candidates of a formula: the old ones that remain, then the fresh."""
    kept = candidates.join(fresh.select(*keys, "source").distinct(), [*keys, "source"], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def latest_attempts(attempts: DataFrame, keys: list[str], at: str = "started_at") -> DataFrame:
    """The last attempt of each key, and how many there were: a hash aggregation."""
    rest = [c for c in attempts.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("l")
    return attempts.groupBy(*keys).agg(last, F.count("*").alias("n_attempts")).select(*keys, "l.*", "n_attempts")
