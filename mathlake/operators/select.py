"""Selection: at most one winner per formula, the log of what was turned down, manual choices and overrides."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import growing
from ..functions.gates import gate_reason
from ..functions.latex import candidate_key
from ..functions.text import strip

UNRANKED = 999


def rank_of(source: Column, priority: list[str]) -> Column:
    """Place in the priority list; what is not listed comes last. The list is a literal, so no join is needed."""
    out = F.lit(UNRANKED)
    for i, name in reversed(list(enumerate(priority))):
        out = F.when(source == name, i).otherwise(out)
    return out


def judged(candidates: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """candidates with reason (null if good), candidate_key and rank; the gate is evaluated once a candidate."""
    s = settings["candidate_selection"]
    key = candidate_key(F.col("candidate_key") if "candidate_key" in candidates.columns else F.lit(None), F.col("source"), F.col("variant"), F.col("idx"))
    return candidates.withColumn("reason", gate_reason(F.col("latex"), s)).withColumn("candidate_key", key).withColumn("rank", rank_of(F.col("source"), s["priority"]))


def best(candidates: DataFrame, settings: dict[str, Any], keys: list[str]) -> DataFrame:
    """The winner of each formula that has one, and how it won.

    Two minima per formula are all that is needed, so this is one hash aggregation with a partial phase: no sort, no
    window, and a formula with very many candidates costs one row a task.
    """
    s = settings["candidate_selection"]
    rows = judged(candidates, settings).filter((F.col("validation_status") == "valid") & F.col("reason").isNull())
    won = F.struct("candidate_key", "source", "latex", "visual_score")
    visual = F.min_by(F.when(F.col("visual_score").isNotNull(), won), F.when(F.col("visual_score").isNotNull(), F.struct(-F.col("visual_score"), "rank", "idx")))
    first = F.min_by(won, F.struct("rank", "idx"))
    out = rows.groupBy(*keys).agg(visual.alias("v"), first.alias("p"))
    seen = F.col("v.visual_score") >= F.lit(float(s["min_visual_score"]))
    seen = F.coalesce(seen, F.lit(False)) if s["strategy"] == "visual_best" else F.lit(False)
    return out.select(*keys, F.when(seen, F.col("v")).otherwise(F.col("p")).alias("w"), F.when(seen, "visual").otherwise("priority").alias("chosen_by"))


def select_candidates(formulas: DataFrame, candidates: DataFrame, settings: dict[str, Any], keys: list[str], force: bool = False) -> DataFrame:
    """formulas with selected_latex, selected_source, selected_candidate_key, validation_status, validation_error, chosen_by.

    A manual selection with LaTeX stays unless forced. Without a winner an earlier LaTeX stays unless forced, and the
    formula is invalid.
    """
    sticky = F.lit(False) if force else (F.coalesce(F.col("selected_source") == "manual", F.lit(False)) & (strip(F.coalesce("selected_latex", F.lit(""))) != ""))
    rows = formulas.join(growing(best(candidates, settings, keys)), keys, "left")
    has = F.col("w").isNotNull()
    old = F.lit(None).cast("string") if force else F.when(F.col("selected_latex") != "", F.col("selected_latex"))

    def pick(name: str, winner: Column, loser: Column) -> Column:
        return F.when(sticky, F.col(name)).when(has, winner).otherwise(loser)

    new = {
        "selected_latex": pick("selected_latex", F.col("w.latex"), old),
        "selected_source": pick("selected_source", F.col("w.source"), F.when(old.isNotNull(), F.col("selected_source"))),
        "selected_candidate_key": pick("selected_candidate_key", F.col("w.candidate_key"), F.col("selected_candidate_key")),
        "validation_status": pick("validation_status", F.lit("valid"), F.lit("invalid")),
        "validation_error": F.when(~sticky & ~has, "no valid candidate selected"),
        "chosen_by": F.when(sticky, "manual").when(has, F.col("chosen_by")).otherwise("none"),
    }
    return rows.select(*[c for c in formulas.columns if c not in new], *(v.alias(k) for k, v in new.items()))


def rejections(candidates: DataFrame, settings: dict[str, Any], keys: list[str]) -> DataFrame:
    """keys, phase, ord, source, reason: gate failures in list order, then scores below the threshold, best first.

    A formula's scores are only rejected when even its best one is below the threshold.
    """
    s = settings["candidate_selection"]
    valid = (F.col("validation_status") == "valid") & F.col("visual_score").isNotNull()
    score = F.when(valid & F.col("reason").isNull(), F.col("visual_score"))
    rows = judged(candidates, settings).select(*keys, "idx", "source", "rank", "reason", score.alias("__score"))
    # Candidates are judged once; both windows are dealt by the formula.
    rows = rows.withColumn("__best", F.max("__score").over(Window.partitionBy(*keys)))
    low = F.col("__score").isNotNull() & (F.col("__best") < s["min_visual_score"]) if s["strategy"] == "visual_best" else F.lit(False)
    rows = rows.withColumn("phase", F.when(F.col("reason").isNotNull(), 1).when(low, 2)).filter("phase is not null")
    later = lambda c: F.when(F.col("phase") == 2, c)
    order = Window.partitionBy(*keys, "phase").orderBy(later(-F.col("__score")), later(F.col("rank")), "idx")
    why = F.when(F.col("phase") == 1, F.col("reason")).otherwise(F.concat(F.lit("visual_score below threshold: "), F.col("__score").cast("string")))
    return rows.select(*keys, "phase", F.row_number().over(order).alias("ord"), "source", why.alias("reason"))


def drop_invalid_selections(formulas: DataFrame, allow: bool = True) -> DataFrame:
    """Selections that failed validation fall back to the unresolved placeholder, or are an error where not allowed."""
    bad = (F.coalesce("selected_latex", F.lit("")) != "") & ~F.coalesce(F.col("validation_status") == "valid", F.lit(False))
    if not allow and not formulas.filter(bad).isEmpty():
        raise ValueError("selected formulas failed validation")
    none = F.lit(None).cast("string")
    out = formulas.withColumn("fallback_reason", F.when(bad, "selected candidate invalid; falling back to TODO PNG")).withColumn("__bad", bad)
    for c in ("selected_latex", "selected_source", "selected_candidate_key"):
        out = out.withColumn(c, F.when(F.col("__bad"), none).otherwise(F.col(c)))
    return out.withColumn("validation_status", F.when(F.col("__bad"), "invalid").otherwise(F.col("validation_status"))).drop("__bad")


def manual_rows(candidates: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """Manual LaTeX (keys, latex) as pending candidates, numbered after the manual ones that a formula has."""
    had = candidates.groupBy(*keys).agg(F.count_if(F.col("source") == "manual").alias("__m"), F.max("idx").alias("__i"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("latex"))
    rows = manual.join(had, keys, "left").withColumn("__n", place)
    number = F.coalesce("__m", F.lit(0)) + F.col("__n")
    return rows.select(*keys, (F.coalesce("__i", F.lit(0)) + F.col("__n")).alias("idx"), F.lit("manual").alias("source"), F.lit("manual").alias("variant"), F.col("latex").alias("raw"), strip(F.col("latex")).alias("latex"), F.lit("pending").alias("validation_status"), F.concat(F.lit("manual:manual:"), number.cast("string")).alias("candidate_key"))


def add_manual(candidates: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with the manual ones appended."""
    return candidates.unionByName(manual_rows(candidates, manual, keys), allowMissingColumns=True)


def choose(formulas: DataFrame, candidates: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """formulas with the candidates that choices (keys, candidate_key) name selected, and choice_error where there is none.

    A choice takes the candidate's text, source, key, status and error whole, null text included; a status of null is
    pending. Formulas without a choice, or with one that is not found, stay as they were.
    """
    error = F.col("validation_error") if "validation_error" in candidates.columns else F.lit(None).cast("string")
    taken = {"selected_latex": F.col("latex"), "selected_source": F.col("source"), "selected_candidate_key": F.col("candidate_key"), "validation_status": F.coalesce("validation_status", F.lit("pending")), "validation_error": error}
    c = candidates.select(*keys, "candidate_key", F.struct(*(v.alias(k) for k, v in taken.items())).alias("__c"))
    asked = choices.groupBy(*keys).agg(F.min("candidate_key").alias("candidate_key")).join(c, [*keys, "candidate_key"], "left").withColumnRenamed("candidate_key", "__asked")
    rows, found = formulas.join(asked, keys, "left"), F.col("__c").isNotNull()
    new = [F.when(found, F.col(f"__c.{n}")).otherwise(F.col(n)).alias(n) if n in taken else F.col(n) for n in formulas.columns]
    missing = F.when(F.col("__asked").isNotNull() & ~found, F.concat(F.lit("candidate not found: "), F.col("__asked")))
    return rows.select(*new, missing.alias("choice_error"))


def apply_overrides(formulas: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Edits (keys, edited_at, and columns of formulas): of each formula the latest edit's columns that are not null win."""
    columns = [c for c in overrides.columns if c in formulas.columns and c not in keys]
    # Struct order settles edits made at one time.
    last = overrides.groupBy(*keys).agg(F.max(F.struct("edited_at", *columns)).alias("__o"))
    rows = formulas.join(last, keys, "left")
    return rows.select(*[F.coalesce(F.col(f"__o.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in formulas.columns])


def find_formula(formulas: DataFrame, formula_id: Any) -> DataFrame:
    """One formula's rows; an error if there is none."""
    found = formulas.filter(F.col("formula_id") == formula_id)
    if found.isEmpty():
        raise KeyError(f"Formula not found: {formula_id}")
    return found


def id_range(formulas: DataFrame, only: str | None = None, first: str | None = None, last: str | None = None, limit: int | None = None, order: str = "seq", per: list[str] | None = None) -> DataFrame:
    """Formulas by inclusive text bounds of id, then the first `limit` in document order, in all or per group."""
    if limit is not None and limit < 0:
        raise ValueError("limit must be >= 0")
    rows = formulas
    for test in ((F.col("id") == only) if only else None, (F.col("id") >= first) if first else None, (F.col("id") <= last) if last else None):
        rows = rows if test is None else rows.filter(test)
    if limit is None:
        return rows
    if per:
        return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*per).orderBy(order))).filter(F.col("__k") <= limit).drop("__k")
    return rows.orderBy(order).limit(limit)
