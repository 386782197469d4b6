"""From Markdown to merged Markdown: extract, recognise, validate, select, merge, audit."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialise
from ..functions.latex import effective_display, merge_text
from ..operators import audit as audits
from ..operators import extract, merge, ocr, select, validate, visual
from ..sources.markdown import images


def build_formulas(docs: DataFrame, settings: dict[str, Any], parsed: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown -> the formulas table, nothing selected yet."""
    rows = extract.formulas_of(docs, settings["images"]["formula_extensions"], parsed=parsed)
    empty = F.lit(None).cast("string")
    return rows.select("*", empty.alias("display_type_manual"), empty.alias("selected_latex"), empty.alias("selected_source"), empty.alias("selected_candidate_key"), F.lit("pending").alias("validation_status"))


def full(docs: DataFrame, engines: dict[str, ocr.Engine], settings: dict[str, Any], validator: validate.Validator = validate.structural, strict: bool = False, rasters: DataFrame | Callable[[DataFrame], DataFrame] | None = None, renderer: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every table of a whole run: formulas, candidates, merged, issues, summary.

    rasters holds the formulas' images (doc_id, id, width, height, pixels), or gives them for the formulas; renderer draws texts (latex_hash, latex) as
    previews (latex_hash, width, height, pixels). With both, valid candidates get their visual_score from them.

    Stages that call engines or validators are written to the shared folder, so they run once; so are the images, as texts
    are parsed once.
    """
    keys = ["doc_id", "id"]
    parsed = materialise(images(docs.select("doc_id", "markdown"), alone=True), "images")
    formulas = materialise(build_formulas(docs, settings, parsed), "formulas")
    todo = ocr.tasks(formulas.select(*keys, "png_path"), list(engines), settings["images"]["ocr_variants"])
    raw = materialise(ocr.run_engines(todo, engines, keys), "recognised")
    place = F.row_number().over(select.Window.partitionBy(*keys).orderBy("source", "variant"))
    candidates = raw.withColumn("idx", place).withColumn("latex_hash", F.lit(None).cast("string")).withColumn("visual_score", F.lit(None).cast("double"))
    repaired = materialise(validate.with_repairs(candidates, keys), "repaired")
    judged, _ = validate.validate(repaired, keys, validator)
    judged = materialise(judged, "validated")
    if rasters is not None and renderer is not None:
        previews = materialise(renderer(visual.texts_to_draw(judged)), "previews")
        shown = rasters(formulas) if callable(rasters) else rasters
        judged = materialise(visual.score_candidates(judged, shown, previews, keys), "scored")
    chosen = select.select_candidates(formulas, judged, settings, keys)
    chosen = materialise(select.drop_invalid_selections(chosen, settings["merge"]["allow_invalid_formula_fallback"]), "selected")
    text = merge_text(F.col("selected_latex"), effective_display(F.col("display_type_manual"), F.col("display_type_auto")), F.col("png_path"), F.col("id"), settings["merge"])
    merged, issues = merge.merge(docs, chosen, text, settings["images"]["formula_extensions"], ["doc_id"], strict, parsed)
    return {"formulas": chosen, "candidates": judged, "merged": merged, "issues": issues, "summary": audits.formula_summary(chosen, "id")}
