"""Hashes, names, keys and wrappers of formulas."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import header as render_header
from .text import strip


def latex_hash(clean: Column) -> Column:
    """SHA-256 of cleaned LaTeX; one definition for validation, staleness and audit."""
    return F.sha2(F.coalesce(clean, F.lit("")).cast("binary"), 256)


def artifact_name(source: Column, idx: Column, hash_: Column) -> Column:
    return F.concat_ws("_", F.lit("candidate"), F.regexp_replace(source, r"[^A-Za-z0-9_.\-]+", "_"), idx.cast("string"), F.left(hash_, F.lit(12)))


def candidate_key(key: Column, source: Column, variant: Column, idx: Column) -> Column:
    made = F.concat_ws(":", F.coalesce(source, F.lit("unknown")), F.coalesce(variant, F.lit("original")), idx.cast("string"))
    return F.coalesce(F.when(key != "", key), made)


def effective_display(manual: Column, auto: Column) -> Column:
    """A valid manual type, else a valid automatic one, else inline."""
    known = lambda c: F.when(strip(c).isin("inline", "display"), strip(c))
    return F.coalesce(known(manual), known(auto), F.lit("inline"))


#: The carrier sentence of an inline formula and the display block.
CARRIER = ("Текст до \\( ", " \\) текст после.")
BLOCK = ("\\[\n", "\n\\]")


def validation_body(latex: Column, display: Column, mode: str = "auto") -> Column:
    """The formula as it is compiled: a display block, or inline in a carrier sentence; mode can force either."""
    shown = {"inline": F.lit(False), "display": F.lit(True)}.get(mode, display == "display")
    around = lambda pair: F.concat(F.lit(pair[0]), latex, F.lit(pair[1]))
    return F.when(shown, around(BLOCK)).otherwise(around(CARRIER))


def validation_document(body: Column, settings: dict[str, Any]) -> Column:
    latex = settings.get("latex", {})
    top = f"\\documentclass[{latex.get('fontsize', '12pt')}]{{{latex.get('documentclass', 'article')}}}\n{render_header(settings)}\n\\pagestyle{{empty}}\n\\begin{{document}}\n"
    return F.concat(F.lit(top), body, F.lit("\n\\end{document}\n"))


def todo_comment(formula_id: Column, kept: bool) -> Column:
    tail = "; PNG preview kept instead of WMF/EMF. -->" if kept else ". -->"
    return F.concat(F.lit("<!-- TODO_FORMULA_"), formula_id, F.lit(": formula OCR/validation failed" + tail))


def todo_image(png: Column, formula_id: Column) -> Column:
    """The raster in place of a formula that has no LaTeX, and a comment that names it."""
    return F.concat(F.lit("![]("), F.translate(png, "\\", "/"), F.lit(")\n"), todo_comment(formula_id, True))


def merge_text(selected: Column, display: Column, png: Column, formula_id: Column, merge: dict[str, Any]) -> Column:
    """What replaces a formula image: the wrapped LaTeX, or what the policy for unresolved formulas says."""
    s = strip(F.coalesce(selected, F.lit("")))

    def wrap(template: str) -> Column:
        parts = template.split("{latex}")
        return F.concat(*[x for p in parts[:-1] for x in (F.lit(p), s)], F.lit(parts[-1]))

    wrapped = F.when(display == "display", wrap(merge["display_wrapper"])).otherwise(wrap(merge["inline_wrapper"]))
    drop = merge.get("invalid_formula_policy") == "drop_with_todo"
    return F.when(s != "", wrapped).otherwise(todo_comment(formula_id, False) if drop else todo_image(png, formula_id))
