"""Audit, summaries, review filters and report rows: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import relative
from ..functions.text import strip


def has_latex(c: str = "selected_latex") -> Column:
    return strip(F.coalesce(c, F.lit(""))) != ""


def selected(formulas: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """formulas with the selected candidate's status, error and preview, where its key is found."""
    c = candidates.select(*keys, F.col("candidate_key").alias("selected_candidate_key"), F.col("validation_status").alias("candidate_status"), F.col("preview_png").alias("candidate_preview"), F.lit(True).alias("candidate_found"))
    return formulas.join(c, [*keys, "selected_candidate_key"], "left")


def stale_candidates(candidates: DataFrame, keys: list[str], current: Column, artifact_hash: Column | None = None, compat: bool = False) -> DataFrame:
    """keys, idx, reason of candidates whose stored hash or artifact name is out of date.

    Artifact names carry twelve digits of the hash; compat asks for all sixty-four, as the audited tool did.
    """
    kept = F.col("latex_hash").isNotNull() & (F.col("latex_hash") != "") & (F.col("latex_hash") != current)
    reason = F.when(kept, "latex_hash mismatch")
    if artifact_hash is not None:
        want = current if compat else F.left(current, F.lit(12))
        reason = reason.when(artifact_hash.isNotNull() & ~F.contains(artifact_hash, want), "artifact path missing current hash")
    return candidates.withColumn("reason", reason).filter("reason is not null").select(*keys, "idx", "reason")


def audit(formulas: DataFrame, candidates: DataFrame, stale: DataFrame, forbidden: DataFrame | None = None, compiled: DataFrame | None = None, key: str = "formula_id", doc: str = "doc_id") -> DataFrame:
    """One row a document: totals, what is unresolved, stale or failing, and the overall status.

    A document fails for unresolved formulas, stale or failing candidates, forbidden references or a failed compile;
    missing previews and a missing build do not fail it.
    """
    rows = selected(formulas, candidates, [key]).join(stale.groupBy(key).agg(F.count("*").alias("__stale")), key, "left")
    chosen = F.coalesce("selected_latex", F.lit("")) != ""
    failing = chosen & F.col("candidate_found") & (F.coalesce("candidate_status", F.lit("")) != "valid")
    out = rows.groupBy(doc).agg(
        F.count("*").alias("total_formulas"),
        F.count_if((F.col("validation_status") == "valid") & chosen).alias("selected_valid_formulas"),
        F.count_if(F.col("selected_source") == "manual").alias("manual_formulas"),
        F.count_if(~has_latex()).alias("unresolved_todo_formulas"),
        F.array_sort(F.collect_list(F.when(~has_latex(), F.col(key)))).alias("unresolved_ids"),
        F.sum(F.coalesce("__stale", F.lit(0))).alias("stale_candidates"),
        F.count_if(chosen & F.col("candidate_preview").isNull()).alias("selected_without_preview"),
        F.count_if(F.coalesce(failing, F.lit(False))).alias("selected_failing"),
    )
    bad = (F.col("unresolved_todo_formulas") + F.col("stale_candidates") + F.col("selected_failing")) > 0
    if forbidden is not None:
        out = out.join(forbidden.groupBy(doc).agg(F.count("*").alias("forbidden_refs")), doc, "left").withColumn("forbidden_refs", F.coalesce("forbidden_refs", F.lit(0)))
        bad = bad | (F.col("forbidden_refs") > 0)
    if compiled is not None:
        out = out.join(compiled.select(doc, "compile_status"), doc, "left").withColumn("compile_status", F.coalesce("compile_status", F.lit("missing")))
        bad = bad | (F.col("compile_status") == "failed")
    return out.withColumn("status", F.when(bad, "failed").otherwise("ok"))


def formula_summary(formulas: DataFrame, key: str = "formula_id", doc: str = "doc_id") -> DataFrame:
    return formulas.groupBy(doc).agg(F.count("*").alias("formula_total"), F.count_if(has_latex()).alias("formula_selected"), F.count_if(~has_latex()).alias("formula_unresolved"), F.array_sort(F.collect_list(F.when(~has_latex(), F.col(key)))).alias("unresolved_ids"))


def review(formulas: DataFrame, which: str = "all", query: str = "", candidates_json: Column | None = None, score: Column | None = None) -> DataFrame:
    """The review list's filters. "low visual score" treats a score of 0 as none, with a fixed bound of 0.70."""
    tests = {
        "all": F.lit(True),
        "invalid": ~F.col("validation_status").eqNullSafe("valid"),
        "no selected latex": F.coalesce("selected_latex", F.lit("")) == "",
        "manual": F.col("selected_source").eqNullSafe("manual"),
        "low visual score": F.coalesce(F.when(score != 0, score), F.lit(1.0)) < 0.70 if score is not None else F.lit(False),
    }
    text = F.lower(F.concat_ws(" ", F.col("formula_id").cast("string"), F.coalesce("selected_latex", F.lit("")), candidates_json if candidates_json is not None else F.lit("[]")))
    return formulas.filter(tests[which] & F.contains(text, F.lit(query.lower())))


def report_rows(formulas: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the report: class by status, the preview of the selected candidate, how many candidates there are."""
    n = candidates.groupBy(*keys).agg(F.count("*").alias("n_candidates"))
    status = F.coalesce("validation_status", F.lit("pending"))
    rows = selected(formulas, candidates, keys).join(n, keys, "left")
    return rows.select(*keys, F.when(status.isin("valid", "invalid"), status).otherwise("pending").alias("row_class"), "selected_latex", F.col("candidate_preview").alias("selected_preview"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def artifact_links(candidates: DataFrame, keys: list[str], report_dir: str, artifacts: str = "artifacts") -> DataFrame:
    """keys, idx, label, href: a row for each artifact of each candidate, its path seen from the report's folder.

    A path under the folder, or else under the one above it, is relative to that; others stay as they are.
    """
    above = report_dir.rstrip("/").rpartition("/")[0]
    rows = candidates.select(*keys, "idx", "source", F.explode(artifacts).alias("name", "path")).filter("path is not null")
    return rows.select(*keys, "idx", F.concat_ws(" ", "source", "name").alias("label"), relative(relative(F.col("path"), report_dir), above).alias("href"))


def report_html(rows: DataFrame, links: DataFrame | None = None, keys: list[str] | None = None, key: str = "formula_id") -> DataFrame:
    """rows (as report_rows gives them) with html: a line of HTML a formula, with the links to its artifacts in order."""
    cells = [F.lit("<tr class='"), F.col("row_class"), F.lit("'><td>"), F.col(key).cast("string"), F.lit("</td><td><pre>"), F.coalesce(escaped(F.col("selected_latex")), F.lit("")), F.lit("</pre></td>")]
    if links is not None:
        one = F.concat(F.lit("<a href='"), escaped(F.col("href")), F.lit("'>"), escaped(F.col("label")), F.lit("</a>"))
        lists = links.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "label", one.alias("a")))).alias("__l"))
        rows = rows.join(lists, keys, "left")
        cells += [F.lit("<td>"), F.coalesce(F.array_join(F.transform("__l", lambda x: x["a"]), " "), F.lit("")), F.lit("</td>")]
    return rows.withColumn("html", F.concat(*cells, F.lit("</tr>"))).drop("__l")


def report_pages(rows: DataFrame, docs: list[str], order: str) -> DataFrame:
    """docs, page: one page of HTML a document, the rows (html) of its formulas in order."""
    lines = F.array_sort(F.collect_list(F.struct(order, "html")))
    pages = rows.groupBy(*docs).agg(lines.alias("__r"))
    body = F.array_join(F.transform("__r", lambda x: x["html"]), "\n")
    return pages.select(*docs, F.concat(F.lit("<!doctype html><meta charset='utf-8'><table>\n"), body, F.lit("\n</table>")).alias("page"))


def tag_count(text: Column, tag: str) -> Column:
    """How often a substring stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)).cast("long")
