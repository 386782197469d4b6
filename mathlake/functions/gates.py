"""Predicates and quality gates over recognised LaTeX."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import COMMAND, let, prose_score, refuses, strip

#: Patterns of the gates.
EMBEDDED = r"\\[()\[\]]|\$\$|(?<!\\)\$(?!\$)"
BROKEN_ARROW = r"(?U)\\\)\s*(?:h?t?arrow|rightarrow|leftarrow)|\\\)htarrow"
HEADING = r"(?m)^\s{0,3}#{1,6}\s"


def balanced(s: Column) -> Column:
    """Braces, brackets and parentheses close in kind; an escaped character counts for nothing; an empty text is balanced.

    What is neither goes first, so the fold is over brackets alone: those that are open, after a mark that never closes
    for each one shut out of turn.
    """
    brackets = F.split(F.regexp_replace(s, r"(?s)\\.|[^\[\](){}]", ""), "")

    def step(open_: Column, c: Column) -> Column:
        shuts = F.right(open_, F.lit(1)) == F.translate(c, "}])", "{[(")
        return F.when(c.isin("{", "[", "("), F.concat(open_, c)).when(shuts, F.substring(open_, F.lit(1), F.length(open_) - 1)).otherwise(F.concat(F.lit("!"), open_))

    return F.aggregate(F.filter(brackets, lambda c: c != ""), F.lit(""), step) == ""


def embedded_wrappers(s: Column) -> Column:
    return s.rlike(EMBEDDED)


def gate_reason(latex: Column, selection: dict[str, Any]) -> Column:
    """Why a candidate is bad: the first reason that holds, or null."""
    return let(strip(F.coalesce(latex, F.lit(""))), lambda s: _first_reason(s, selection))


def _first_reason(s: Column, selection: dict[str, Any]) -> Column:
    most = int(selection.get("max_explanation_chars", 20)) * 4
    chain = F.when(s == "", "empty").when(refuses(s), "model refusal").when(embedded_wrappers(s), "embedded math wrappers")
    chain = chain.when(s.rlike(BROKEN_ARROW), "broken wrapper/arrow fragment").when(~balanced(s), "unbalanced braces/brackets")
    for pattern in selection.get("reject_patterns", []):
        chain = chain.when(s.rlike(pattern), f"reject pattern: {pattern}")
    chain = chain.when(F.contains(s, F.lit("```")) | s.rlike(HEADING), "markdown leakage")
    return chain.when((prose_score(s) >= 8) & (F.length(F.regexp_replace(s, COMMAND, "")) > most), "looks like explanatory text")


def usable(latex: Column, status: Column) -> Column:
    """A candidate that spares a new recognition: some LaTeX and no error."""
    return (strip(F.coalesce(latex, F.lit(""))) != "") & (F.coalesce(status, F.lit("")) != "error")


def empty_reason(raw: Column, latex: Column, source: Column) -> Column:
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(raw), F.concat(F.lit("empty raw response from "), source)).when(blank(latex), "empty LaTeX after cleaning; inspect raw OCR response")


def stale(latex_hash: Column, current: Column, artifact_hash: Column) -> Column:
    """The stored hash differs from the text's, or the artifact's does where it has one."""
    return ~latex_hash.eqNullSafe(current) | (artifact_hash.isNotNull() & (artifact_hash != current))


def needs_validation(status: Column, latex: Column, is_stale: Column) -> Column:
    """What a run validates: not what is judged and fresh, nor an error without LaTeX."""
    s = F.coalesce(status, F.lit(""))
    return ~(s.isin("valid", "invalid") & ~is_stale) & ~((s == "error") & (F.coalesce(latex, F.lit("")) == ""))
