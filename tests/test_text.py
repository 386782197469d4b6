"""Cleaning, repairs and gates: known examples, and parity with plain-Python rules on generated strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mathlake import config
from mathlake.functions import gates, logs, text


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def cleaned(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.c for r in text.clean_latex(df, "s", "c").orderBy("i").collect()]


@pytest.mark.parametrize("raw, clean", [
    ("```latex\n\\[ a_i = \\frac{1}{2} \\]\n```", "a_i = \\frac{1}{2}"),
    ("Here is the formula: $x − y < z$", "x - y < z"),
    ("\\(\\(x\\)\\)", "x"),
    ("$$\\[ y \\]$$", "y"),
    ("$a$+$b$", "a$+$b"),
    ("Formula: q = 1\nSorry, that is all", "q = 1"),
    ("- - x = 1", "- x = 1"),
    ("α&lt;β \\textgreater 2", "\\alpha<\\beta > 2"),
    ("a=1\r\n\r\n\r\n\r\nb=2", "a=1\nb=2"),
    ("", ""),
    ("\u00a0x_1\u2003", "x_1"),
])
def test_clean(spark, raw, clean):
    assert cleaned(spark, [raw]) == [clean]


def test_null_is_empty(spark):
    assert cleaned(spark, [None]) == [""]


def test_cleaning_leaves_no_fence_and_no_outer_blank(spark):
    rng = random.Random(3)
    parts = ["```", "latex", "$", "\\[", "\\]", "x_1", " ", "\n", "−", "word words", "sorry", "- ", "\t", "\u2003"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(300)]
    for c in cleaned(spark, values):
        assert "```" not in c and c == c.strip()


def plain_balanced(s):
    kinds, open_, skip = {"}": "{", "]": "[", ")": "("}, [], False
    for c in s:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c in kinds.values():
            open_.append(c)
        elif c in kinds and (not open_ or open_.pop() != kinds[c]):
            return False
    return not open_


def test_balance_parity(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("{}[]()\\ax") for _ in range(rng.randrange(8))) for _ in range(500)] + ["\\frac{a}{b}", "\\frac{a}{b", "[a,b)", ""]
    assert column(spark, values, gates.balanced) == [plain_balanced(v) for v in values]


def test_embedded_parity(spark):
    rng = random.Random(6)
    values = ["".join(rng.choice("$\\()[]a") for _ in range(rng.randrange(7))) for _ in range(500)]
    want = [bool(re.search(r"\\[()\[\]]|\$\$|(?<!\\)\$(?!\$)", v)) for v in values]
    assert column(spark, values, gates.embedded_wrappers) == want


def test_strip_is_unicode_strip(spark):
    values = ["\x1c a \u3000", "\x85b\xa0", "\u200bc", " \t\n", "d"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_gate_order(spark):
    s = config.DEFAULTS["candidate_selection"]
    values = ["", "Sorry", "a\\(b", "x^{", "[] []", "# head", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen words", "x_1", None]
    want = ["empty", "model refusal", "embedded math wrappers", "unbalanced braces/brackets", "reject pattern: \\[\\]\\s*\\[\\]", "markdown leakage", "looks like explanatory text", None, "empty"]
    values[6] = values[6] + " and some more words to be long enough"
    assert column(spark, values, lambda c: gates.gate_reason(c, s)) == want


def test_torn_arrow_has_a_mended_repair(spark):
    df = spark.createDataFrame([(1, "\\(s \\in S\\)htarrow A^{}\\{1\\}=Y"), (2, "x")], "i int, s string")
    rows = [r.repaired for r in text.repairs(df, ["i"], "s").orderBy("i", "repair_pos").collect()]
    assert any("\\rightarrow" in r and "A^{}" not in r for r in rows)
    assert len(rows) == len(set(rows))


def test_stdout(spark):
    values = ["Loading model\n50%|#####| 1/2\nPredicted LaTeX: x^2 + y^2\nfooter done", "latex:\n```latex\n\\frac{a}{b}\n```", "a=1\nb=2\nsaved", "nothing", None]
    assert column(spark, values, logs.latex_of_output) == ["x^2 + y^2", "\\frac{a}{b}", "b=2", "", ""]


def test_error_summary_takes_eight_lines_or_the_tail(spark):
    many, long = "\n".join(f"! e{i}" for i in range(20)), "x" * 3000
    got = column(spark, [many, long, "", None], lambda c: logs.latex_error(c, F.lit(""), F.lit(None).cast("string")))
    assert got == ["\n".join(f"! e{i}" for i in range(8)), "x" * 1200, "xelatex failed", "xelatex failed"]


def test_repairs_of_one_file_are_many_tasks(spark):
    """One partition of short texts is dealt out before it is cleaned; nothing else changes."""
    rows = spark.createDataFrame([(i, ("htarrow A^{}", "x", "\\[ y \\]", None)[i % 4]) for i in range(40)], "k int, s string")
    found = text.repairs(rows.coalesce(1), ["k"], "s")
    assert found.rdd.getNumPartitions() > 1
    assert sorted(r.k for r in found.select("k").distinct().collect()) == [i for i in range(40) if i % 4 == 0]
