"""Image links by bracket depths against the sequential parser."""

import random

from pyspark.sql import functions as F

from mathlake.sources import brackets, markdown

PARTS = ["![", "](", "]", "(", ")", "{", "}", "\\", "<", ">", ">)", "!", "[", " ", "\n", "\u2003", "\x1c", "a", "é😀", "![x](y", "![](<", "){", "\\![", "\\]", "![a](b (c)/d.png) {w={1}}"]


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.i, []).append((r.alt, r.dest, r.attrs, r.original, r.start, r.end))
    return {i: sorted(v, key=lambda x: x[4]) for i, v in out.items()}


def agree(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, markdown string")
    want = {i: v for i, t in enumerate(texts) if (v := list(markdown.parse(t or "")))}
    got = rows_of(brackets.images_balanced(df, ["i"]))
    for i in want.keys() | got.keys():
        assert got.get(i) == want.get(i), texts[i]
    return want


def test_equals_the_parser_on_generated_strings(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(6000)]
    assert len(agree(spark, texts)) > 1000


def test_overlaps_and_escapes(spark):
    agree(spark, [
        None, "", "![", "![]()", "x ![a](b ![c) ](d)", "![a](b ![c) ![d](e)", "![a ![b](c)", "![a](![b](![c](d)))", "![a](![b](![c](d))", "![a](<b (>) ![c](d)",
        "\\![a](b)", "![a\\](b) ![c](d\\) e)", "![a](b)\u2003{x}", "![a](b)\n{x}", "![a](b){x\\}y}", "![a](b){x ![c](d)", "![a](<b>c>){x}", ") } ![a](b)", "![a](<>)", "![a]( b )",
    ])


def test_long_texts_and_images_across_pieces(spark):
    deep, many = "![a](" + "(" * 20000 + "x" + ")" * 20000 + ")", "".join(f"w ![i{k}](m(e)/{k}.png){{w=1}}\n" for k in range(5000))
    want = agree(spark, [deep, many, "z" * 4094 + "![ab](c" + "d" * 9000 + ") e", "![" * 2000, "![a](b " * 500])
    assert len(want[1]) == 5000 and len(want[0]) == len(want[2]) == 1


def test_other_columns_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1, "![a](b)", "p"), (None, 2, "![c](d)", "q"), (3, 3, None, "r")], "m long, i long, markdown string, k string")
    out = brackets.images_balanced(df, ["m", "i"])
    assert out.columns == ["m", "i", "k", "alt", "dest", "attrs", "original", "start", "end"]
    assert sorted((r.i, r.k, r.dest) for r in out.collect()) == [(1, "p", "b"), (2, "q", "d")]
    assert brackets.images_balanced(df.filter(F.lit(False)), ["m", "i"]).count() == 0
