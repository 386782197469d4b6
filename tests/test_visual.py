"""Visual scores against plain Python, choices by hand, path resolution, search, report links."""

import random

import pytest
from pyspark.sql import functions as F

from mathlake.operators import audit, resolve, search, select, validate, visual
from mathlake.sources import corpus

RASTER = "struct<width:int,height:int,pixels:array<int>>"


def fit(r, canvas):
    """The rule as it is told: shrunk in proportion to the mean of what a pixel covers, in the middle of a white canvas."""
    w, h, p = r
    cw, ch = canvas
    nw, nh = w, h
    if w > cw or h > ch:
        shape = w / h
        if cw / ch >= shape:
            low, high = int(ch * shape // 1), -int(-ch * shape // 1)
            nw, nh = max(high if abs(shape - high / ch) < abs(shape - low / ch) else low, 1), ch
        else:
            low, high = int(cw / shape // 1), -int(-cw / shape // 1)
            away = lambda n: 0 if n == 0 else abs(shape - cw / n)
            nw, nh = cw, max(high if away(high) < away(low) else low, 1)
    out = [[255] * cw for _ in range(ch)]
    for y in range(nh):
        for x in range(nw):
            box = [p[j * w + i] for j in range(y * h // nh, (y + 1) * h // nh) for i in range(x * w // nw, (x + 1) * w // nw)]
            out[(ch - nh) // 2 + y][(cw - nw) // 2 + x] = (2 * sum(box) + len(box)) // (2 * len(box))
    return [v for row in out for v in row]


def test_scores_of_all_sizes(spark):
    rng, rows, want = random.Random(6), [], {}
    for k in range(150):
        canvas = (12, 6)
        one = lambda: (w := rng.randrange(1, 30), h := rng.randrange(1, 20), [rng.randrange(256) for _ in range(w * h)])  # noqa: E731, B023
        a, b = one(), one()
        rows.append((k, a, b))
        want[k] = 1 - sum(abs(x - y) for x, y in zip(fit(a, canvas), fit(b, canvas), strict=True)) / (255 * 72)
    odd = [(None, (1, 1, [0])), ((1, 1, [0]), None), ((0, 0, []), (1, 1, [0])), ((2, 2, [0] * 3), (1, 1, [0])), ((1, 1, [None]), (1, 1, [0])), ((1, 1, None), (1, 1, [0])), ((None, 1, [0]), (1, 1, [0])), (None, None)]
    rows += [(1000 + k, a, b) for k, (a, b) in enumerate(odd)]
    df = spark.createDataFrame(rows, f"k int, a {RASTER}, b {RASTER}")
    got = {r.k: r.s for r in df.select("k", visual.canvas_similarity(visual.placed(F.col("a"), (12, 6)), visual.placed(F.col("b"), (12, 6)), (12, 6)).alias("s")).collect()}
    assert all(got[1000 + k] is None for k in range(len(odd)))
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_similarity_of_arrays(spark):
    rows = [(1, [0, 255], [0, 255]), (2, [0, 0], [255, 255]), (3, [1, 2], [1]), (4, None, [1]), (5, [], []), (6, [None], [1]), (7, [1], None)]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    assert {r.k: r.s for r in df.select("k", visual.similarity(F.col("a"), F.col("b")).alias("s")).collect()} == {1: 1.0, 2: 0.0, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert sorted(map(tuple, visual.difference_histogram(df, ["k"]).collect())) == [(1, 0, 2), (2, 255, 2)]


def test_a_missing_preview_wins_nothing(spark):
    c = spark.createDataFrame([("f", 1, "valid", None, "h1"), ("f", 2, "valid", None, "h2"), ("f", 3, "invalid", None, "h1"), ("f", 4, "valid", 0.5, "h1"), ("g", 1, "valid", None, "h1"), ("h", 1, "valid", None, None)], "id string, idx int, validation_status string, visual_score double, latex_hash string")
    r = spark.createDataFrame([("f", 1, 1, [0]), ("h", 1, 1, [0])], "id string, width int, height int, pixels array<int>")
    p = spark.createDataFrame([("h1", 1, 1, [0])], "latex_hash string, width int, height int, pixels array<int>")
    got = {(x.id, x.idx): x.visual_score for x in visual.score_candidates(c, r, p, ["id"]).collect()}
    assert got == {("f", 1): 1.0, ("f", 2): None, ("f", 3): None, ("f", 4): 0.5, ("g", 1): None, ("h", 1): None}


def test_pairs_are_dealt_out_before_they_are_compared(spark):
    c = spark.range(4).selectExpr("cast(id as string) as id", "1 as idx", "'valid' as validation_status", "cast(null as double) as visual_score", "'h' as latex_hash")
    r, p = spark.range(4).selectExpr("cast(id as string) as id", "1 as width", "1 as height", "array(0) as pixels"), spark.range(1).selectExpr("'h' as latex_hash", "1 as width", "1 as height", "array(255) as pixels")
    scored = visual.score_candidates(c, r, p, ["id"])
    assert scored._jdf.queryExecution().executedPlan().toString().count(f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM") == 2
    assert [x.visual_score for x in scored.collect()] == [round(1 - 255 / (255 * 160 * 80), 4)] * 4


FORM = "id string, selected_latex string, selected_source string, selected_candidate_key string, validation_status string, validation_error string"


def test_a_chosen_candidate_is_taken_whole(spark):
    f = spark.createDataFrame([(i, "old", "tex", "k0", "valid", "old error") for i in "abc"], FORM)
    c = spark.createDataFrame([("a", "k1", "pix2tex", None, "error"), ("b", "k1", "pix2tex", "x", None)], "id string, candidate_key string, source string, latex string, validation_status string")
    asked = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k9")], "id string, candidate_key string")
    rows = {r.id: tuple(r)[1:] for r in select.choose(f, c, asked, ["id"]).collect()}
    assert rows["a"] == (None, "pix2tex", "k1", "error", None, None)
    assert rows["b"] == ("x", "pix2tex", "k1", "pending", None, None)
    assert rows["c"] == ("old", "tex", "k0", "valid", "old error", "candidate not found: k9")


def test_manual_text_is_compiled_before_it_is_selected(spark):
    f = spark.createDataFrame([(i, None, None, None, "pending", None) for i in "abc"], FORM)
    c = spark.createDataFrame([("a", 1, "manual", "manual", "m", "valid", "manual:manual:1")], "id string, idx int, source string, variant string, latex string, validation_status string, candidate_key string")
    typed = spark.createDataFrame([("a", " x^{2} "), ("b", "x^{"), ("b", "y")], "id string, latex string")
    chosen, both = validate.compile_and_choose(f, c, typed, ["id"])
    rows = {r.id: tuple(r)[1:6] for r in chosen.collect()}
    assert rows["a"] == ("x^{2}", "manual", "manual:manual:2", "valid", None)
    assert rows["b"] == ("y", "manual", "manual:manual:2", "valid", None) and rows["c"] == (None, None, None, "pending", None)
    assert sorted((r.id, r.idx, r.validation_status) for r in both.collect()) == [("a", 1, "valid"), ("a", 2, "valid"), ("b", 1, "invalid"), ("b", 2, "valid")]


def test_what_was_typed_is_selected_among_the_new(spark):
    """The first of two manual candidates is gone: the new one gets the key of the other, and is the one that is meant."""
    f = spark.createDataFrame([("a", None, None, None, "pending", None)], FORM)
    c = spark.createDataFrame([("a", 1, "manual", "manual", "old", "valid", "manual:manual:2")], "id string, idx int, source string, variant string, latex string, validation_status string, candidate_key string")
    chosen, both = validate.compile_and_choose(f, c, spark.createDataFrame([("a", "new")], "id string, latex string"), ["id"])
    assert [(r.id, r.selected_latex) for r in chosen.collect()] == [("a", "new")] and both.count() == 2


def test_references_against_real_files(spark, tmp_path):
    (tmp_path / "md" / "m").mkdir(parents=True)
    (tmp_path / "m").mkdir()
    for n in ("md/m/a.wmf", "m/a.wmf", "m/b c.wmf"):
        (tmp_path / n).write_bytes(b"x")
    files = resolve.list_files(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == sorted(f"{tmp_path}/{n}" for n in ("md/m/a.wmf", "m/a.wmf", "m/b c.wmf"))
    refs = ["m/a.wmf", " 'm/b c.wmf' ", "../m/a.wmf", "none.wmf", "/x/../y.wmf", None, ""]
    df = spark.createDataFrame(list(enumerate(refs)), "k int, dest string")
    got = {r.k: (r.resolved, r.found_in) for r in resolve.resolve(df, files, ["k"], markdown_dir=f"{tmp_path}/md/", workdir=str(tmp_path)).collect()}
    t = str(tmp_path)
    assert got == {0: (f"{t}/md/m/a.wmf", "markdown"), 1: (f"{t}/m/b c.wmf", "workdir"), 2: (f"{t}/m/a.wmf", "markdown"), 3: (f"{t}/md/none.wmf", "nowhere"), 4: ("/x/../y.wmf", "absolute"), 5: (None, None), 6: (f"{t}/md", "nowhere")}


@pytest.mark.parametrize("query", ["alpha", "ALPHA", "aa", "", "x_{1}", "né😀e", "zzz", "alphaalpha"])
def test_search_equals_contains(spark, query):
    known = spark.createDataFrame([(1, "f1 alpha"), (2, "f2 alphabet x_{1}"), (3, "f3 né😀e"), (4, "al pha"), (5, ""), (6, "aaaa")], "k int, text string")
    got = sorted(r.k for r in search.search(search.postings(known, ["k"]), known, ["k"], query).collect())
    assert got == [r.k for r in known.collect() if query.lower() in r.text]


def test_candidates_are_dealt_once(spark, sf):
    """What groups candidates by formula needs no exchange beside the one that numbers them."""
    lists = corpus.candidates(spark, sf).groupBy("formula_id").agg(F.max("latex"))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_postings_are_few_and_whole(spark):
    texts = ["formula source original %03d é" % (k * 7 % 500) if k % 9 else None for k in range(200)] + ["x" * 5000 + "end"]
    known = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    posted = search.postings(known, ["k"]).cache()
    rows = posted.count()
    assert rows < sum(len({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts if t) / 5  # a row for each gram of each text before
    for query in ("formula", "l 07", "77 é", "xxx", "xend", "none", " é"):
        assert sorted(r.k for r in search.search(posted, known, ["k"], query).collect()) == [k for k, t in enumerate(texts) if t and query in t]
    posted.unpersist()


def test_pages_are_escaped_and_linked(spark):
    rows = spark.createDataFrame([(1, "f2", "valid", "a < b", None, 1), (1, "f1", "invalid", None, None, 0)], "doc_id int, formula_id string, row_class string, selected_latex string, selected_preview string, n_candidates int")
    c = spark.createDataFrame([("f2", 2, "p", {"tex": "/w/r/t 'x'.tex"}), ("f2", 1, "p", {"png": "/w/png/a.png", "none": None})], "formula_id string, idx int, source string, artifacts map<string,string>")
    page = audit.report_pages(audit.report_html(rows, audit.artifact_links(c, ["formula_id"], "/w/r"), ["formula_id"]), ["doc_id"], "formula_id").first().page
    assert page.splitlines()[1:3] == ["<tr class='invalid'><td>f1</td><td><pre></pre></td><td></td></tr>", "<tr class='valid'><td>f2</td><td><pre>a &lt; b</pre></td><td><a href='png/a.png'>p png</a> <a href='t &#39;x&#39;.tex'>p tex</a></td></tr>"]
