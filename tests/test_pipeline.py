"""Selection, planning, engines, validation cache, overrides, settings and streams."""

from copy import deepcopy

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mathlake import config
from mathlake.cluster import materialise
from mathlake.operators import audit, merge, ocr, select, validate
from mathlake.plans import pipeline
from mathlake.streaming import attempts

CAND = "formula_id string, idx long, source string, variant string, latex string, validation_status string, visual_score double"
FORM = "formula_id string, selected_latex string, selected_source string, selected_candidate_key string, validation_status string"


def winners(spark, formulas, candidates, force=False, **selection):
    s = deepcopy(config.DEFAULTS)
    s["candidate_selection"] |= selection
    out = select.select_candidates(spark.createDataFrame(formulas, FORM), spark.createDataFrame(candidates, CAND), s, ["formula_id"], force)
    return {r.formula_id: (r.selected_source, r.selected_latex, r.validation_status, r.chosen_by) for r in out.collect()}


NEW = lambda i: (i, None, None, None, "pending")


def test_priority_and_visual(spark):
    c = [("a", 1, "ollama_qwen", "original", "o", "valid", None), ("a", 2, "pix2tex", "original", "p", "valid", None), ("a", 3, "texteller", "original", "", "invalid", None)]
    c += [("b", 1, "pix2tex", "original", "dark", "valid", 0.1), ("b", 2, "texteller", "original", "good", "valid", 1.0)]
    c += [("c", 1, "texteller", "original", "t", "valid", 0.69), ("c", 2, "pix2tex", "original", "p", "valid", 0.2)]
    got = winners(spark, [NEW(i) for i in "abcd"], c)
    assert got["a"][:2] == ("pix2tex", "p") and got["b"][:2] == ("texteller", "good")
    assert got["c"] == ("pix2tex", "p", "valid", "priority")
    assert got["d"] == (None, None, "invalid", "none")


def test_ties_go_to_list_order_and_threshold_counts(spark):
    c = [("a", 2, "pix2tex", "original", "second", "valid", 0.7), ("a", 1, "pix2tex", "original", "first", "valid", 0.7)]
    assert winners(spark, [NEW("a")], c)["a"] == ("pix2tex", "first", "valid", "visual")


def test_manual_stays_unless_forced_and_old_latex_survives(spark):
    c = [("m", 1, "pix2tex", "original", "p", "valid", 0.9)]
    f = [("m", "mine", "manual", "manual:manual:1", "valid"), ("o", "old", "pix2tex", "pix2tex:original:1", "valid")]
    kept = winners(spark, f, c)
    assert kept["m"][:2] == ("manual", "mine") and kept["o"] == ("pix2tex", "old", "invalid", "none")
    forced = winners(spark, f, c, force=True)
    assert forced["m"][:2] == ("pix2tex", "p") and forced["o"][1] is None


def test_empty_candidates(spark):
    assert winners(spark, [NEW("a")], [])["a"][3] == "none"


def test_id_range(spark):
    f = spark.createDataFrame([(f"f{i:04d}", i) for i in range(1, 6)], "id string, seq int")
    assert [r.id for r in select.id_range(f, first="f0002", last="f0004", limit=2).orderBy("seq").collect()] == ["f0002", "f0003"]
    assert select.id_range(f, first="", only="f0005").count() == 1
    with pytest.raises(ValueError):
        select.id_range(f, limit=-1)


def shout(rows: pd.DataFrame) -> pd.Series:
    if "bad" in rows["png_path"].iloc[0]:
        raise RuntimeError("no")
    return rows["png_path"].map(lambda p: f"\\( {p} \\)")


def test_engine_failures_are_rows_and_second_run_has_nothing_to_do(spark):
    f = spark.createDataFrame([("a", "x_1"), ("b", "bad"), ("c", "")], "formula_id string, png_path string")
    todo = ocr.tasks(f, ["pix2tex"], ["original", " "])
    out = ocr.run_engines(todo, {"pix2tex": shout}, ["formula_id"]).cache()
    got = {r.formula_id: (r.latex, r.validation_status, r.validation_error) for r in out.collect()}
    assert got["a"] == ("x_1", "pending", None) and got["b"] == ("", "error", "RuntimeError: no") and got["c"][1] == "error"
    assert sorted(r.formula_id for r in ocr.pending(todo, out, ["formula_id"]).collect()) == ["b", "c"]


def test_validation_is_cached_by_content(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(bodies):
        seen.add(len(bodies))
        return validate.structural(bodies)

    c = spark.createDataFrame([("a", 1, "x", "pending", None), ("a", 2, "x", "pending", None), ("b", 1, "y", "pending", None), ("b", 2, "x^{", "pending", None)], "id string, idx int, latex string, validation_status string, latex_hash string")
    out, known = validate.validate(c, ["id"], counting)
    out, known = out.cache(), known.cache()
    rows = {(r.id, r.idx): r.validation_status for r in out.collect()}
    assert rows == {("a", 1): "valid", ("a", 2): "valid", ("b", 1): "valid", ("b", 2): "invalid"}
    assert known.count() == 3
    before = seen.value
    again, _ = validate.validate(c, ["id"], counting, cache=known)
    again.collect()
    assert seen.value == before
    settled, _ = validate.validate(out, ["id"], counting)
    settled.collect()
    assert seen.value == before


def test_audit_finds_what_fails(spark):
    f = spark.createDataFrame([(1, "a", "x", "p", "k1", "valid"), (1, "b", " ", "manual", None, "invalid"), (2, "c", "y", "p", "k2", "valid")], "doc_id long, formula_id string, selected_latex string, selected_source string, selected_candidate_key string, validation_status string")
    c = spark.createDataFrame([("a", 1, "k1", "invalid", "h", None), ("c", 1, "k2", "valid", "now", "p.png")], "formula_id string, idx int, candidate_key string, validation_status string, latex_hash string, preview_png string")
    rows = {r.doc_id: r for r in audit.audit(f, c, audit.stale_candidates(c, ["formula_id"], F.lit("now"))).collect()}
    assert rows[1].status == "failed" and rows[1].unresolved_ids == ["b"] and rows[1].stale_candidates == 1 and rows[1].selected_failing == 1 and rows[1].selected_without_preview == 2
    assert rows[2].status == "ok"


def test_artifact_names_carry_twelve_digits(spark):
    c = spark.createDataFrame([("a", 1, "0123456789abcdef" * 4, "candidate_p_1_0123456789ab")], "formula_id string, idx int, latex_hash string, tex string")
    assert audit.stale_candidates(c, ["formula_id"], F.col("latex_hash"), F.col("tex")).isEmpty()
    assert audit.stale_candidates(c, ["formula_id"], F.col("latex_hash"), F.col("tex"), compat=True).count() == 1


def name_engine(rows: pd.DataFrame) -> pd.Series:
    return rows["png_path"].str.extract(r"(\d+)\.png")[0].map(lambda n: f"```latex\nx_{{{int(n)}}}\n```")


def test_full_run(spark):
    docs = spark.createDataFrame([(1, "a ![](m/a.wmf) b\n\n![](m/b.emf)\n"), (2, "no formula"), (3, None)], "doc_id long, markdown string")
    out = pipeline.full(docs, {"pix2tex": name_engine}, config.DEFAULTS)
    assert {r.doc_id: r.merged for r in out["merged"].collect()} == {1: "a \\(x_{1}\\) b\n\n\\[\nx_{2}\n\\]\n", 2: "no formula", 3: None}
    assert out["issues"].isEmpty()
    assert [tuple(r) for r in out["summary"].collect()] == [(1, 2, 2, 0, [])]


def test_a_whole_run_parses_its_texts_once(spark, monkeypatch):
    seen, parse = [], merge.images
    monkeypatch.setattr(merge, "images", lambda docs, *a, **k: seen.append(docs.columns) or parse(docs, *a, **k))
    docs = spark.createDataFrame([(1, "a ![](m/a.wmf) b\n\n![](m/b.emf)\n")], "doc_id long, markdown string")
    out = pipeline.full(docs, {"pix2tex": name_engine}, config.DEFAULTS)
    assert out["merged"].first().merged == "a \\(x_{1}\\) b\n\n\\[\nx_{2}\n\\]\n"
    assert len(seen) == 1  # the merged text, for what is left in it


def test_what_grows_is_not_broadcast(spark):
    """Small compressed files are read as large tables: rows for each formula are never sent whole to every executor."""
    c = materialise(spark.range(9).selectExpr("id as doc_id", "'f' as id", "1 as idx", "'p' as source", "'o' as variant", "'x' as raw", "'x' as latex", "'valid' as validation_status", "cast(null as double) as visual_score"), "test-candidates")
    f = materialise(spark.range(9).selectExpr("id as doc_id", "'f' as id", "'' as selected_latex", "'' as selected_source", "'' as selected_candidate_key", "'pending' as validation_status"), "test-formulas")
    docs = materialise(spark.range(9).selectExpr("id as doc_id", "'abc' as markdown"), "test-docs")
    spans = materialise(spark.range(9).selectExpr("id as doc_id", "0 as start", "1 as end", "'y' as text"), "test-spans")
    keys = ["doc_id", "id"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (validate.with_repairs(c, keys), select.select_candidates(f, c, config.DEFAULTS, keys), merge.rewrite(docs, spans, ["doc_id"])):
        assert "Join" in plan(df) and "BroadcastHashJoin" not in plan(df)
    assert "ShuffledHashJoin" in plan(merge.rewrite(docs, spans, ["doc_id"]))  # no text is sorted


def test_overlay_and_header():
    c = config.overlay(config.DEFAULTS, {"latex": {"mainfont": "X"}, "candidate_selection": {"priority": ["a"]}})
    assert c["latex"]["mainfont"] == "X" and c["latex"]["engine"] == "xelatex" and c["candidate_selection"]["priority"] == ["a"]
    assert config.DEFAULTS["latex"]["mainfont"] == "Times New Roman"
    h = config.header(c)
    assert "polyglossia" in h and "babel" not in h and h.index("amsmath") < h.index("mathtools")
    with pytest.raises(config.ConfigError):
        config.header(config.overlay(c, {"latex": {"use_babel": True}}))
    babel = config.overlay(c, {"latex": {"use_polyglossia": False, "use_babel": True}})
    assert "[english,main=russian]{babel}" in config.header(babel)
    assert [v.split("=")[0] for v in config.converter_variables(c)] == ["documentclass", "fontsize"]
    assert len(config.converter_variables(babel)) == 6


def test_settings_file_with_mark(tmp_path):
    (tmp_path / "c.yaml").write_bytes(b"\xef\xbb\xbfocr:\n  engines: [texteller]\n")
    assert config.load(str(tmp_path / "c.yaml"))["ocr"] == {"engines": ["texteller"], "max_workers": 1}
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))


def test_only_local_addresses():
    assert config.require_local("http://localhost:11434")
    with pytest.raises(config.ConfigError):
        config.require_local("http://example.org")
    assert config.command_for("run '{image}' --x", "a b.png") == ["run", "a b.png", "--x"]


def test_attempt_stream(spark, tmp_path):
    src, root, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spec = spark.createDataFrame([], "formula_id string, status string, started_at timestamp").schema
    table = "formula_id string, status string, started_at timestamp, n_attempts long"

    def batch(*r):
        spark.createDataFrame(r, "formula_id string, status string, at string").select("formula_id", "status", F.to_timestamp("at").alias("started_at")).write.mode("append").parquet(src)
        q = attempts.keep_latest(attempts.read(spark, src, spec), root, ["formula_id"], ck, ranges=8).trigger(availableNow=True).start()  # a new query each time: a restart
        q.awaitTermination(120)
        assert q.exception() is None
        return attempts.versions(spark, root)

    first = batch(*((f"k{i}", "running", "2024-01-01 00:00:00") for i in range(40)), ("a", "running", "2024-01-01 00:00:00"))
    assert len(first) == 8 and set(first.values()) == {0}
    second = batch(("a", "done", "2024-01-01 00:10:00"), ("a", "late", "2023-01-01 00:00:00"))
    assert sorted(second.values()) == [0] * 7 + [1]  # one key, one range
    got = {r.formula_id: (r.status, r.n_attempts) for r in attempts.current(spark, root, table).collect()}
    assert got == {"a": ("done", 3)} | {f"k{i}": ("running", 1) for i in range(40)}
    batch(("a", "again", "2024-01-02 00:00:00"))
    kept = sorted(p.parent.name + "/" + p.name for p in (tmp_path / "out" / "data").glob("*/range=*"))
    (mine,) = (r for r, b in second.items() if b == 1)
    assert f"0/range={mine}" not in kept and f"1/range={mine}" in kept and f"2/range={mine}" in kept
    got = {r.formula_id: (r.status, r.n_attempts) for r in attempts.current(spark, root, table).collect()}
    assert got["a"] == ("again", 4) and len(got) == 41
    counts = attempts.status_counts(attempts.read(spark, src, spec), "started_at", "status")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from counts").first()[0] == 44
