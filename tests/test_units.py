"""Literal cases of parsers, matching, alignment, splits, sources and streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import jsonparse as J
from tessera.functions import logits as L
from tessera.functions import modelparse as M
from tessera.functions import text as T
from tessera.operators import align, match, metrics, series, split
from tessera.plans import pipeline as P
from tessera.schemas import ELEMENTS, LABEL
from tessera.sources import config, io, sidecars
from tessera.streaming import ledger


def el(text, box, focused=False):
    return {"text": text, "bbox_norm": box, "focused": focused}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


OK = json.dumps({"elements": [el("Save", [1, 2, 30, 40])], "coordinate_system": "normalized_0_1000"})


def test_parse_plain_fenced_quoted_and_embedded():
    for raw in (OK, f"```json\n{OK}\n```", OK.replace('"', "“"), f"Sure: {OK} done", OK.replace(": ", "：")):
        p = J.parse_answer(raw)
        assert p["parse_ok"] and p["usable"] and not p["salvaged"], raw
        assert p["elements"] == [el("Save", [1, 2, 30, 40])]


def test_parse_cut_off():
    two = json.dumps({"elements": [el("a", [1, 2, 3, 4]), el("b", [5, 6, 7, 8])]})
    p = J.parse_answer(two[: two.index('"b"') + 8])
    assert p["salvage_reason"] == "truncated_tail_element_dropped" and p["element_count"] == 1 and p["parse_ok"]
    damaged = two.replace("}, {", "} x {")[:-2]
    assert J.parse_answer(damaged)["salvage_reason"] == "truncated_elements_recovered"
    assert not J.parse_answer('{"elements": [{"text": "a", "bb')["usable"]


def test_parse_rejects():
    bad = {"elements": [el("ok", [1, 2, 3, 4]), el("zero", [1, 2, 1, 4]), {"text": "no box"}, el("", [1, 2, 3, 4]), "x", el("f", [1.5, 2, 3, 4]), el("t", [True, 2, 3, 4]), el("b", [1, 2, 3, 4], "yes"), el("w", [1.0, 2.0, 3.0, 4.0])]}
    p = J.parse_answer(json.dumps(bad))
    assert [e["text"] for e in p["elements"]] == ["ok", "w"] and len(p["parse_errors"]) == 7 and p["usable"] and not p["parse_ok"]
    assert "bbox_norm is required" in p["parse_errors"]
    assert J.parse_answer(json.dumps({"elements": [el("bbox_norm", [1, 2, 3, 4])]}))["parse_error"] == "No usable elements remained after normalization."
    assert J.parse_answer("[]")["parse_error"] == "Parsed JSON must be an object."
    assert J.parse_answer("")["parse_error"] == "Empty raw text." and J.parse_answer(None)["usable"] is False
    p = J.parse_answer(json.dumps({"elements": [el("a", [1, 2, 3, 4])], "coordinate_system": "pixel"}))
    assert p["usable"] and not p["parse_ok"] and p["coordinate_system"] is None


def test_serialised_label_is_the_same_on_both_sides(spark):
    es = [el('a "quoted" \\ é', [1, 2, 3, 4], True)]
    df = spark.createDataFrame([(es,)], f"elements {ELEMENTS}")
    assert df.select(J.serialized(F.col("elements"))).first()[0] == J.serialize_label(es)


def test_model_output():
    assert M.parse_output('{"e":[["a",1,2,3,4],["b",[5,6,7,8]],["c"]]}')["elements"][1]["bbox"] == [5, 6, 7, 8]
    r = M.parse_output('{"e":[["a",1,2,3,4]]')
    assert r["parse_repair"] == "appended_missing_top_level_closing_brace" and len(r["elements"]) == 1
    assert M.parse_output("")["parse_error"] == "empty_output" and M.parse_output("none")["parse_error"] == "could_not_find_json_payload"
    assert M.parse_output('{"elements":[1]}')["parse_error"] == "all_elements_invalid_after_normalization"
    assert M.parse_output('x [{"name":"a","bbox":"9,8,3,4","confidence":2}] y')["elements"] == [{"element_index": 0, "name": "a", "type": None, "bbox": [3, 4, 9, 8], "confidence": None}]
    assert M.first_expected('note {"k":1} {"objects":[1]}') == {"objects": [1]}
    with pytest.raises(ValueError, match="truncated"):
        M.first_expected('{"elements": [1, 2')


def test_no_answer_breaks_a_parser(spark):
    deep = ["[" * 100_000, '{"a":' * 100_000, '{"elements":[' * 5_000, "{" * 50_000, '["' * 50_000, "1" * 5_000, '{"elements":[{"text":"a","bbox_norm":[' + "9" * 5_000 + ",1,2,3]}]}"]
    lone = ['{"elements":[{"text":"\\ud800x","name":"\\ud800x","bbox_norm":[1,2,3,4],"bbox":[1,2,3,4]}]}', '{"elements":["\\udc00"]}', '{"e":[["\\ud83d",1,2,3,4]]}', "\ufffd{"]
    df = spark.createDataFrame([(t,) for t in (*deep, *lone, None, "")], "raw string")
    rows = J.ordered_lenient_labels(M.parse_outputs(J.parse_answers(df, "raw", "a"), "raw", "m"), "raw", "l").collect()
    assert not any(r.a.usable or r.m.elements for r in rows[: len(deep)])
    assert rows[len(deep)].a.elements[0].text == "\ufffdx" == rows[len(deep)].m.elements[0].name


def test_outermost_values():
    assert list(J.outermost('a "b{" {"x":"}"} [1] ]')) == [(7, 16, False), (17, 20, False)]
    assert list(J.outermost('{"a":[1}')) == [(0, None, False)] and list(J.outermost('x [1, {"b":2}')) == [(2, None, True)]
    assert M.first_expected('x [1,"}"] {"elements":[]}') == {"elements": [1, "}"]}
    assert M.first_expected('{"elements":[{"bbox":1,2,3,4,"t":1}]}') == {"elements": [{"bbox": [1, 2, 3, 4], "t": 1}], "json_repaired": True, "repair_notes": ["both brackets: 1"]}
    for text in ("nothing", '{"k":1}', '{"a":[1,2} x', "{'a':1}"):
        with pytest.raises(ValueError, match="no valid"):
            M.first_expected(text)


def test_repairs_are_the_same_on_both_sides(spark):
    for text in ('{"bbox":1,2,3,4,"t":1}', '{"box=1,2,3,4],"t":1}', '{"bbox":1,2,3,4 ]}', '{"bbox_2d":[1,2,3,4,"t":1}', "{}"):
        new, kinds = J.repaired(text)
        assert (new, len(kinds)) == tuple(spark.range(1).select(J.repair_boxes(F.lit(text)), J.repair_notes(F.lit(text))).first())


def test_small_steps(spark):
    assert value(spark, T.identity_path(F.lit("../a/./b/../c.png"), "/r")) == "/a/c.png" and value(spark, T.utc_now()).endswith("Z")
    with pytest.raises(Exception, match="non-empty"):
        value(spark, T.identity_path(F.lit(" ")))
    assert value(spark, L.spliced(F.array(F.lit(1), F.lit(2)), F.lit(1), F.array(F.lit(8), F.lit(9)))) == [1, 8, 9]
    assert [value(spark, L.accumulation_scale(F.lit(n), 4)) for n in (0, 1, 4, 6)] == [1.0, 4.0, 1.0, 2.0]
    assert config.task_of("x/Parsing_kd.yaml") == config.task_of("a.yaml", " PARSING ") == "parsing"
    with pytest.raises(ValueError):
        config.task_of("x/other.yaml")
    with pytest.raises(Exception, match="elements"):
        metrics.legacy_evaluation(spark.createDataFrame([("parsing", "x")], "task string, text string")).collect()
    rows = spark.createDataFrame([("parsing", [el("a", [1, 2, 3, 4])], "x"), ("parsing", [], "y"), ("vqa", [el("a", [1, 2, 3, 4])], None)], f"task string, elements {ELEMENTS}, answer string")
    assert [r.v for r in rows.select(P.existing_answer(rows).alias("v")).collect()] == [J.serialize_label([el("a", [1, 2, 3, 4])]), "y", None]
    assert value(spark, P.retry_prompt(F.lit("q"))).endswith("\n\nq") and value(spark, P.canonical_text(F.lit(" <|x|>a\r\nb "))) == "a\nb"
    config.ensure_distinct("a", "b")
    with pytest.raises(ValueError):
        config.ensure_distinct("a/../b", "b")


def test_metadata_of_a_manifest(spark):
    rows = spark.createDataFrame([("1", "a.png", "parsing", {"k": "old", "m": "x"}, "new"), ("2", "b.png", "parsing", None, None)], "id string, image string, task string, metadata map<string,string>, k string")
    got = P.projected(rows, spark.createDataFrame([("a.png",), ("a.png",)], "path string")).orderBy("id").collect()
    assert [(r.metadata, r.reason) for r in got] == [({"k": "new", "m": "x"}, None), ({}, "image not found")]


def matched(spark, p, r):
    df = spark.createDataFrame([(p, r)], f"p {ELEMENTS}, r {ELEMENTS}")
    return df.select(match.greedy(match.usable(F.col("p")), match.usable(F.col("r"))).alias("m")).first().m


def test_greedy_matching(spark):
    assert matched(spark, [el(" SAVE  as", [0, 0, 10, 10])], [el("save as", [0, 0, 10, 10])]).asDict() == {"tp": 1, "iou_sum": 1.0, "boxes": 1}
    assert matched(spark, [], []).tp == 0
    # of two equal texts each takes its best partner, whatever the order
    m = matched(spark, [el("x", [0, 0, 10, 10]), el("x", [100, 100, 110, 110])], [el("x", [100, 100, 110, 110]), el("x", [0, 0, 10, 10])])
    assert (m.tp, m.iou_sum) == (2, 2.0)
    # an invalid box matches by text, with overlap 0
    m = matched(spark, [el("x", [5, 5, 5, 9])], [el("x", [0, 0, 10, 10])])
    assert (m.tp, m.iou_sum, m.boxes) == (1, 0.0, 0)


def rows(spark, data):
    return spark.createDataFrame([(i, f"{i}.png", "parsing", "", es, "normalized_0_1000", n) for n, (i, es) in enumerate(data)], LABEL + ", _ord long")


def test_evaluation_end_to_end(spark):
    box = [0, 0, 10, 10]
    pred = rows(spark, [("a", [el("x", box), el("y", box)]), ("b", []), ("a", [el("z", box)])])
    ref = rows(spark, [("a", [el("x", box)]), ("c", [el("q", box)])])
    s = metrics.score_samples(pred, ref)
    by = {r.key: r for r in s.collect()}
    assert (by["a"].element_tp, by["a"].element_fp, by["a"].element_fn, by["a"].pred_repeats) == (1, 1, 0, 1)
    assert by["b"].element_precision == 0.0 or by["b"].missing_reference
    assert by["c"].missing_prediction and by["c"].element_fn == 1
    m = metrics.aggregate_samples(s).first()
    assert (m.element_tp, m.element_fp, m.element_fn) == (1, 1, 1) and m.element_precision == 0.5
    assert metrics.evaluate(pred.limit(0), ref.limit(0)).first().element_precision == 1.0
    summary = metrics.evaluate_experiments({"one": pred, "two": ref}, ref).collect()
    assert [r.experiment for r in summary] == ["reference", "one", "two"] and summary[2].element_precision == 1.0


def test_row_key_falls_back_to_the_image(spark):
    df = spark.createDataFrame([(" 7 ", "x"), ("", "./a\\b//c.png"), (None, "/a/b/c.png")], "id string, image string")
    assert [(r.key_kind, r.key) for r in align.row_key(df).collect()] == [("id", "7"), ("image", "a/b/c.png"), ("image", "a/b/c.png")]


def test_merge_keeps_explicit_nulls(spark):
    a = spark.createDataFrame([("1", "x", 1)], "id string, v string, _ord int")
    b = spark.createDataFrame([("1", None, 0, "w")], "id string, v string, _ord int, other string")
    assert align.merge_by_id([a, b]).first().asDict() == {"id": "1", "v": None, "other": "w"}


def test_positions_are_global(spark):
    df = spark.range(5000).select(F.concat(F.lit("p/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"))
    got = [(r.image, r.id) for r in align.numbered_manifest(df).orderBy("image").collect()]
    assert [i for _, i in got] == [f"parsing-{n:06d}" for n in range(1, 5001)]
    assert align.numbered_manifest(df.limit(0)).count() == 0


def test_similarity_match(spark):
    rows = value(spark, match.by_similarity(F.array(F.lit("File menu"), F.lit("Open")), F.array(F.lit("open file"), F.lit("file menu"), F.lit("zzz")), 0.6))
    assert [(r.ref, r.best, r.matched) for r in rows] == [("File menu", "file menu", True), ("Open", "open file", True)]


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(T.normalize(F.lit(" A 　b\x1cC "))) == "a b c"
    assert v(T.token_f1(F.lit("a b b"), F.lit("b b c"))) == pytest.approx(2 / 3)
    assert v(T.token_f1(F.lit(""), F.lit(""))) == 1.0 and v(T.token_f1(F.lit(""), F.lit("a"))) == 0.0
    assert v(T.name_similarity(F.lit("App-Store!"), F.lit("app store"))) == 1.0
    assert v(T.name_similarity(F.lit("store"), F.lit("app store"))) == 0.9 and v(T.name_similarity(F.lit("!"), F.lit("a"))) == 0.0
    assert v(T.looks_degenerate(F.lit("!!!! ??"))) and not v(T.looks_degenerate(F.lit("hello")))
    assert v(T.object_lines(F.lit("Objects: x\n- One\n2. Two\n* one\n{\na|b\n"))) == ["One", "Two"]
    names = ["a10.png", "A2.png", "a1.png", "b.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["a1.png", "A2.png", "a10.png", "b.png"]
    long = v(T.draw_label(F.lit(3), F.lit("x" * 300), F.lit(""), F.lit(True)))
    assert len(long) == 160 and long.endswith("…")


def test_geometry(spark):
    box = lambda *b: F.array(*[F.lit(x) for x in b])
    assert value(spark, G.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert value(spark, G.iou(F.lit(None).cast("array<int>"), box(0, 0, 1, 1))) == 0.0
    assert value(spark, G.to_pixels(box(1000, 1000, 0, 0), F.lit(100), F.lit(50))) == [0, 0, 99, 49]
    assert value(spark, G.to_pixels(box(5, 15, 25, 35), F.lit(100), F.lit(100))) == [0, 2, 2, 4]
    assert value(spark, G.pair_metrics(box(0, 0, 0, 1), box(0, 0, 1, 1))).iou is None


def test_logits(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert [(e.idx, e.val) for e in value(spark, L.top_k(a(1, 3, 3, 2), 2))] == [(1, 3.0), (2, 3.0)]
    assert value(spark, L.pairwise_differences(a(5, 3, 1))) == [2.0, 4.0, 2.0]
    assert value(spark, L.divergence(a(1, 2, 3), a(1, 2, 3), 2.0)) == pytest.approx(0.0)
    assert value(spark, L.divergence(a(0, 0), a(0, 1), 1.0)) > 0
    assert value(spark, L.first_mismatch(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))) == 1
    assert value(spark, L.early_stop(a(1.0, 0.9, 0.95, 0.93, 0.5), 2, 0.0)).stopped_at == 4
    assert value(spark, L.context_window(F.sequence(F.lit(0), F.lit(20)), F.lit(2), 3)) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        L.pairwise_divergence(a(1), a(1), 1)


def test_seeded_split_is_the_shuffle(spark):
    df = rows(spark, [(f"id{n}", []) for n in range(20)]).withColumn("source_image", F.lit("s"))
    t, v = split.seeded_split(df, 0.15, 7)
    order = sorted((f"id{n}" for n in range(20)), key=lambda i: f"{i}.png")
    random.Random(7).shuffle(order)
    assert {r.id for r in v.collect()} == set(order[:3]) and {r.id for r in t.collect()} == set(order[3:])
    assert "source_image" not in t.columns
    m = split.metadata(t, v, 0.15, 7)
    assert split.verify(m, t, v) == [] and "validation_count" in split.verify(m | {"validation_count": 9}, t, v)
    assert [split.validation_count(n, r) for n, r in ((1, 0.5), (2, 0.9), (5, 0.5), (100, 0.1))] == [1, 1, 2, 10]
    with pytest.raises(ValueError):
        split.seeded_split(df.union(df), 0.15, 7)


def test_versioned_write(spark, tmp_path):
    for n in (1, 2):
        split.write_version(spark, str(tmp_path), f"v{n}", a=spark.range(n))
    assert split.read_version(spark, str(tmp_path), "a").count() == 2


def test_jsonl_round_trip(spark, tmp_path):
    df = rows(spark, [("é", [el("x", [1, 2, 3, 4])]), ("b", None)])
    io.write_jsonl(df, f"{tmp_path}/out")
    with open(tmp_path / "in.jsonl", "w", encoding="utf-8-sig") as f:
        for name in sorted(os.listdir(tmp_path / "out")):
            if name.startswith("part"):
                f.write((tmp_path / "out" / name).read_text(encoding="utf-8") + "\n\n")
    back = io.read_jsonl(spark, f"{tmp_path}/in.jsonl").orderBy("_ord").drop("_ord").collect()
    assert sorted(r.id for r in back) == ["b", "é"] and [r for r in back if r.id == "é"][0].elements[0].text == "x"
    assert io.read_jsonl(spark, f"{tmp_path}/in.jsonl", max_samples=1).count() == 1
    io.append_jsonl(df, f"{tmp_path}/out")
    assert io.read_jsonl(spark, f"{tmp_path}/out").count() == 4
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\nnot json\n')
    assert [r._bad for r in io.read_jsonl(spark, f"{tmp_path}/bad.jsonl", strict=False).select("id", "_bad").collect() if r.id is None] == ["not json"]
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        io.read_jsonl(spark, f"{tmp_path}/bad.jsonl").collect()


def test_images_sidecars_and_reports(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "sub/c.jpeg"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(b"x" * 3)
    assert io.image_files(spark, f"{tmp_path}/img").count() == 1
    assert io.image_files(spark, f"{tmp_path}/img", recursive=True).count() == 2
    docs = spark.createDataFrame([("teacher", "1", True, 3, "raw", None), ("teacher", "2", False, 5, "bad " * 100, "e")], "role string, id string, parse_ok boolean, element_count int, raw_model_output string, parse_error string")
    r = sidecars.report(docs).first()
    assert (r.total_files, r.parse_ok, r.parse_failed, r.total_elements) == (2, 1, 1, 3)
    assert len(sidecars.failures(docs).first().preview) == 200
    io.write_report(f"{tmp_path}/r.json", metrics=sidecars.report(docs), name="é")
    assert json.load(open(tmp_path / "r.json", encoding="utf-8"))["metrics"]["total_files"] == 2
    for _ in range(2):  # an old file is replaced
        io.write_summary(docs.select("id", "parse_error"), f"{tmp_path}/s.csv", ("parse_error", "none", "id"))
    assert sorted(open(f"{tmp_path}/s.csv", encoding="utf-8").read().splitlines()) == [",,1", "e,,2", "parse_error,none,id"]


def test_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"prompt": "{name}: {query}", "options": {"name": "n"}, "data": {"seed": 1}}))
    (tmp_path / "run.json").write_text(json.dumps({"extends": "base.json", "data": {"max_samples": 3}}))
    c = config.load(tmp_path / "run.json")
    assert (c.prompt, c.data.seed, c.data.max_samples) == ("n: {query}", 1, 3) and c.data.full_labels() == "outputs/labels_full.jsonl"
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    with pytest.raises(ValueError):
        config.load(tmp_path / "loop.json")
    (tmp_path / "odd.json").write_text('{"nope": 1}')
    with pytest.raises(TypeError):
        config.load(tmp_path / "odd.json")
    assert config.remap_output("outputs/a", "/r/") == "/r/a" and config.format_prompt("{{x}} {query}", query="q") == "{x} q"
    assert config.training_problems({}) == [] and config.training_problems({"validation_enabled": True, "validation_ratio": 0.1, "validation_label_path": "v", "early_stopping_enabled": True}) == []
    assert config.training_problems({"projector_learning_rate": 0.1}, {"train_multimodal_projector": True}) == []
    assert len(config.training_problems({"projector_learning_rate": -1, "early_stopping_patience": 0, "early_stopping_min_delta": -1, "early_stopping_enabled": True})) == 5
    assert len(config.training_problems({"validation_enabled": True, "validation_every_epochs": 0})) == 3
    assert config.same_contract({"a": {"b": 1}}, {"a": {"b": 2}}, ("a.b",)) == ["a.b"]


def test_labelling_with_a_backend(spark):
    class Echo:
        def answer(self, row):
            return J.serialize_label([{"text": row["query"], "bbox_norm": [1, 2, 3, 4], "focused": False}]) if row["id"] != "2" else "garbage"

    m = spark.createDataFrame([(str(i), f"{i}.png", "parsing", f"q{i}") for i in range(4)], "id string, image string, task string, query string")
    done = spark.createDataFrame([("0",)], "id string")
    got = P.label(m, done, Echo()).collect()
    assert {r.id: r.elements[0].text for r in got} == {"1": "q1", "3": "q3"}
    assert P.label(m, done).count() == 3


def test_streams_equal_batches(spark, tmp_path):
    from tessera.plans import catalogue

    catalogue.load()
    s = {r.key: r for r in catalogue.QUERIES["early_stop_stream"](spark, "/root/testdata/sf0.001").collect()}
    b = {r.event_type: r for r in catalogue.QUERIES["early_stop"](spark, "/root/testdata/sf0.001").collect()}
    assert {k: (round(v.best, 6), v.stopped_at) for k, v in s.items()} == {k: (v.best, v.stopped_at) for k, v in b.items()}
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    done = ledger.Ledger(spark, f"{tmp_path}/t")
    done.append(df, 0)
    done.append(spark.createDataFrame([(2,), (3,)], "id int"), 1)
    assert sorted(r.id for r in done.rows().collect()) == [1, 2, 3]


def test_by_role_last_row_wins_and_a_missing_one_matches_nothing(spark):
    teacher = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "id string, names array<string>")
    rows = spark.createDataFrame([("s", "a", ["x"], 2), ("s", "a", ["y"], 1), ("t", "b", None, 1)], f"role string, id string, names array<string>, {align.ORD} int")
    out = align.by_role(teacher, rows, ["s", "t"]).withColumn("m", match.by_similarity(F.col("names"), F.col("candidate_names"), 0.9))
    got = {(r.id, r.role): [x.matched for x in r.m] for r in out.collect()}
    assert got == {("a", "s"): [True, False], ("a", "t"): [False, False], ("b", "s"): [False], ("b", "t"): [False]}


def test_vocab_equality(spark):
    rows = lambda *x: spark.createDataFrame(x, "pair int, token string, id long")
    left = rows((0, "a", 0), (0, "b", 5), (1, "a", 0), (2, "a", 0), (3, "a", 0), (3, "b", 1))
    right = rows((0, "b", 5), (0, "a", 0), (1, "a", 1), (2, "a", 0), (2, "b", 1), (3, "a", 0))
    got = {r.pair: (r.equal, r.shared_size) for r in align.vocab_equality(left, right, "pair").collect()}
    assert got == {0: (True, 6), 1: (False, None), 2: (False, None), 3: (False, None)}


def plain_similarity(a, b):
    """The similarity of two names of ASCII letters, digits and blanks."""
    from collections import Counter

    x, y = (" ".join("".join(c for c in " ".join(n.lower().replace("_", " ").replace("-", " ").split()) if c.isalnum() or c == " ").split()) for n in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.9
    p, q = x.replace(" ", ""), y.replace(" ", "")
    words = len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    return max(words, 2 * sum((Counter(p) & Counter(q)).values()) / (len(p) + len(q)))


def test_similarity_match_is_the_plain_one(spark):
    """Each reference name in turn takes the most similar free candidate; the best one is named also where it is too far."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    data = [([" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 6))], [" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 6))]) for _ in range(60)]
    rows = spark.createDataFrame(data, "refs array<string>, candidates array<string>").select(match.by_similarity(F.col("refs"), F.col("candidates"), 0.6).alias("m")).collect()
    for (refs, candidates), r in zip(data, rows):
        free, want = list(range(len(candidates))), []
        for name in refs:
            best = max(free, key=lambda i: (plain_similarity(name, candidates[i]), -i), default=None)
            s = plain_similarity(name, candidates[best]) if best is not None else 0.0
            want.append((name, None if best is None else candidates[best], round(s, 9), best is not None and s >= 0.6))
            if want[-1][3]:
                free.remove(best)
        assert [(x.ref, x.best, round(x.similarity, 9), x.matched) for x in r.m] == want


def test_drawing_summary(spark):
    boxes = [([([1.0, 2.0, 3.0, 4.0],), ([5.0, 5.0, 5.0, 9.0],), ([1.0, 2.0],), (None,), ([1.0, float("nan"), 3.0, 4.0],)],), ([],), (None,)]
    rows = spark.createDataFrame(boxes, "elements array<struct<bbox_norm:array<double>>>")
    assert tuple(metrics.drawing_summary(rows, 1000, 1000).first()) == (3, 2, 1, 5, 1, 4, 3, 1)
    assert tuple(metrics.drawing_summary(rows.limit(0), 1000, 1000).first()) == (0,) * 8


@pytest.mark.parametrize("min_delta", [0.0, 0.05])
def test_early_stops_over_ranges_equal_the_fold(spark, min_delta):
    rng = random.Random(5)
    made = {
        "hot": [rng.random() for _ in range(900)], "falls": [1 - i / 300 for i in range(300)], "flat": [0.5] * 30, "one": [0.25], "nulls": [None] * 9,
        "late": [None, None, 0.5, 0.49, 0.48, None, 0.4, 0.39, float("nan"), 0.38, 0.37, 0.36, 0.35, 0.1], None: [float("nan"), 3.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 1.0], "short": [3.0, 2.0, 2.5],
    }
    rows = [(k, i // 2, i, v) for k, vs in made.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, ts int, no int, value double").withColumn("best", F.lit("clash"))
    folded = df.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ts", "no", "value"))).alias("xs")).select("key", L.early_stop(F.transform("xs", lambda e: e["value"]), 7, min_delta).alias("s"))
    want = sorted((repr(r.key), repr(r.s.best), r.s.bad, r.s.stopped_at) for r in folded.collect())
    for ranges in (1, 40):
        got = series.early_stops(df, "key", ["ts", "no"], "value", 7, min_delta, ranges).collect()
        assert sorted((repr(r.key), repr(r.best), r.bad, r.stopped_at) for r in got) == want
    assert len(want) == len(made)


def test_early_stops_of_no_rows_and_wrong_limits(spark):
    df = spark.createDataFrame([], "key string, ts int, value double")
    assert series.early_stops(df, "key", ["ts"], "value", 3).count() == 0
    with pytest.raises(ValueError):
        series.early_stops(df, "key", ["ts"], "value", 0)
    with pytest.raises(ValueError):
        series.early_stops(df, "key", ["ts"], "value", 3, -0.1)


def test_greedy_equals_every_pair_in_turn(spark):
    rng = random.Random(11)

    def box():
        x, y = rng.randrange(20), rng.randrange(20)
        return rng.choice([None, [x, y, x + rng.randrange(1, 12), y + rng.randrange(1, 12)]])

    def iou(a, b):
        if a is None or b is None:
            return 0.0
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
        return w * h / (area(a) + area(b) - w * h)

    def plain(pred, ref):
        every = sorted((-iou(p[1], r[1]), i, j) for i, p in enumerate(pred) for j, r in enumerate(ref) if p[0] == r[0])
        ps, rs, total, boxes = set(), set(), 0.0, 0
        for v, i, j in every:
            if i not in ps and j not in rs:
                ps.add(i), rs.add(j)
                total, boxes = total - v, boxes + (pred[i][1] is not None and ref[j][1] is not None)
        return len(ps), round(total, 9), boxes

    made = lambda n: [(rng.choice("abc"), box()) for _ in range(n)]
    rows = [(k, made(rng.randrange(9)), made(rng.randrange(9))) for k in range(200)] + [(200, [], []), (201, made(60), made(70)), (202, [("a", None)] * 5, [("a", [0, 0, 9, 9])] * 3)]
    df = spark.createDataFrame(rows, f"k int, p {match.USABLE}, r {match.USABLE}").select("k", match.greedy(F.col("p"), F.col("r")).alias("m"))
    assert {x.k: (x.m.tp, round(x.m.iou_sum, 9), x.m.boxes) for x in df.collect()} == {k: plain(p, r) for k, p, r in rows}
