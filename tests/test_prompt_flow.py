"""Filters, judges, exports, degradation, detections, mixtures, sources and queues on small cases."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import benchmarks as B
from sievework.operators import documents as D
from sievework.operators import filters, judging, levels, mixture
from sievework.operators import statistics as S
from sievework.sources import records
from sievework.streaming import queues


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]


# --- text -----------------------------------------------------------------------------------------------


def test_rules_know_all_scripts(spark):
    got = one(
        spark, a=text.without_boilerplate(F.lit("　好的，接下来我将开始构思画面。\n真正的内容")), b=text.multiset_match(F.lit("你好"), F.lit("好你")), c=text.multiset_match(F.lit("a b a"), F.lit("a a a")),
        d=text.line_diff(F.lit("a\nb\nc"), F.lit("a\nx")), e=text.without_templates(F.lit("I want an image of I want an image of a cat. Nice"), ["I want an image of {}"]),
        f=text.without_templates(F.lit("帮我生成一张红色的猫图片。"), ["帮我生成一张{}图片"]), g=text.prompt_sections(F.lit("no sections")),
    )
    assert got.a == "真正的内容" and got.b.matched == 2 and got.b.ratio == 1 and (got.c.matched, round(got.c.ratio, 3)) == (2, 0.667)
    assert [(d.line, d.a, d.b) for d in got.d] == [(2, "b", "x"), (3, "c", None)]
    assert got.e == "a cat. Nice" and got.f == "红色的猫。" and got.g.system is None and len(got.g.version) == 12


def test_json_quotes_and_masks():
    assert D.single_quoted('{"k":"a\\\\"}') == "{'k':'a\\\\'}" and D.single_quoted("""{"k":"it's"}""") == "{'k':'it\\'s'}"
    t = '{"a":"x,y:z","b":[1,"q",{"c":null}],"id":{"d":[true]},"s":5}'
    mask = D.content_mask(t, frozenset({"s", "b"}))
    assert "".join(c for c, m in zip(t, mask, strict=True) if m) == "x,y:znulltrue"
    assert not any(D.content_mask('"text"'))


# --- degradation ----------------------------------------------------------------------------------------


def test_levels_and_both_forms():
    assert len(levels.LEVELS) == 13 and D.level(10) == D.level("l10") and D.level("l9")["usual"]["style"] == "photorealistic"
    flat = {
        "intent": "i", "style": "photorealistic", "lighting": "see [2]", "atmosphere": "calm", "photography": {"layout": "single", "camera_angle": ["high angle", "x"], "other": "y"},
        "elements": [{"id": 4, "caption": "c", "state": ["one.", "two"], "position": "<bbox>1 2 3 4</bbox>", "depth": "100-120", "photography": {"composition": "full"}}, {"id": 5, "caption": ""}],
        "scene": {"setting": "s", "elements": [{"id": 9, "caption": "sky", "depth": 7}]}, "relationships": ["<bbox>1 2 3 4</bbox> above"],
    }
    whole = json.loads(D.degraded(json.dumps(flat), "k", D.level("l10")))
    assert "lighting" not in whole and whole["photography"] == {"layout": "single", "camera_angle": "high angle"} and whole["relationships"] == flat["relationships"]
    first, second = whole["elements"][:2]
    assert first["depth"] == 100 and first["photography"] == {"composition": "full"} and first["id"] == 1 and second == {"id": 2}
    assert whole["scene"]["elements"] == [{"id": 3, "caption": "sky", "depth": 7}]
    none = json.loads(D.degraded(json.dumps(flat), "k", D.level("l1")))
    assert none == {"intent": "i"}
    nested = {
        "intent": "i", "style": "oil", "elements": [{"id": 1, "bbox_json": {"short_caption": "cat", "static_attributes": {"fur": ["soft.", "long."]}, "photography": {"view_perspective": "side"}}, "position": {"bbox": [1, 2, 30, 40]}, "depth": 3},
                                                    {"id": 2, "category": "dog", "original_description": None, "position": {"bbox": [5, 6, 7, 8]}}],
        "scene": {"background_elements": [{"id": 3, "category": "wall"}]}, "relationships": ["[1] left of [2]", "[1-3] together", "[8] lost"],
    }
    out = json.loads(D.degraded(json.dumps(nested), "k", D.level("l10"), flat=False))
    assert out["relationships"][0] == "<bbox>1 2 30 40</bbox> left of <bbox>5 6 7 8</bbox>" and len(out["relationships"]) == 2
    assert out["elements"][0]["photography"] == {"perspective": "side"} and out["elements"][1] == {"description": "dog", "position": "<bbox>5 6 7 8</bbox>", "id": 2}
    nested["elements"][1]["category"] = "dog of [1]"
    assert D.degraded(json.dumps(nested), "k", D.level("l10"), flat=False) is None
    # an unusual style is kept by another share than a usual one
    kept = [sum('"style"' in D.degraded(json.dumps({"style": s, "intent": "i"}), f"k{i}", D.level("l9")) for i in range(300)) for s in ("photorealistic", "oil")]
    assert kept[1] == 300 and 30 < kept[0] < 90


# --- filters --------------------------------------------------------------------------------------------


def test_filter_names_failures_in_order(spark):
    box = lambda *b: "<bbox>" + " ".join(map(str, b)) + "</bbox>"
    good = json.dumps({"intent": "a calm garden", "elements": [{"caption": "red wooden garden chair", "position": box(10, 10, 200, 200)}]})
    far = json.dumps({"intent": "a calm garden", "elements": [{"caption": "red wooden garden chair", "position": box(600, 600, 900, 900)}]})
    other = json.dumps({"intent": "busy street", "elements": [{"caption": "taxi", "position": box(10, 10, 200, 200)}] * 3})
    tall = "the garden has color and depth 12 " * 10
    rows = [
        (1, "forward", tall, "garden", good, good), (2, "forward", tall, "garden", far, good), (3, "forward", "short", "garden", "no json", good), (4, "forward", tall, "garden", other, good),
        (5, "backward", tall + " according to the reference", "garden", None, None), (6, "backward", "", "garden", None, None), (7, "forward", tall, None, json.dumps({"intent": "x", "elements": [{"caption": "y"}]}), good),
        (8, None, tall, "zebras", None, None),
    ]
    d = spark.createDataFrame(rows, "k int, mode string, thinking string, prompt string, generated_sp string, reference_sp string")
    got = {r.k: r for r in filters.filtered(d).collect()}
    assert [got[k].failures for k in range(1, 9)] == [[], [], ["length", "coherence", "templated", "invalid_json"], ["scene_mismatch", "element_count"], ["leakage"], ["no_thinking"], ["invalid_bbox"], ["coherence"]]
    assert [k for k in got if got[k].use_generated] == [2, 4] and [k for k in got if got[k].passed] == [1, 2]
    assert {(r.failure, r.n) for r in filters.failure_counts(filters.filtered(d)).collect()} >= {("passed", 2), ("coherence", 2)}


def test_row_rules(spark):
    got = one(
        spark, a=filters.normal_verdicts(F.array(F.lit(" yes "), F.lit("?")), F.lit(3)), b=filters.embedded_caption(F.lit('[{"text":"a"},{},{},{},{"x":1}]')), c=filters.embedded_caption(F.lit("[]")),
        d=filters.normal_tuples(F.lit('{"O":[{"o":"cat"},null],"A":null}')), e=filters.unwrapped_prompt(F.lit('{"ratio":"3:4","output":{"intent":"x"}}')), f=filters.is_error(F.lit("__ERROR__ x")), g=filters.is_error(F.lit(None).cast("string")),
    )
    assert got.a == ["YES", "NO", "NO"] and got.b == "a" and got.c is None and got.d.O == [{"o": "cat"}] and got.d.A == [] == got.d.G
    assert (got.e.ratio, json.loads(got.e.prompt)) == ("3:4", {"intent": "x"}) and got.f and got.g


# --- judges ---------------------------------------------------------------------------------------------


def test_rankings_of_trivial_and_whole_groups(spark):
    samples = spark.createDataFrame([(1, i, i != 2) for i in range(3)] + [(2, 0, False), (2, 1, True)] + [(3, 0, False), (3, 1, False)], "index long, image_idx int, valid boolean")
    wins = spark.createDataFrame([(1, 0, 1, 0.05), (1, 1, 0, 0.95)], "index long, a long, b long, y double")
    got = {r["index"]: r for r in judging.rankings(judging.ranked_samples("pairwise", samples, wins)).collect()}
    assert got[1].rankings == [1, 0, 2] and got[1].best_image_idx == 1 and got[1].n_valid == 2 and got[1].ratings["2"] == float("-inf")
    assert got[2].rankings == [1, 0] and set(got[2].ratings.values()) == {0.0} and got[3].rankings == [0, 1] and got[3].best_image_idx == 0
    # without any judgement all are undecided
    even = {r["index"]: r for r in judging.rankings(judging.ranked_samples("mix", samples, wins.limit(0))).collect()}
    assert even[1].rankings == [0, 1, 2]
    scores = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.9), (1, 2, 1.0), (2, 1, None)], "index long, image_idx int, score double")
    single = {r["index"]: r for r in judging.rankings(judging.ranked_samples("single", samples, scores)).collect()}
    assert single[1].rankings == [1, 0, 2] and single[2].rankings == [1, 0] and single[3].ratings == {"0": 0.0, "1": 0.0}
    detail = judging.ranked_samples("single_detail", samples, scores.withColumnRenamed("score", "overall_score"))
    assert {r["index"]: r.best_image_idx for r in judging.rankings(detail).collect()} == {1: 1, 2: 1, 3: 0}
    with pytest.raises(ValueError):
        judging.ranked_samples("other", samples, scores)


def test_two_phases_and_gates(spark):
    best = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, None)], "index long, best_image_idx long")
    v = [(1, 1, "thinking", 0.2, False), (1, 1, "structure", 0.8, True), (1, 1, "alignment", 0.6, True), (1, 0, "structure", 0.0, False), (2, 0, "thinking", 0.4, False), (2, 0, "aesthetic", None, None)]
    verdicts = spark.createDataFrame(v, "index long, image_idx long, facet string, score double, pass boolean")
    messages = spark.createDataFrame([(2, 0)], "index long, image_idx long")
    two = judging.two_phase(best, verdicts, messages)
    got = {r["index"]: (r.overall_score, r.overall_pass) for r in two.collect()}
    assert got == {1: (0.7, True), 2: (0.4, False), 3: (None, True), 4: (None, True)}
    turn = "array<struct<role:string,content:string>>"
    rollouts = spark.createDataFrame([(1, 1, [("user", "q"), ("assistant", "<think>wait, WAIT</think>{}")], None), (2, 0, [], None)], f"index long, image_idx long, messages {turn}, raw string")
    states = {r["index"]: r.state for r in judging.export_states(two, rollouts).collect()}
    assert states == {1: "written", 2: "no_messages", 3: "no_rollout", 4: "no_best"}
    strict = {r["index"]: (r.state, r.thinking) for r in judging.export_states(two, rollouts, least_score=0.5, floors={"structure": 0.5}, require_facets=True, most_waits=1).collect()}
    assert strict[1] == ("waits", "wait, WAIT") and strict[2][0] == strict[3][0] == "facets"
    line = judging.exported(judging.export_states(two, rollouts)).collect()[0].line
    assert json.loads(line)["messages"][0] == {"role": "user", "content": "q"}
    m = one(spark, a=judging.chat_messages(F.lit(""), F.lit("p"), F.lit("t"), F.lit("x"))).a
    assert [(x.role, x.content) for x in m] == [("user", "p"), ("assistant", "<think>\nt\n</think>\n\nx")]


# --- benchmarks -----------------------------------------------------------------------------------------


def test_specs_of_pictures():
    cat, dog, red = (0, 0, 10, 10, 0.9, "black"), (100, 0, 110, 10, 0.8, "brown"), (0, 200, 10, 210, 0.7, "red")
    objects = {"cat": [cat, red], "dog": [dog]}
    wish = lambda c, n, **k: {"class": c, "count": n, **k}
    assert B.spec_result(objects, [wish("cat", 2)], [wish("cat", 3)]) == (True, "")
    assert B.spec_result(objects, [wish("cat", 3)], [wish("dog", 1)]) == (False, "expected cat>=3, found 2\nexpected dog<1, found 1")
    assert B.spec_result(objects, [wish("cat", 1, color="red")], [])[1] == "expected red cat>=1, found 0 red; and 1 black"
    assert B.spec_result(objects, [wish("cat", 1), wish("dog", 1, position=("right of", 0))], [])[0]
    assert B.spec_result(objects, [wish("cat", 1), wish("dog", 1, position=("above", 0))], [])[1] == "expected dog above target, found right of target"
    assert B.spec_result(objects, [wish("cow", 1), wish("dog", 1, position=("above", 0))], [])[1].endswith("no target for dog to be above")
    near = [(0, 0, 100, 100, 0.9, "a"), (1, 1, 101, 101, 0.8, "b"), (300, 300, 400, 400, 0.2, "c"), (500, 0, 600, 9, 0.7, "d")]
    assert [b[5] for b in B.kept_detections(near, 0.3, 16, 0.5)] == ["a", "d"] and [b[5] for b in B.kept_detections(near, 0.3, 2, 1.0)] == ["a", "b"]


def test_unknown_skills_are_errors_and_robust_cells_are_whole(spark):
    with pytest.raises(Exception, match="unknown skill"):
        B.skill_means(spark.createDataFrame([("object", 1.0), ("taste", 0.0)], "s string, v double"), "s", "v").collect()
    r = np.random.default_rng(3)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 3), ("c", 11), ("d", 200)) for x in r.integers(0, 40, n)] + [("e", None), ("d", None)]
    got = {x.g: x for x in S.cells(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "abcd":
        v = np.array([x for k, x in rows if k == g and x is not None])
        assert got[g].trim20 == pytest.approx(S.trimmed(v)) and got[g].upper_median == np.sort(v)[v.size // 2] and got[g].n == v.size
    assert got["e"].trim20 is None and got["e"].n == 0


def test_sums_run_over_ranges_and_groups(spark):
    r = np.random.default_rng(4)
    rows = [(int(g), int(k), int(v)) for k, (g, v) in enumerate(zip(r.integers(0, 3, 400), r.integers(1, 9, 400)))]
    d = spark.createDataFrame(rows, "g int, k int, v int").repartition(5)
    got = {x.k: (x.s, x.n) for x in S.numbered(S.running_sum(d, ["k"], F.col("v"), "s", ["g"]), ["k"], "n").collect()}
    sums = {}
    for n, (g, k, v) in enumerate(rows):
        sums[g] = sums.get(g, 0) + v
        assert got[k] == (sums[g], n)
    assert S.numbered(d.limit(0), ["k"], "n").count() == 0


# --- mixtures -------------------------------------------------------------------------------------------


def test_packs_begin_with_mandatory_groups(spark):
    rows = [(0, i, 10, "m" if i % 3 == 0 else "x") for i in range(12)] + [(0, 50, 99, "m"), (0, 51, 80, "x")]
    d = spark.createDataFrame(rows, "shard int, k int, c int, g string")
    got = mixture.with_mandatory(d, "shard", "k", "c", "g", ["m"], limit=40, expected=30, single=40).collect()
    assert sorted(r.k for r in got) == sorted(r[1] for r in rows) and {r.k for r in got if r.state == "skipped"} == {50, 51}
    packs = {}
    for r in got:
        if r.pack >= 0:
            packs.setdefault(r.pack, []).append(r)
    assert all(sum(dict((x[1], x[2]) for x in rows)[r.k] for r in p) <= 40 for p in packs.values())
    assert [sum(r.state == "mandatory" for r in p) for _, p in sorted(packs.items())][:4] == [1, 1, 1, 1]


def test_compositions_and_suites(spark):
    sizes = [0, 1, 2, 9, 30]
    d = spark.createDataFrame([(i,) for i in sizes], "n int")
    for decay in (1.0, 0.5):
        for r in d.select("n", mixture.composed(F.col("n"), F.col("n").cast("string"), decay).alias("p")).collect():
            assert sum(r.p) == r.n and all(x > 0 for x in r.p)
    names = spark.createDataFrame([("person",), ("apple",), ("bus",), ("cat",)], "name string")
    got = mixture.prompt_suite(names, "name", 40).collect()
    tags = {r.tag for r in got}
    assert tags == {"single_object", "two_object", "counting", "colors", "position", "color_attr"} and len({(r.tag, r.prompt, str(r.include)) for r in got}) == len(got)
    assert "a photo of an apple" in {r.prompt for r in got} and not [r for r in got if r.tag in ("colors", "color_attr") and "person" in r.prompt]
    counted = [r for r in got if r.tag == "counting"]
    assert all(r.exclude[0]["count"] == r.include[0]["count"] + 1 for r in counted) and any("buses" in r.prompt for r in counted)


def test_batched_calls_are_whole_or_null(spark):
    def model(batches):
        for pdf in batches:
            yield pdf.assign(answer=["<<<SEP>>>".join(x.strip().upper() for x in p.split("<<<SEP>>>")[: None if b else 1]) for b, p in zip(pdf["batch"], pdf["prompts"])])

    d = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "i int, p string")
    got = {r.i: r.answer for r in mixture.batched_calls(d, ["i"], "p", 3, model).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "P3", 4: "P4", 5: "P5", 6: "P6"}


# --- sources and queues ---------------------------------------------------------------------------------


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def test_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for i in (0, 2):
        (tmp_path / "s" / f"shard{i}.jsonl").write_text(f'{{"k":{i},"v":"a{i}"}}\n\nbad\n{{"k":7,"v":"s{i}"}}\n')
    assert sorted(r.k for r in records.shards(spark, str(tmp_path / "s"), 3, "k int, v string").collect()) == [0, 2, 7, 7]
    assert records.shards(spark, str(tmp_path / "s"), 0, "k int, v string").count() == 0
    first = records.first_records(spark, str(tmp_path / "s"), "k int, v string", ["k"]).collect()
    assert sorted((r.k, r.v) for r in first) == [(0, "a0"), (2, "a2"), (7, "s0")]
    inner = json.dumps([{"text": '{"intent":"x"}'}, {}, {}, {}, {}])
    folder = tmp_path / "pq"
    spark.createDataFrame([(inner,), ("[]",), (inner,)], "inputs string").coalesce(1).write.parquet(str(folder))
    paths = records.resolved_paths(spark, str(folder))
    got = records.parquet_prompts(spark, paths, done=spark.createDataFrame([("pq0000_rg0_row0",)], "id string")).collect()
    assert [(r.id, r.structured_prompt) for r in got] == [("pq0000_rg0_row2", '{"intent":"x"}')]
    assert [r.id for r in records.parquet_prompts(spark, paths, most_rows=1).collect()] == ["pq0000_rg0_row0"]
    with pytest.raises(ValueError):
        records.resolved_paths(spark, str(tmp_path / "s"))
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "d.txt").write_text("/x/a.parquet\n/x/notes\n/x/b.parquet\n")
    assert records.resolved_paths(spark, "d", str(tmp_path / "list")) == ["/x/a.parquet", "/x/b.parquet"]
    assert records.repeated_paths(["a", "b", "c"], 4, reverse=True) == ["c", "b", "a", "c"]
    (tmp_path / "r.jsonl").write_text('{"filename":"im.png","json_output":"j","width":3}\n{"json_output":"k"}\n')
    assert [(r.id, r.benchmark, r.rewritten_prompt, r.width) for r in records.rewritten(spark, str(tmp_path / "r.jsonl")).collect()] == [("im", "random", "j", 3), ("1", "random", "k", None)]
    (tmp_path / "tree/m/color/short").mkdir(parents=True)
    (tmp_path / "tree/m/color/short/a.json").write_text(json.dumps({"gt_answers": ["Yes", "no", "x"], "model_pred": [" yes", "yes"]}))
    assert sorted((r.model, r.attribute, r.length, r.correct) for r in records.answer_tree(spark, str(tmp_path / "tree")).collect()) == [("m", "color", "short", False), ("m", "color", "short", True)]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(png(640, 360))
    (tmp_path / "img" / "b.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 300, 200) + b"\0" * 8)
    assert sorted((r.mime, r.width, r.height) for r in records.image_files(spark, str(tmp_path / "img")).collect()) == [("image/gif", 300, 200), ("image/png", 640, 360)]
    w, h, data = records.picture_grid([(2, 1, bytes([9] * 6)), (1, 1, bytes([5] * 3))])
    assert (w, h) == (4, 2) and np.frombuffer(data, np.uint8).reshape(2, 4, 3)[..., 0].tolist() == [[9, 9, 5, 5], [0, 0, 0, 0]]
    out = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    records.emit(out, str(tmp_path / "sorted"), order=["k"])
    lines = [x for f in sorted((tmp_path / "sorted").glob("part-*")) for x in f.read_text().split()]
    assert [json.loads(x)["k"] for x in lines] == [1, 2, 3]


def test_poison_is_quarantined_and_claims_are_put_back(spark, tmp_path):
    src, good, bad = (str(tmp_path / n) for n in ("in", "good", "bad"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"index":1,"query":"x"}\nnot json\n{"index":2}\n\n')
    queues.quarantined(spark, src, "index long, query string", good, bad, str(tmp_path / "ck"), ["query"]).awaitTermination()
    assert [r["index"] for r in spark.read.json(good).collect()] == [1]
    assert sorted((r.value, r.error) for r in spark.read.json(bad).collect()) == [("not json", "no record"), ('{"index":2}', "missing field")]
    queues.quarantined(spark, src, "index long, query string", good, bad, str(tmp_path / "ck"), ["query"]).awaitTermination()
    assert spark.read.json(good).count() == 1
    tasks = spark.createDataFrame([("a", "claimed", 10.0), ("b", "claimed", 95.0), ("c", "done", 1.0), ("d", "claimed", None)], "t string, s string, x double").withColumn("x", F.col("x").cast("timestamp"))
    got = {r.t: (r.s, r.x is None) for r in queues.reparked(tasks, "s", "x", F.lit(100.0).cast("timestamp"), 60).collect()}
    assert got == {"a": ("pending", True), "b": ("claimed", False), "c": ("done", False), "d": ("claimed", True)}


def test_calls_are_tried_again_with_the_next_key():
    seen, waits = [], []

    def call(request, key):
        seen.append(key)
        if len(seen) < 3:
            raise OSError
        return request + key

    assert queues.with_retries(call, 5, queues.WAITS["claims"], ["a", "b"], waits.append)("r") == "ra" and seen == ["a", "b", "a"] and waits == [4.0, 8.0]
    with pytest.raises(ZeroDivisionError):
        queues.with_retries(lambda r: 1 / 0, 2, lambda k: 0, sleep=waits.append)("r")
