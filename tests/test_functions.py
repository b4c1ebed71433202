"""Golden cases of text, label, time, box and array functions, worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays, geometry, labels, scan, text
from quillon.operators import rewrite


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)

    def value(column):
        return row.select(column.alias("x")).first()["x"]

    return value


L = F.lit


def array(*xs):
    return F.array(*map(L, xs))


@pytest.mark.parametrize(
    "given,expect",
    [("<answer>\nYes.\n</answer>", "yes"), ("<answer>Yes, because no", "fail"), ("The answer is no.", "no"), ("No answer: none", "no"), (None, "fail"), ("", "fail"), ("<ANSWER>true</answer>", "yes")],
)
def test_single_issue(one, given, expect):
    assert one(labels.parse_verdicts(L(given).cast("string"), "single_issue")["Answer"]) == expect


@pytest.mark.parametrize(
    "given,expect",
    [
        ("Video Quality: Yes. Motion & Interaction: No. Prompt Alignment: Yes.", ("yes", "no", "yes")),
        ("[Visual Quality]：Good", ("yes", "fail", "fail")),
        (". ".join(f"{k}: {'No' if k == 'Physical Interaction' else 'Yes'}" for k in labels.LEGACY) + ".", ("yes", "no", "yes")),
        ("", ("fail", "fail", "fail")),
    ],
)
def test_merged(one, given, expect):
    found = labels.parse_verdicts(L(given), "merged")
    assert tuple(one(found[k]) for k in labels.MERGED) == expect


@pytest.mark.parametrize("given,expect", [("mismatch, because…", "no"), ("maybe", "maybe"), (" Good alignment", "yes"), ("Yes。", "yes"), ("", "fail")])
def test_trainer_label(one, given, expect):
    assert one(labels.trainer_label(L(given))) == expect


@pytest.mark.parametrize("given,expect", [("<answer>Yes.</answer>", False), ("<answer> yes </answer>", True), ("yes", False)])
def test_answer_is_yes(one, given, expect):
    assert one(labels.answer_is_yes(L(given))) is expect


def test_two_merges_differ(one):
    assert one(labels.merge_for_scoring([L("yes"), L("fail")])) == "fail"
    assert one(labels.merge_for_rewriting([L("Yes"), L(None).cast("string")])) == "No"


@pytest.mark.parametrize("given,expect", [("1", "1"), ("0", "0"), ("10", "10"), ("1.25", "1.2"), ("0.04", "0"), ("1.5", "1.5"), ("abc", None), (None, None), ("0.35", "0.3"), ("12345.67", "12345.7")])
def test_format_second(one, given, expect):
    assert one(text.format_second(L(given).cast("string"))) == expect


@pytest.mark.parametrize(
    "f,given,expect",
    [
        (text.time_tag_score, "<t>1s-2.5s</t> <t>4s-3s</t>", 1.5),
        (text.evidence_key, "The <t>1s-2s</t> Hand's bent!", "the hand s bent"),
        (text.strip_time_tags, "a <t>1s-2s</t> b\n  c", "a b\nc"),
        (text.strip_time_tags, "a  b ", "a  b "),
        (text.time_tag_count, "a <t>1s</t> <t>x\ny</t>", 2),
        (text.point_tags, "<t>0s-5s</t> x <t>1.25s - 2s</t>", "<t>0.0s</t> to <t>5.0s</t> x <t>1.2s</t> to <t>2.0s</t>"),
        (text.consistency_score, "Consistency Score: 0.85", 0.85),
        (text.consistency_score, "**Consistency Score:** 1", 1.0),
        (text.consistency_score, "Consistency Score: 1.5", None),
        (text.trim_repeated_response, "x</s>y</answer>z", "x</s>y</answer>"),
        (text.trim_repeated_response, " a<|im_end|>b</s>", "a<|im_end|>"),
        (text.ensure_sentence, "a", "a."), (text.ensure_sentence, "a。", "a。"), (text.ensure_sentence, "", ""),
        (text.clean_text, None, ""), (text.clean_text, "\xa0a \n b\t", "a b"),
        (text.sentence_after, " Flickering issue\n</think>", "Flickering issue"),
        (text.remove_ai_sentences, "Good. The AI failed. Fine!", "Good.Fine!"),
        (text.clean_reasoning, "It jumps. I believe so. It  jumps! Ok", "It jumps. Ok"),
        (text.safe_stem, "a/b/c.d.mp4", "a__b__c.d"),
        (text.clean_caption, "assistant: Video Caption: 'a  cat'", "a cat"),
        (text.has_caption, "<think>\n video caption : x", True), (text.has_caption, "Video Caption: x", False),
        (text.word_count, "", 0), (text.word_count, " a b c ", 3),
        (text.should_skip_claim, "<t>1s-2s</t> Goodness", True),
        (text.strip_think, "a<think>b\nc</think>d", "ad"),
        (lambda c: text.heuristic_object_prompt(c, 6), "Physics violation issue: The ball floats up.", "ball"),
        (lambda c: text.limit_words(c, 2), "a b  c", "a b"), (lambda c: text.limit_words(c, 0), "a b  c", "a b  c"),
        (lambda c: text.insert_caption(c, L("n")), "<think>\nVideo Caption: o\nb</think>", "<think>\nVideo Caption: n\nb</think>"),
        (lambda c: text.insert_caption(c, L("n")), " x", "<think>\nVideo Caption: n\nx"),
        (lambda c: text.replace_tag(c, "think", L("n")), "a<think>o</think>b", "a<think>\nn\n</think>b"),
        (lambda c: text.found_tag(c, "answer", L("")), "</answer><answer>", ""),
        (lambda c: text.json_object(c).isNotNull(), "[1]", False), (lambda c: text.json_object(c).isNotNull(), '{"a":1}', True),
        (text.loose_json, 'so {"a": 1} !', '{"a": 1}'), (text.loose_json, "so", None),
        (lambda c: rewrite.without_good(c, L("No")), "Good. <t>0s-1s</t> stiff", "<t>0s-1s</t> stiff"),
        (lambda c: rewrite.without_good(c, L("No")), "a goodness b", "a ness b"),
        (lambda c: rewrite.without_good(c, L("Yes")), " Good. x", "Good. x"),
    ],
)
def test_text(one, f, given, expect):
    got = one(f(L(given).cast("string")))
    assert got == pytest.approx(expect) if isinstance(expect, float) else got == expect


def test_merge_rewrite(one):
    said = ". ".join(f"{k}: {'No' if k in ('Physical Interaction', 'Cause-Effect') else 'Yes'}" for k in labels.LEGACY) + "."
    old = f"<think>\nVideo Quality: Good.\nSubject Movement: Good.\nPhysical Interaction, Cause-Effect: Ball floats\n</think>\n<answer>{said}</answer>"
    new = "<think>\nVideo Quality: Good.\nMotion & Interaction: Ball floats.\n</think>\n<answer>\nVideo Quality: Yes. Motion & Interaction: No. Prompt Alignment: Yes.\n</answer>"
    assert one(rewrite.merged_response(L(old))) == new
    assert one(rewrite.merged_response(L("no tags"))) == "no tags"
    assert one(rewrite.merged_response(L("<answer>Video Quality: Yes.</answer>"))).startswith("<answer>\nVideo Quality: Yes. Motion & Interaction: No.")
    assert one(rewrite.new_instruction(L("<video>\nSuppose you are an expert.\nold\nPrompt: x"), "NEW")) == "<video>\nSuppose you are an expert.\nNEW\nPrompt: x"


def test_replacements(one):
    edits = F.array(*[F.struct(L(a).alias("begin"), L(b).alias("end"), L(t).alias("text")) for a, b, t in ((0, 1, "X"), (3, 5, ""), (5, 5, "!"))])
    assert one(text.apply_replacements(L("abcdef"), edits)) == "Xbc!f"


def test_rewritten_response_tolerates_missing_parts(one):
    assert one(rewrite.rewritten_response(L(""))).startswith("<think>\n\n</think>\n<answer>\nVideo Quality: . Subject Movement: .")


def test_geometry(one):
    box = array(146, 137, 615, 415)
    assert one(geometry.iou(array(0, 0, 10, 10), array(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert one(geometry.iou(array(0, 0, 0, 0), array(0, 0, 0, 0))) == 0.0
    assert one(geometry.relative_box(box, L(428), L(640))) == [228, 320, 961, 970]
    h, w = geometry.smart_size(L(428), L(640))
    assert (one(h), one(w)) == (420, 644)
    assert one(geometry.smart_size(L(20), L(640))[0]) is None
    assert one(geometry.resized_box(box, L(428), L(640))) == [147, 134, 619, 407]
    assert one(geometry.frame_index(L(2.5), L(24.0), L(50))) == 49 and one(geometry.frame_index(L(2.5), L(24.0), L(0))) == 0
    assert one(geometry.temporal_groups(L(7), 3)) == [[0, 1, 2], [3, 4, 5], [6]] and one(geometry.temporal_groups(L(0), 3)) == []
    assert one(geometry.scale_truncated(geometry.xywh_to_xyxy(array(0.125, 0.25, 0.25, 0.5)))) == [125, 250, 375, 750]
    assert one(geometry.bin_middles(L(10.0), L(4))) == [1.25, 3.75, 6.25, 8.75]
    for given, expect in (((-1.0, 12.0), (0.0, 10.0)), ((8.0, 3.0), (3.0, 8.0))):
        assert tuple(one(x) for x in geometry.clamp_interval(L(given[0]), L(given[1]), L(10.0))) == expect
    assert one(geometry.mask_box(array(0, 4), array(2, 9), L(10), L(10), True)) == [0, 200, 500, 1000]
    assert one(geometry.box_to_1000(array(0.1, 0.2, 1.5, 0.5), L(10), L(10))) == [100, 200, 1000, 500]
    assert one(geometry.box_to_1000(array(1, 2, 5, 20), L(10), L(10))) == [100, 200, 500, 1000]
    assert one(geometry.positive_int(L("1.5"))) is None and one(geometry.positive_int(L("7"))) == 7 and one(geometry.positive_double(L("-1"))) is None
    assert one(geometry.pixel_box(array(900, 0, 100, 1000), L(10), L(20))) == [1, 0, 9, 19]
    assert one(geometry.truncated_frames(L(3), L(5))) == [0, 1, 2] and one(geometry.even_frames(L(5), L(2))) == [0, 4]


def test_arrays(one, spark):
    assert one(arrays.running_offsets(array(3, 2, 4))) == [0, 3, 5, 9]
    assert one(arrays.masked_positions(array(0, 1, 1), 1)) == [1, 0, 1]
    assert one(arrays.index_list(L("0-3,7, 2"))) == [0, 1, 2, 3, 7]
    grid = one(arrays.square_grid(L(64), L(2)))
    assert (grid["t"], grid["side"]) == (1, 8)
    assert math.isclose(one(arrays.l2_normalise(array(3.0, 4.0)))[1], 0.8)
    frame = spark.createDataFrame([(k, float(k)) for k in range(11)] , "k int, v double")
    out = {r["k"]: r["scaled"] for r in arrays.robust_scale(frame, "v").collect()}
    assert out[0] == 0 and out[10] == 255 and out[5] == 127
    assert {r["scaled"] for r in arrays.robust_scale(frame.withColumn("v", L(1.0)), "v").collect()} == {127}


def test_matching_agrees_with_all_permutations():
    import random
    from itertools import permutations

    import numpy as np

    rng = random.Random(1)
    for _ in range(30):
        n, m = rng.randint(1, 4), rng.randint(4, 6)
        gain = np.array([[rng.random() for _ in range(m)] for _ in range(n)])
        best = max(sum(gain[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))
        assert arrays.assignment_total(gain) == pytest.approx(best)
    box = [0.0, 0.0, 10.0, 10.0]
    assert arrays.match_total([box], [[50.0, 50.0, 60.0, 60.0], box]) == 1.0


def test_many_lists_of_boxes_are_matched_at_once(spark, monkeypatch):
    """Lists of up to eight boxes never go one by one through augmenting paths, and get the same totals."""
    import numpy as np

    rng = np.random.default_rng(2)
    corner = lambda n, k: np.concatenate([(c := rng.integers(0, 30, (n, k, 2)).astype(float)), c + rng.integers(0, 30, (n, k, 2))], axis=2)
    rows, want = [], []
    for n, m in ((7, 7), (3, 8), (8, 2), (8, 8), (9, 9), (1, 1)):
        a, b = corner(9, n), corner(9, m)
        rows += list(zip(a.tolist(), b.tolist()))
        want += [arrays.assignment_total(arrays.box_overlaps(*sorted(p, key=len))) / max(n, m) for p in zip(a, b)]
    rows += [([], rows[0][1]), (None, [])]
    found = spark.createDataFrame(rows, "a array<array<double>>, b array<array<double>>").select(arrays.matched_iou("a", "b").alias("x"))
    assert [r["x"] for r in found.collect()] == pytest.approx([*want, 0.0, 1.0], abs=1e-12)
    monkeypatch.setattr(arrays, "assignment_total", lambda gain: pytest.fail("one by one"))
    assert arrays.match_total(*rows[0]) == pytest.approx(want[0] * 7)


def test_matched_iou_edges(spark):
    t = "a array<array<double>>, b array<array<double>>"
    box = [0.0, 0.0, 10.0, 10.0]
    rows = spark.createDataFrame([([box], [box, [20.0, 20.0, 30.0, 30.0]]), ([], []), ([box], []), (None, None)], t)
    assert [r["x"] for r in rows.select(arrays.matched_iou("a", "b").alias("x")).collect()] == [0.5, 1.0, 0.0, 1.0]


def test_scans():
    t = "<t>0s-1s</t> The cup and <t>2s-3.5s</t> cup."
    found = scan.noun_mentions(t, ["cup", "cup", "dog", ""])
    assert [(m["noun"], m["start_sec"], m["begin"]) for m in found] == [("cup", 0.0, 17), ("cup", 2.0, t.rindex("cup"))]
    boxed = scan.place_boxes(t, [{**m, "box": [1, 2, 3, 4]} for m in found])
    assert boxed == "<t>0s-1s</t> The cup at <t>0.0s</t><box>[1, 2, 3, 4]</box> and <t>2s-3.5s</t> cup at <t>2.0s</t><box>[1, 2, 3, 4]</box>."
    assert scan.noun_mentions("cup <t>0s-1s</t> cup", ["cup"]) == []
    chat = "<|im_start|>user\n<think>q</think><|im_end|>\n<|im_start|>assistant\n<think>a</think>\n<answer>b</answer>\n<|im_end|>tail"
    (begin, end), = scan.label_spans(chat)
    assert chat[begin:end] == "<think>a</think>\n<answer>b</answer>\n<|im_end|>"
    assert scan.label_spans("<answer>x</answer> <think>open") == [(0, 19)]
    assert scan.find_pattern([1, 2, 1, 2, 1], [1, 2]) == [0, 2] and scan.find_pattern([1], []) == []


def test_rope_positions():
    ids = [1, 8, 9, 9, 9, 9, 2]
    got = arrays.rope_positions(ids, [(1, 4, 4)], 8, 9, 10)
    assert got == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (2, 2, 3), (2, 3, 2), (2, 3, 3), (4, 4, 4)]
    assert arrays.rope_positions([5, 6], [], 8, 9, 10) == [(0, 0, 0), (1, 1, 1)]


@pytest.mark.parametrize("by", [["g"], []])
def test_percentiles_are_exact(spark, by):
    rng = np.random.default_rng(len(by))
    for n in (1, 2, 3, 60, 4000):
        rows = [(k % 3, float(rng.choice([rng.normal(), 1.0, 5.0]))) for k in range(n)]
        frame = spark.createDataFrame([*rows, (0, None)], "g int, v double")
        for r in arrays.exact_percentiles(frame, "v", by, (0.01, 0.99, 0.5)).collect():
            mine = [v for g, v in rows if not by or g == r["g"]]
            assert np.allclose([r["p0"], r["p1"], r["p2"]], np.percentile(mine, [1, 99, 50]))


def test_principal_components_of_wide_vectors(spark):
    """300 dimensions, 9 directions, 40 partitions: no factor has more than 12 rows, and the projections are the whole's."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 9)) * np.arange(9, 0, -1) @ rng.normal(size=(9, 300)) + rng.normal(size=300)
    frame = spark.createDataFrame([("a", k, v.tolist()) for k, v in enumerate(x)], "g string, k long, v array<double>").repartition(40)
    got = {r["k"]: r["pca"] for r in arrays.principal_maps(frame, ["g"], "v", "k", kept=12).collect()}
    y = x - x.mean(axis=0)
    axes = np.linalg.svd(y, full_matrices=False)[2][:3]
    axes = axes * np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    assert np.allclose(np.array([got[k] for k in range(400)]), y @ axes.T, atol=1e-6)
    n, mean, factor = arrays._merged([arrays._spread(10, x[k : k + 10].mean(axis=0), x[k : k + 10] - x[k : k + 10].mean(axis=0), 12) for k in range(0, 400, 10)], 12)
    assert n == 400 and factor.shape == (12, 300) and np.allclose(mean, x.mean(axis=0)) and np.allclose(factor.T @ factor, y.T @ y, atol=1e-6 * np.abs(y.T @ y).max())


def test_principal_components_are_those_of_the_svd(spark):
    rng = np.random.default_rng(3)
    rows = [("a", k, [float(x) for x in rng.normal(size=6) * [5, 3, 2, 1, 1, 1]]) for k in range(80)] + [("b", k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0 + k]) for k in range(2)] + [(None, 9, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "g string, k long, v array<double>").repartition(4)
    got = {(r["g"], r["k"]): r["pca"] for r in arrays.principal_maps(frame, ["g"], "v", "k").collect()}
    for g in ("a", "b", None):
        x = np.array([v for h, _, v in rows if h == g])
        x = x - x.mean(axis=0)
        axes = np.linalg.svd(x, full_matrices=False)[2][:3]
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        want = np.zeros((len(x), 3))
        want[:, : len(axes)] = x @ axes.T
        assert np.allclose(np.array([got[g, k] for h, k, _ in rows if h == g]), want, atol=1e-9)
