"""Known answers for boxes, text, recognition and decoding.

The numbers in the lists of boxes, rules, points and evaluations are fixed values: results that any
implementation of these operators must give.
"""

import json
import math

import numpy as np
import pytest

from opalgrid.backends import Models, PerWorker, RuntimeStatus, mock_detector, mock_recognizer
from opalgrid.functions import text as X
from opalgrid.operators import boxes as B
from opalgrid.operators import decode as D
from opalgrid.operators import match as M
from opalgrid.operators import recognize as R
from opalgrid.operators import search as S
from opalgrid.operators import trace as T
from opalgrid.operators.reader import TextReader, aligned
from opalgrid.sources.images import TemplateStore


def order(boxes):
    return [boxes[i][0] for line in B.reading_lines(boxes) for i in line]


@pytest.mark.parametrize(
    "boxes, xs",
    [
        ([(16, 7, 463, 22), (0, 11, 21, 14)], [0, 16]),
        ([(0, 58, 479, 19), (2, 5, 66, 20), (1, 31, 310, 19)], [2, 1, 0]),
        ([(40, 10, 100, 24), (25, 16, 6, 10), (0, 11, 20, 20)], [0, 25, 40]),
        ([(100, 30, 20, 12), (0, 8, 80, 18), (0, 29, 80, 18)], [0, 0, 100]),
    ],
)
def test_reading_order(boxes, xs):
    assert order(boxes) == xs


def test_reading_order_keeps_detector_order_on_ties():
    assert B.reading_lines([(10, 10, 20, 10), (10, 10, 30, 10)]) == [[0, 1]]


@pytest.mark.parametrize(
    "boxes, merged",
    [
        ([(0, 2, 19, 21), (25, 7, 22, 15), (45, 7, 17, 16), (65, 3, 26, 22)], [(0, 2, 91, 23, 4)]),
        ([(0, 10, 20, 18), (24, 10, 20, 18)], None),
        ([(0, 10, 20, 18), (24, 10, 20, 18), (48, 10, 20, 18)], None),
        ([(0, 10, 30, 18), (28, 10, 30, 18)], [(0, 10, 58, 18, 2)]),
        ([(0, 10, 20, 18), (100, 10, 20, 18), (0, 40, 20, 18)], None),
    ],
)
def test_fragment_merge(boxes, merged):
    assert B.merge_fragments(boxes) == (merged or [(*b, 1) for b in boxes])


def test_color_rules():
    assert X.parse_color_rules(None) == X.parse_color_rules("  ") == []
    assert len(X.parse_color_rules("ff00ff-101010|00FFFF-202020")) == 2
    for bad in ("FF00FF-10101", "FF00FF101010", "FF00FG-101010", "|FF00FF-101010", "FF00FF-101010|", "FF00FF-101010||FF00FF-101010", "|".join(["FF00FF-101010"] * 17)):
        with pytest.raises(ValueError):
            X.parse_color_rules(bad)


def test_colors_names_and_scores():
    assert X.parse_rgb("FF00FF") == X.parse_rgb("#FF00FF") == X.parse_rgb("0xFF00FF") == (255, 0, 255)
    for bad in ("", "FFFFF", "GG00FF", "0x1000000"):
        with pytest.raises(ValueError):
            X.parse_rgb(bad)
    for bad, mode in (("A", 0), ("GGGGGG", 0), ("12345", 0), ("1234567", 0), ("050505", 1), ("05", 2)):
        with pytest.raises(ValueError):
            X.parse_color_bias(bad, mode)
    for bad in ("", "|0.bmp", "0.bmp|", "0.bmp||1.bmp"):
        with pytest.raises(ValueError):
            X.split_names(bad)
    for bad in (-1, 1.1, math.nan, math.inf):
        with pytest.raises(ValueError):
            X.check_score(bad)


def test_compact_points():
    assert X.parse_compact_points("") == []
    assert X.parse_compact_points("1,-231,417|1,-25,-75|4,0,0") == [(1, -231, 417), (1, -25, -75), (4, 0, 0)]
    for bad in ("|0,1,2", "0,1,2|", "0,1", "0,1,2,3", "x,1,2", "-1,1,2"):
        with pytest.raises(ValueError):
            X.parse_compact_points(bad)


def line(x, y, w, h, c, t):
    return R.TextLine(x, y, w, h, c, t)


def support(columns, width=100, height=20):
    mask = np.zeros((height, width), bool)
    mask[5:15, columns[0] : columns[1] + 1] = True
    return R.Candidate("c", np.zeros((height, width, 3), np.uint8), mask=mask)


def test_evaluation():
    plain = R.Candidate("original", np.zeros((80, 100, 3), np.uint8))
    e = R.evaluate([line(5, 5, 60, 18, 0.95, "山水清音")], 100, 80, 0.5, candidate=plain)
    assert not e.suspicious and e.strong and e.chars == e.high_confidence_chars == 4
    assert R.evaluate([line(0, 0, 100, 80, 0.1, "abcd")], 100, 80, 0.5, candidate=plain).suspicious
    none = R.evaluate([], 100, 80, 0.5, candidate=plain)
    assert none.suspicious and not none.complete and none.coverage == 0
    part = R.evaluate([line(5, 2, 55, 16, 0.95, "abcd")], 100, 20, 0.5, candidate=support((5, 94)))
    assert not part.complete and part.coverage < 0.70 and part.trailing >= 30 and not part.strong
    whole = R.evaluate([line(5, 1, 90, 18, 0.95, "abcd")], 100, 20, 0.5, candidate=support((5, 94)))
    assert whole.complete and R.better(whole, part)
    wide = R.Candidate("original", np.zeros((20, 100, 3), np.uint8))
    assert R.evaluate([line(0, 1, 60, 18, 0.99, "abcd")], 100, 20, 0.5, candidate=wide).suspicious
    full = R.evaluate([line(2, 2, 96, 16, 0.99, "云云石石")], 100, 20, 0.5, candidate=wide)
    assert full.chars == 4 and full.strong
    assert R.evaluate([line(5, 5, 60, 18, 0.95, "山水清音")], 100, 80, 0.5, [["山水"], ["风和日"]], plain).target_groups == 1


def _evaluation(**values):
    return R.Evaluation(**({"complete": True, "suspicious": False, "chars": 4, "mean_confidence": 0.9, "quality": 5.0} | values))


def test_margins_on_both_sides():
    """A coverage gain of just 0.05 decides; an overlap gain of just 0.20 does not."""
    low, high = np.float32(0.60), np.float32(0.60) + np.float32(0.05)
    assert R.better(_evaluation(coverage=high, quality=1.0), _evaluation(coverage=low))
    assert not R.better(_evaluation(coverage=low), _evaluation(coverage=high, quality=1.0))
    under = np.nextafter(high, np.float32(0))
    assert not R.better(_evaluation(coverage=under, quality=1.0), _evaluation(coverage=low))
    assert not R.better(_evaluation(overlap_ratio=0.0, quality=1.0), _evaluation(overlap_ratio=np.float32(0.20)))
    assert R.better(_evaluation(overlap_ratio=np.float32(0.20)), _evaluation(overlap_ratio=0.0, quality=1.0))
    assert R.better(_evaluation(overlap_ratio=0.0, quality=1.0), _evaluation(overlap_ratio=np.float32(0.21)))
    assert not R.better(_evaluation(overlap_ratio=np.float32(0.21)), _evaluation(overlap_ratio=0.0, quality=1.0))
    assert R.better(_evaluation(quality=5.5), _evaluation()) and not R.better(_evaluation(quality=5.4), _evaluation())


def test_enlarging_by_hand():
    """One row 0, 100, 200 at scale 3: half-pixel places, shares from before the edge holds them."""
    row = np.repeat(np.array([[0, 100, 200]], np.uint8)[:, :, None], 3, 2)
    c = R.resized(R.Candidate("a", row, mask=np.array([[True, False, True]])), 3.0, "b")
    assert (c.pixels.shape, c.scale_x, c.scale_y, c.name) == ((3, 9, 3), 3.0, 3.0, "b")
    # places -1/3, 0, 1/3, ..: the first lies 2/3 between pixel 0 and the next, as its floor is -1
    assert c.pixels[1, :, 0].tolist() == [66, 0, 33, 66, 100, 133, 166, 200, 200]
    assert c.mask[0].tolist() == [True] * 3 + [False] * 3 + [True] * 3
    near = R.resized(R.Candidate("a", row), 1.5, "b", nearest=True)
    # five columns (4.5 rounds up); places -0.2, 0.4, 1.0, 1.6, 2.2
    assert near.pixels.shape == (2, 5, 3) and near.pixels[0, :, 0].tolist() == [0, 0, 100, 200, 200]
    assert R.resized(R.Candidate("a", np.zeros((4, 9, 3), np.uint8)), 2.5, "b").pixels.shape == (10, 23, 3)
    same = R.Candidate("a", row)
    assert R.resized(same, 1.0, "c").pixels is row and R.resized(same, 1.0, "c").name == "c"


def test_enlarging_against_a_plain_loop():
    rng = np.random.default_rng(1)
    image, f = rng.integers(0, 256, (5, 7, 3), np.uint8), np.float32
    for scale in (1.5, 2.3, 3.0):
        out = R.resized(R.Candidate("a", image), scale, "b").pixels
        h, w = out.shape[:2]
        assert (h, w) == (math.floor(5 * scale + 0.5), math.floor(7 * scale + 0.5))
        for y in range(h):
            for x in range(w):
                at = [(f(k) + f(0.5)) / (f(n) / f(m)) - f(0.5) for k, n, m in ((y, h, 5), (x, w, 7))]
                (y0, x0), (fy, fx) = [max(0, math.floor(a)) for a in at], [a - f(math.floor(a)) for a in at]
                y1, x1 = min(y0 + 1, 4), min(x0 + 1, 6)
                top = f(image[y0, x0, 0]) * (f(1) - fx) + f(image[y0, x1, 0]) * fx
                low = f(image[y1, x0, 0]) * (f(1) - fx) + f(image[y1, x1, 0]) * fx
                assert out[y, x, 0] == int(top * (f(1) - fy) + low * fy)


def test_peaks_within_rounding():
    score = np.zeros((9, 30))
    score[4, 5], score[4, 7] = 0.9, 0.9 + 5e-7
    assert M.local_peaks(score, 0.5, 10, 10) == [(4, 5), (4, 7)]  # too close to part
    score[4, 7] = 0.9 + 5e-6
    assert M.local_peaks(score, 0.5, 10, 10) == [(4, 7)]
    score[4, 20:23] = 0.8
    assert M.local_peaks(score, 0.5, 10, 10) == [(4, 7), (4, 20)]  # of a plateau the first


def test_confidence_rules():
    lines = [line(0, 0, 1, 1, c, "a") for c in (0.5, 0.4, math.nan, math.inf, -math.inf)]
    kept = {r: [t.confidence for t in R.confident(lines, 0.5, r)] for r in ("finite", "reached", "not_below")}
    assert kept["finite"] == [0.5] and kept["reached"] == [0.5, math.inf]
    assert len(kept["not_below"]) == 3 and math.isnan(kept["not_below"][1])


def test_reader_from_map_to_text():
    """Bright bars are lines; a line's text is one letter for each 16 columns with light."""
    chars = ["", "a", "b"]

    def detect(tensor):
        return (tensor[0] > 0).astype(np.float32) * 0.9

    def read(batch):
        if len(batch) > 1 and broken:
            raise RuntimeError("too many")
        lit = (batch[:, 0, 20, :] > 0.5)[:, ::16]
        logits = np.full((*lit.shape, 3), -9.0)
        logits[..., 0] = np.where(lit, -9, 9)
        logits[..., 1] = np.where(lit, 9, -9)
        return logits

    image = np.zeros((96, 160, 3), np.uint8)
    image[10:26, 20:80] = 255
    image[50:66, 30:130] = 255
    for broken in (False, True):
        for beam in (0, 4):
            found = TextReader(detect, read, chars, beam)(image)
            assert [t.text for t in found.lines] == ["a", "a"] and found.boxes == 2 and found.split is None
            assert all(t.confidence > 0.99 for t in found.lines) and found.lines[0].y < found.lines[1].y
    small = np.zeros((32, 160, 3), np.uint8)
    for x in (4, 30, 56):
        small[8:24, x : x + 20] = 255
    found = TextReader(detect, read, chars)(small)
    assert found.boxes == 3 and found.split is not None and len(found.lines) < 3 == len(found.split)
    assert len(TextReader(None, read, chars)(image).lines) == 1
    assert [aligned(n) for n in (1, 47, 48, 100)] == [32, 32, 64, 96]


def test_beam_by_enumeration():
    """With a beam wider than all prefixes the search sums every path."""
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(20):
        logits = rng.normal(size=(4, 3))
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        total = {}
        for way in itertools.product(range(3), repeat=4):
            text = tuple(c for i, c in enumerate(way) if c and (i == 0 or way[i - 1] != c))
            total[text] = total.get(text, 0) + math.prod(p[t, c] for t, c in enumerate(way))
        assert tuple(D.beam_search(logits, 16)) == max(total, key=total.get)


def test_small_expressions(spark):
    from pyspark.sql import functions as F

    from opalgrid.functions import pixels as P

    rows = spark.createDataFrame([(0.0, -1.0, 5), (-math.inf, -2.0, 2**31 - 3), (-math.inf, -math.inf, -(2**31))], "a double, b double, v int")
    got = rows.select(X.log_add(F.col("a"), F.col("b")).alias("s"), P.offset_axis(F.col("v"), 2).alias("up"), P.offset_axis(F.col("v"), -1).alias("down")).collect()
    assert abs(got[0].s - np.logaddexp(0, -1)) < 1e-12 and [r.s for r in got[1:]] == [-2.0, -math.inf]
    assert [(r.up, r.down) for r in got] == [(7, 4), (2**31 - 1, 2**31 - 4), (2 - 2**31, None)]
    assert X.truncate_utf8("aé你", 3) == "aé" and X.truncate_utf8("aé你", 2) == "a" and X.truncate_utf8("你" * 400) == "你" * 170


def test_status_and_workers(tmp_path):
    good, bad = RuntimeStatus.choose("cpu", ["cpu"]), RuntimeStatus.choose("directml", ["cpu"])
    assert not good.degraded and bad.degraded and bad.active == "cpu" and '"requested":"directml"' in bad.to_json()
    made = []
    model = PerWorker("counted", lambda: made.append(1) or (lambda x: x + 1))
    assert [model(1), model(2)] == [2, 3] and made == [1]
    models = Models()
    path = tmp_path / "m"
    path.write_bytes(b"abc")
    a, b, c = models.create(), models.create(), models.create()
    models.load_file(a, str(path), bytes.decode)
    models.load_bytes(b, b"xyz", bytes.decode)
    assert (models.get(a), models.get(b)) == ("abc", "xyz")
    with pytest.raises(FileNotFoundError):
        models.load_file(c, str(path) + "x", bytes.decode)
    with pytest.raises(ValueError):
        models.load_bytes(c, b"", bytes.decode)
    assert models.status()["models"]["3"] == "Empty" and models.latency_json() == "{}"


def test_greedy_suppression_against_a_plain_loop():
    rng = np.random.default_rng(9)
    for n in (1, 2, 40):
        box = np.column_stack([rng.integers(0, 30, (n, 2)), rng.integers(0, 20, (n, 2))])
        kept = []
        for i, (x, y, w, h) in enumerate(box.tolist()):
            shares = []
            for a, b, c, d in box[kept].tolist():
                s = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
                shares.append(s / (w * h + c * d - s) if w * h + c * d > s else 0)
            if all(s <= 0.45 for s in shares):
                kept.append(i)
        assert B.keep_greedily(box, 0.45) == kept


def test_searches(spark, tmp_path):
    rng = np.random.default_rng(3)
    frame = rng.integers(0, 256, (40, 60, 3), np.uint8)
    pixels = lambda a: (a.shape[0], a.shape[1], 2, a.tobytes())
    parts = {"a.bmp": frame[5:14, 7:17].copy(), "b.bmp": frame[20:30, 30:41].copy(), "c.bmp": rng.integers(0, 256, (9, 9, 3), np.uint8)}
    store = TemplateStore()
    handle = store.create()
    store.load(handle, spark.createDataFrame([(k, *pixels(v)) for k, v in parts.items()], "key string, height int, width int, format int, data binary"))
    images = spark.createDataFrame([("one", *pixels(frame)), ("none", *pixels(np.zeros((12, 12, 3), np.uint8)))], "image_id string, height int, width int, format int, data binary")
    got = {r.image_id: r.points for r in S.find_names(images, store, handle, "x/a.bmp|c.bmp|b.bmp", 0.95, (100, -5)).collect()}
    assert got == {"one": "0,107,0|2,130,15", "none": ""}
    assert {r.points for r in S.find_names(images, store, handle, "a.bmp", 0.95, (2**31 - 1, 0)).collect()} == {""}
    with pytest.raises(LookupError):
        store.find(handle, ["a.bmp", "lost.bmp"])
    lines = spark.createDataFrame([("i", 0, 0, 0, 8, 8, 0.9, "A你B好"), ("i", 1, 0, 10, 80, 8, 0.2, "你B"), ("i", 2, 0, 20, 30, 8, math.nan, "你B"), ("j", 0, 0, 0, 8, 8, 0.9, "x")], "image_id string, line_no int, x int, y int, w int, h int, confidence double, text string")
    hits = S.find_text(lines, [["lost", "你B"]], 0.5)
    assert [tuple(r) for r in S.first_hit(hits).select("image_id", "target_index", "x", "y", "w", "h", "cx", "cy").collect()] == [("i", 0, 2, 0, 4, 8, 4, 4)]
    assert sorted(map(tuple, S.text_points(lines, hits).collect())) == [("i", "0,4,4"), ("j", "")]
    assert S.find_text(lines, "你B", 0.5, whole_lines=True).first().w == 8
    for bad in ("", "a||b", []):
        with pytest.raises(ValueError):
            S.find_text(lines, bad)
    labels = spark.createDataFrame([(0, "door")], "class_id int, label string")

    def model(tensor):
        assert tensor.shape == (3, 64, 64)
        return np.array([[32, 32, 20, 20, 0.9, 0.1], [33, 32, 20, 20, 0.8, 0.1], [10, 32, 8, 8, 0.1, 0.7], [5, 5, 2, 2, 0.1, 0.2]])

    found = {r.image_id: json.loads(r.json) for r in S.detect_images(images, model, labels, 64).collect()}
    assert [(d["label"], d["class_id"], round(d["score"], 3)) for d in found["one"]] == [("door", 0, 0.9), ("1", 1, 0.7)]
    assert found["one"][0]["cx"] == (found["one"][0]["x1"] + found["one"][0]["x2"]) / 2 == 30


def test_remap_and_confidence():
    c = R.Candidate("s", np.zeros((240, 300, 3), np.uint8), 3.0, 3.0)
    t = R.remap([line(15, 12, 90, 45, 0.9, "x")], c, 100, 80)[0]
    assert (t.x, t.y, t.w, t.h) == (5, 4, 30, 15)
    assert len(R.confident([line(0, 0, 1, 1, 0.95, "a"), line(0, 0, 1, 1, 0.1, "b"), line(0, 0, 1, 1, math.nan, "c")], 0.5)) == 1


def test_candidates():
    names = [(c.name, c.pixels.shape[1], c.pixels.shape[0]) for c in R.candidates(np.full((80, 100, 3), 90, np.uint8))]
    assert names[:2] == [("original", 100, 80), ("bgr_scaled", 300, 240)]
    for ground, edge, core in ((20, 150, 250), (250, 120, 10)):
        image = np.full((40, 120, 3), ground, np.uint8)
        image[15:25, 20:60] = edge
        image[17:23, 22:58] = core
        rule = [((core,) * 3, (60,) * 3)]
        assert R.color_mask(image, rule, False, True).mask.sum() >= R.color_mask(image, rule, False).mask.sum() > 0


def test_pipeline():
    calls = []

    def empty(_):
        calls.append(1)
        return R.Recognition([])

    R.recognize(np.full((20, 100, 3), 60, np.uint8), empty)
    assert 0 < len(calls) <= 5
    image = np.full((20, 100, 3), 128, np.uint8)
    merged = [line(0, 1, 60, 18, 0.99, "merged")]
    split = [line(i * 35, 6, 30, 8, 0.95, c) for i, c in enumerate("ABC")]
    found = R.recognize(image, lambda _: R.Recognition(list(merged), list(split), 3))
    assert [t.text for t in found.lines] == ["A", "B", "C"]
    assert [a.candidate for a in found.attempts] == ["original/merged", "original/split"]
    assert found.attempts[0].reason and not found.attempts[0].selected and found.attempts[1].selected

    def fails(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        R.recognize(image, fails)


def test_mocks_and_registry():
    found = mock_recognizer(["A", "B"])(np.zeros((8, 8, 3), np.uint8))
    assert [(t.y, t.h, t.text) for t in found.lines] == [(0, 4, "A"), (4, 4, "B")]
    assert [d["class_id"] for d in mock_detector(4)(np.zeros((10, 10, 3), np.uint8), 0.5)] == [0, 1, 2, 0]
    assert mock_detector(4)(np.zeros((10, 10, 3), np.uint8), 0.995) == []
    models = Models()
    h = models.create()
    with pytest.raises(LookupError):
        models.get(h)
    models.load(h, lambda: "m")
    with pytest.raises(RuntimeError):
        models.load(h, lambda: "n")
    assert models.get(h) == "m" and models.status()["models"] == {"1": "Loaded"}


def test_correlation_against_direct():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (64, 48, 3), np.uint8)
    for h, w in ((9, 7), (1, 2), (20, 11)):
        template = image[7 : 7 + h, 9 : 9 + w]
        score = M.ncc_map(image, template)
        direct = np.array([[M.exact_ncc(image[y : y + h, x : x + w], template) for x in range(48 - w + 1)] for y in range(64 - h + 1)])
        assert np.abs(score - direct).max() < 2e-5 and np.unravel_index(score.argmax(), score.shape) == (7, 9)
    assert (M.ncc_map(np.full((12, 12, 3), 9, np.uint8), np.full((3, 3, 3), 7, np.uint8)) == 1).all()
    mask = rng.random((9, 7)) > 0.3
    template = image[7:16, 9:16]
    masked = M.masked_ncc_map(image, template, mask)
    assert abs(masked[7, 9] - 1) < 1e-6
    assert abs(masked[3, 4] - M.exact_ncc(image[3:12, 4:11], template, mask)) < 1e-6


def test_whole_correlation_is_exact():
    """Sums of whole numbers, by transform and by loops, against the direct score; flat places are told."""
    rng = np.random.default_rng(9)
    for channels, h, w in ((1, 3, 3), (3, 3, 3), (3, 20, 11), (1, 30, 30)):
        image = rng.integers(0, 256, (64, 48, channels), np.uint8)
        image[:32, :32] = 7
        template = image[33 : 33 + h, 12 : 12 + w]
        score, flat = M.whole_ncc_map(image, template)
        direct = np.array([[M.exact_ncc(image[y : y + h, x : x + w], template) for x in range(48 - w + 1)] for y in range(64 - h + 1)])
        assert flat[0, 0] and (score[flat] == 1).all() and (direct[flat] == -1).all()
        assert np.abs(score - direct)[~flat].max() < 1e-6
        want = np.array([[int((image[y : y + h, x : x + w, 0].astype(int) * template[:, :, 0]).sum()) for x in range(48 - w + 1)] for y in range(64 - h + 1)])
        assert (M._products(image[:, :, 0], template[:, :, 0]) == want).all()
    assert M.whole_ncc_map(image, np.full((4, 4, 1), 9, np.uint8))[1].all()


@pytest.mark.parametrize("metric", ["sad", "ncc"])
def test_placement(metric):
    rng = np.random.default_rng(3)
    for v in range(2):
        frame = rng.integers(0, 256, (96, 160, 3), np.uint8)
        a, b = rng.integers(0, 256, (8, 9, 3), np.uint8), rng.integers(0, 256, (12, 16, 3), np.uint8)
        frame[10:18, 10 + v : 19 + v] = a
        frame[60 + v : 72 + v, 90:106] = b
        assert [(x, y) for _, y, x in M.find_all(frame, a, 0.999, metric)] == [(10 + v, 10)]
        assert [(x, y) for _, y, x in M.find_all(frame, b, 0.999, metric)] == [(90, 60 + v)]
        assert M.find_one(frame, b, 0.999, metric)[1:] == (60 + v, 90)


def test_transparent_search():
    rng = np.random.default_rng(4)
    frame = rng.integers(0, 250, (60, 80, 3), np.uint8)
    template = frame[20:32, 30:44].copy()
    template[2:6, 3:9] = (255, 0, 255)
    assert M.find_one(frame, template, 0.99, "ncc", key=(255, 0, 255))[1:] == (20, 30)
    assert [(x, y) for _, y, x in M.find_all(frame, template, 0.99, "ncc", key=(255, 0, 255))] == [(30, 20)]
    with pytest.raises(ValueError):
        M.visible_mask(np.full((3, 3, 3), 7, np.uint8), (7, 7, 7))
    assert M.visible_mask(template[8:], (255, 0, 255)) is None


def test_beam_and_axis():
    logits = np.log(np.array([[0.4, 0.6, 1e-9], [0.6, 0.4, 1e-9]]))
    assert D.beam_search(logits, 4) == [1]
    assert D.class_axis((40, 97), 97) == -1 and D.class_axis((97, 40), 96) == -2
    assert D.width_batches([5, 3, 5, 3, 5], 2) == [[1, 3], [0, 2], [4]]


def test_tensors():
    image = np.arange(6 * 10 * 3, dtype=np.uint8).reshape(6, 10, 3)
    square, scale, px, py = D.letterbox_image(image, 20)
    assert square.shape == (20, 20, 3) and (scale, px, py) == (2.0, 0, 4) and (square[0] == 114).all()
    assert D.detector_tensor(square).shape == (3, 20, 20) and D.text_detector_tensor(image, 32, 64).shape == (3, 32, 64)
    assert D.crop_for_recognition(image, (1, 1, 4, 3)).shape == (3, 48, 320)


def test_trace():
    gray = np.zeros((20, 30), np.uint8)
    gray[8:11, 4:26] = 255
    out = T.trace(gray, threshold=128)
    assert out["path_count"] == 1 and out["foreground_pixels"] == 66 and 0 < out["skeleton_pixels"] <= 24
    assert sum(map(len, T.budget([[1] * 10, [2] * 10], 12))) == 12
    assert T.thin(np.ones((2, 9), bool)).all() and T.otsu(np.zeros(256)) == 127


def test_text_boxes():
    prob = np.zeros((40, 60), np.float32)
    prob[10:20, 5:30] = 0.9
    prob[12:15, 33:35] = 0.9
    assert len(B.text_boxes(prob)) == 1 and B.text_boxes(prob)[0][2] > 30
    assert B.detect_text(prob, 120, 80)


def test_components_against_search():
    rng = np.random.default_rng(2)
    for eight in (False, True):
        for _ in range(20):
            mask = rng.random((9, 11)) > 0.45
            labels, want, n = B.label_components(mask, eight), np.zeros((9, 11), int), 0
            for y, x in np.argwhere(mask).tolist():
                if want[y, x]:
                    continue
                n += 1
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < 9 and 0 <= b < 11 and mask[a, b] and not want[a, b]:
                        want[a, b] = n
                        stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or abs(i) + abs(j) == 1]
            assert (labels == want).all()
