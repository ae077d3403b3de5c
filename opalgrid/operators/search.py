"""Searches by name or text over images and recognised lines, and their compact results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions import text as X
from opalgrid.operators import boxes as B
from opalgrid.operators import decode as D
from opalgrid.operators.match import find_templates
from opalgrid.sources.images import TemplateStore, to_bgr

HIT = ("image_id", "target_index", "variant", "line_no", "hit_at")


def find_text(lines: DataFrame, targets: str | list[list[str]], minimum: float = 0.0, origin: tuple[int, int] = (0, 0), whole_lines: bool = False) -> DataFrame:
    """Places of the targets in recognised lines (image_id, line_no, x, y, w, h, confidence, text).

    Targets are names between bars, or a list of variants for each; of a target's variants the first
    that an image has counts.  Hits are (image_id, target_index, variant, line_no, hit_at, x, y, w, h,
    cx, cy, confidence, rejected), moved by the origin; an image whose hits would leave 32 bits keeps
    its places and has rejected set.  ``whole_lines`` gives a line's box instead of the hit's part.
    Lines under the minimum confidence, and those without a number for it, are not searched."""
    X.check_score(minimum)
    groups = [[t] for t in X.split_names(targets)] if isinstance(targets, str) else targets
    if not groups or not all(groups) or not all(map(all, groups)):
        raise ValueError("a target is empty")
    wanted = F.array(*[F.struct(F.lit(i).alias("target_index"), F.lit(k).alias("variant"), F.lit(v).alias("target")) for i, g in enumerate(groups) for k, v in enumerate(g)])
    sure = F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.col("confidence") >= minimum)
    rows = lines.where(sure).select("image_id", "line_no", F.struct("x", "y", "w", "h").alias("box"), "confidence", "text", F.explode(wanted).alias("t"))
    rows = rows.select("image_id", "line_no", "box", "confidence", "text", "t.*").where(F.contains("text", "target"))
    if any(len(g) > 1 for g in groups):
        rows = rows.withColumn("first", F.min("variant").over(Window.partitionBy("image_id", "target_index"))).where("variant = first")
    rows = rows.withColumn("hit_at", F.explode(X.occurrences(F.col("text"), F.col("target"))))
    part = F.col("box") if whole_lines else X.text_box(F.col("box"), F.col("text"), F.col("hit_at"), F.length("target"))
    rows = rows.select(*HIT, "confidence", part.alias("b")).select(*HIT, "confidence", "b.*")
    half = lambda c: F.expr(f"{c} div 2").cast("int")
    moved = B.offset_boxes(rows, "image_id", *origin)
    return moved.select(*HIT, "x", "y", "w", "h", (F.col("x") + half("w")).alias("cx"), (F.col("y") + half("h")).alias("cy"), "confidence", "rejected")


def first_hit(hits: DataFrame) -> DataFrame:
    """The first hit of each image: of the earliest target with any, in line order."""
    columns = [c for c in hits.columns if c not in HIT]
    least = F.min(F.struct("target_index", "variant", "line_no", "hit_at", *columns)).alias("m")
    return hits.groupBy("image_id").agg(least).select("image_id", "m.*")


def compact_hits(images: DataFrame, hits: DataFrame, order: list[Column], origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """(image_id, points, n) of each image: ``number,x,y`` between bars, by template and then the order;
    empty, with a null n, where nothing is found or the origin would leave 32 bits."""
    moved = B.offset_boxes(hits, "image_id", *origin).where("not rejected")
    found = moved.groupBy("image_id").agg(X.compact_points([F.col("template_index"), *order], F.col("template_index"), F.col("x"), F.col("y")).alias("points"), F.count("*").alias("n"))
    return images.select("image_id").join(found, "image_id", "left").select("image_id", F.coalesce("points", F.lit("")).alias("points"), "n")


def text_points(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """(image_id, points): the hits' centres as compact text; empty for images without any."""
    order = [F.col(c) for c in ("target_index", "line_no", "hit_at")]
    found = hits.where("not rejected").groupBy("image_id").agg(X.compact_points(order, F.col("target_index"), F.col("cx"), F.col("cy")).alias("points"))
    return lines.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("points", F.lit("")).alias("points"))


def find_names(images: DataFrame, store: TemplateStore, handle: int, names: str, minimum: float = 0.9, origin: tuple[int, int] = (0, 0), bias: str = "", mode: int = 0, key: str | None = None) -> DataFrame:
    """(image_id, points, n): hits of the named templates, by colour or (mode 1) gray correlation; a key
    colour hides template pixels.  A missing template raises LookupError."""
    X.check_score(minimum)
    tolerance = X.parse_color_bias(bias, mode)[::-1]
    known = store.find(handle, X.split_names(names))
    hits = find_templates(images, known, minimum, "ncc", mode=mode, key=X.parse_rgb(key) if key else None, tolerance=tolerance)
    return compact_hits(images, hits, [-F.col("score"), F.col("y"), F.col("x")], origin)


def raw_detections(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: int = 640) -> DataFrame:
    """A detector's candidates (image_id, cand, values) with each image's letterbox and size.

    The model takes RGB planes in 0..1 and gives rows of cx, cy, w, h and class scores."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["data"] is None:
                    continue
                bgr, _ = to_bgr(bytes(r["data"]), r["height"], r["width"], r["format"])
                square, scale, px, py = D.letterbox_image(bgr, size)
                values = np.asarray(model(D.detector_tensor(square)), float)
                n = len(values)
                yield pa.record_batch(
                    {
                        "image_id": pa.array([r["image_id"]] * n, pa.string()),
                        "cand": pa.array(range(n), pa.int32()),
                        "values": pa.array(values.tolist(), pa.list_(pa.float64())),
                        "scale": pa.array([scale] * n, pa.float64()),
                        **{k: pa.array([v] * n, pa.int32()) for k, v in (("pad_x", px), ("pad_y", py), ("width", r["width"]), ("height", r["height"]))},
                    }
                )

    return images.select("image_id", "height", "width", "format", "data").mapInArrow(run, "image_id string, cand int, values array<double>, scale double, pad_x int, pad_y int, width int, height int")


def detect(candidates: DataFrame, labels: DataFrame, confidence: float = 0.25, overlap: float = B.DETECTION_OVERLAP) -> DataFrame:
    """Boxes (image_id, x1, y1, x2, y2, score, class_id, label) of a detector's candidates: decoded, greedily
    suppressed over the overlap whatever the class, and named."""
    found = D.yolo_decode(candidates, *[F.col(c) for c in ("scale", "pad_x", "pad_y", "width", "height")], confidence)
    sized = found.select("image_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), "x2", "y2", "score", "class_id", "cand")
    kept = B.suppress(sized, ["image_id"], [-F.col("score"), F.col("cand")], overlap, ["x", "y", "w", "h", "x2", "y2", "score", "class_id", "cand"])
    kept = kept.select("image_id", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", "score", "class_id", "cand")
    return D.with_labels(kept, labels)


def run_detector(images: DataFrame, detector: Callable[[np.ndarray, float], list[dict]], confidence: float = 0.25) -> DataFrame:
    """Boxes (image_id, x1, y1, x2, y2, score, class_id, cand) of a detector that takes whole BGR images and
    gives boxes in their pixels (``backends.Detector``)."""
    fields = {"x1": pa.float64(), "y1": pa.float64(), "x2": pa.float64(), "y2": pa.float64(), "score": pa.float64(), "class_id": pa.int32()}

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["data"] is None:
                    continue
                found = detector(to_bgr(bytes(r["data"]), r["height"], r["width"], r["format"])[0], confidence)
                columns = {c: pa.array([d[c] for d in found], t) for c, t in fields.items()}
                yield pa.record_batch({"image_id": pa.array([r["image_id"]] * len(found), pa.string()), **columns, "cand": pa.array(range(len(found)), pa.int32())})

    return images.select("image_id", "height", "width", "format", "data").mapInArrow(run, "image_id string, x1 double, y1 double, x2 double, y2 double, score double, class_id int, cand int")


def detections_json(images: DataFrame, detections: DataFrame) -> DataFrame:
    """(image_id, json): each image's boxes by falling score, with centres; ``[]`` without any."""
    number = {c: X.finite(F.col(c)) for c in ("x1", "y1", "x2", "y2", "score")}
    middle = [((number[a] + number[b]) * 0.5).alias(c) for a, b, c in (("x1", "x2", "cx"), ("y1", "y2", "cy"))]
    item = F.struct(*[number[c].alias(c) for c in ("x1", "y1", "x2", "y2")], *middle, number["score"].alias("score"), "class_id", "label")
    found = detections.groupBy("image_id").agg(X.match_json([-F.col("score"), F.col("cand")], item).alias("json"))
    return images.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("json", F.lit("[]")).alias("json"))


def detect_images(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], labels: DataFrame, size: int = 640, confidence: float = 0.25, overlap: float = B.DETECTION_OVERLAP) -> DataFrame:
    """(image_id, json) of images: letterbox, model, decoding, suppression, labels and JSON."""
    return detections_json(images, detect(raw_detections(images, model, size), labels, confidence, overlap))
