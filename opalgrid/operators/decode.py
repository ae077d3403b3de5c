"""Sequence and detection decoders, resampling and tensors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ctc_greedy(logits: DataFrame, charset: DataFrame) -> DataFrame:
    """(seq_id, text, confidence) of rows (seq_id, t, probs array<float>); index 0 is blank.

    A row that is not a distribution goes through softmax.  Equal neighbours collapse; sequences
    without symbols give empty text and confidence 0."""
    p = F.transform("probs", lambda v: v.cast("double"))
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    plain = (F.array_min(p) >= -1e-6) & (F.array_max(p) <= 1 + 1e-6) & (total > 0.95) & (total < 1.05)
    top = F.array_max(p)
    soft = F.lit(1.0) / F.aggregate(F.transform(p, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    rows = logits.select("seq_id", "t", (F.array_position(p, top) - 1).cast("int").alias("idx"), F.when(plain, top).otherwise(soft).alias("p"))
    before = F.lag("idx").over(Window.partitionBy("seq_id").orderBy("t"))
    rows = rows.withColumn("emit", (F.col("idx") != 0) & ~F.col("idx").eqNullSafe(before))
    named = rows.join(charset, "idx", "left")
    letters = F.sort_array(F.collect_list(F.when(F.col("emit"), F.struct("t", F.coalesce("ch", F.lit("")).alias("ch")))))
    return named.groupBy("seq_id").agg(F.array_join(F.transform(letters, lambda s: s["ch"]), "").alias("text"), F.coalesce(F.avg(F.when(F.col("emit"), F.col("p"))), F.lit(0.0)).alias("confidence"))


def beam_search(logits: np.ndarray, width: int = 5, symbols: int | None = None) -> list[int]:
    """Most likely symbols by prefix beam search over (T, C) logits; 0 is the blank.

    Each step looks at the max(2 width, 8) likeliest classes, the blank always among them."""
    width = min(16, max(2, width))
    classes = logits.shape[1]
    top = min(classes, max(2 * width, 8))
    lowest = -math.inf
    add = lambda a, b: np.logaddexp(a, b) if max(a, b) > lowest else lowest
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, lowest)}  # ends in blank, in symbol
    for row in logits.astype(float):
        peak = row.max()
        logp = row - peak - np.log(np.exp(row - peak).sum())
        chosen = np.argsort(-logp, kind="stable")[:top]
        if 0 not in chosen:
            chosen[-1] = 0
        grown: dict[tuple[int, ...], list[float]] = {}
        for prefix, (blank, symbol) in beams.items():
            total = add(blank, symbol)
            stay = grown.setdefault(prefix, [lowest, lowest])
            stay[0] = add(stay[0], total + logp[0])
            for c in chosen.tolist():
                if c == 0 or symbols is not None and c >= symbols:
                    continue
                longer = grown.setdefault((*prefix, c), [lowest, lowest])
                if prefix and prefix[-1] == c:
                    stay[1] = add(stay[1], symbol + logp[c])
                    longer[1] = add(longer[1], blank + logp[c])
                else:
                    longer[1] = add(longer[1], total + logp[c])
        ranked = sorted(grown.items(), key=lambda g: (-add(*g[1]), g[0]))[:width]
        beams = {k: tuple(v) for k, v in sorted(ranked)}
    return list(max(beams.items(), key=lambda b: add(*b[1]))[0])


def greedy(logits: np.ndarray) -> tuple[list[int], float]:
    """(symbols, mean probability of the emitted ones) of (T, C) logits; 0 is the blank.

    A step that is no distribution goes through softmax."""
    rows = logits.astype(float)
    top, total = rows.max(axis=1), rows.sum(axis=1)
    plain = (rows.min(axis=1) >= -1e-6) & (top <= 1 + 1e-6) & (total > 0.95) & (total < 1.05)
    sure = np.where(plain, top, 1 / np.exp(rows - top[:, None]).sum(axis=1))
    best = rows.argmax(axis=1)
    emit = (best != 0) & np.r_[True, best[1:] != best[:-1]]
    return best[emit].tolist(), float(sure[emit].mean()) if emit.any() else 0.0


def ctc_beam(logits: DataFrame, chars: list[str], width: int = 5) -> DataFrame:
    """(seq_id, text, confidence) by prefix beam search over rows (seq_id, steps): the steps' logits in
    order.  The confidence is the greedy decoder's, so that both decoders share one scale."""
    n = len(chars)

    def run(batches):
        for batch in batches:
            texts, sure = [], []
            for steps in batch.column("steps"):
                table = np.array(steps.as_py(), float).reshape(len(steps), -1)
                found, own = (beam_search(table, width, n), greedy(table)[1]) if len(steps) else ([], 0.0)
                texts.append("".join(chars[i] for i in found))
                sure.append(own)
            yield pa.record_batch({"seq_id": batch.column("seq_id"), "text": pa.array(texts, pa.string()), "confidence": pa.array(sure, pa.float64())})

    return logits.select(F.col("seq_id").cast("long").alias("seq_id"), "steps").mapInArrow(run, "seq_id long, text string, confidence double")


def class_axis(shape: tuple[int, ...], classes: int) -> int:
    """Which of two axes holds the classes: the one whose length is nearer (the last on ties)."""
    a, b = shape[-2:]
    return -2 if abs(a - classes) < abs(b - classes) else -1


def yolo_decode(candidates: DataFrame, scale: Column, pad_x: Column, pad_y: Column, width: Column, height: Column, confidence: float) -> DataFrame:
    """Boxes from rows (image_id, cand, values): cx, cy, w, h and class scores in letterbox space.

    The first best class counts if its score is positive and reaches ``confidence``; corners are
    taken back to the image and clipped to it."""
    v = lambda i: F.element_at("values", i).cast("double")
    scores = F.transform(F.slice("values", 5, F.size("values") - 4), lambda s: s.cast("double"))
    best = F.array_max(scores)
    out = candidates.withColumn("score", best).withColumn("class_id", (F.array_position(scores, best) - 1).cast("int"))
    out = out.where((F.col("score") > 0) & (F.col("score") >= confidence))
    corner = lambda c, half, pad, limit: F.least(F.greatest((c + half - pad) / scale, F.lit(0.0)), limit.cast("double"))
    return out.select(
        "image_id",
        "cand",
        corner(v(1), -v(3) / 2, pad_x, width).alias("x1"),
        corner(v(2), -v(4) / 2, pad_y, height).alias("y1"),
        corner(v(1), v(3) / 2, pad_x, width).alias("x2"),
        corner(v(2), v(4) / 2, pad_y, height).alias("y2"),
        "score",
        "class_id",
    )


def with_labels(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label; a class without one is named by its number."""
    named = detections.join(labels, "class_id", "left")
    return named.withColumn("label", F.coalesce("label", F.col("class_id").cast("string")))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Half-pixel bilinear (truncated) resampling of uint8 pixels."""
    h, w = image.shape[:2]

    def axis(n, size):
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    y0, y1, fy = axis(height, h)
    x0, x1, fx = axis(width, w)
    a = image.astype(float)
    extra = (1,) * (image.ndim - 2)
    fx, fy = fx.reshape(1, -1, *extra), fy.reshape(-1, 1, *extra)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return (top * (1 - fy) + low * fy).astype(np.uint8)


def letterbox_image(image: np.ndarray, size: int) -> tuple[np.ndarray, float, int, int]:
    """(square BGR image padded with 114, scale, pad_x, pad_y), nearest resampling."""
    h, w = image.shape[:2]
    scale = min(size / w, size / h)
    nw, nh = int(w * scale), int(h * scale)
    px, py = (size - nw) // 2, (size - nh) // 2
    out = np.full((size, size, 3), 114, np.uint8)
    ys = np.minimum((np.arange(nh) / scale).astype(int), h - 1)
    xs = np.minimum((np.arange(nw) / scale).astype(int), w - 1)
    out[py : py + nh, px : px + nw] = image[ys][:, xs]
    return out, scale, px, py


def detector_tensor(image: np.ndarray) -> np.ndarray:
    """RGB planes in 0..1 of a BGR image."""
    return np.ascontiguousarray(image[:, :, ::-1].transpose(2, 0, 1)).astype(np.float32) / 255


# Channel means and deviations of the text detector, in BGR position.  Fixed values.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def text_detector_tensor(image: np.ndarray, height: int, width: int) -> np.ndarray:
    pixels = resize(image, height, width).astype(np.float32) / 255
    return ((pixels - np.float32(MEAN)) / np.float32(DEVIATION)).transpose(2, 0, 1)


def crop_for_recognition(image: np.ndarray, box: tuple[int, int, int, int], height: int = 48, least: int = 320) -> np.ndarray:
    """The tensor of a text line: a crop padded by 25 % of its height at the sides and 5 % on top,
    48 rows high, its width rounded up to 32 (320 at least), values in -1..1, zeros on the right."""
    x, y, w, h = box
    side, top = max(1, math.ceil(h * 0.25)), math.ceil(h * 0.05)
    x0, x1 = max(0, x - side), min(image.shape[1], x + w + side)
    y0, y1 = max(0, y - top), min(image.shape[0], y + h)
    crop = image[y0:y1, x0:x1]
    wide = max(1, math.ceil(height * crop.shape[1] / crop.shape[0]))
    total = max(least, -(-wide // 32) * 32)
    out = np.zeros((3, height, total), np.float32)
    out[:, :, :wide] = ((resize(crop, height, wide).astype(np.float32) / 255 - 0.5) / 0.5).transpose(2, 0, 1)
    return out


def width_batches(widths: list[int], most: int = 8) -> list[list[int]]:
    """Indices grouped into batches of equal width, at most ``most`` each, by rising width."""
    out: list[list[int]] = []
    for i in sorted(range(len(widths)), key=lambda i: (widths[i], i)):
        if out and widths[out[-1][0]] == widths[i] and len(out[-1]) < most:
            out[-1].append(i)
        else:
            out.append([i])
    return out
