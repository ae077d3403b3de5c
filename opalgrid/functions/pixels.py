"""Per-pixel and box expressions; all are built-in Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(b: Column, g: Column, r: Column, rounded: bool = False) -> Column:
    """Luminance (29 b + 150 g + 77 r) / 256: truncated, or rounded as text preprocessing does."""
    return F.shiftright(29 * b + 150 * g + 77 * r + (128 if rounded else 0), 8)


def threshold(value: Column, at: int) -> Column:
    if not 0 <= at <= 255:
        raise ValueError("threshold must lie in 0..255")
    return F.when(value >= at, 255).otherwise(0)


def is_foreground(value: Column, at: Column | int, invert: bool = False) -> Column:
    return value <= at if invert else value >= at


def split_bgr(target: int) -> tuple[int, int, int]:
    """B, G, R of an integer with B in its lowest byte."""
    return target & 255, target >> 8 & 255, target >> 16 & 255


def color_near(b: Column, g: Column, r: Column, target: int, tolerance: int | tuple[int, int, int]) -> Column:
    tolerance = (tolerance,) * 3 if isinstance(tolerance, int) else tolerance
    return reduce(lambda x, y: x & y, (F.abs(c - t) <= tol for c, t, tol in zip((b, g, r), split_bgr(target), tolerance)))


def antialias_tolerance(tolerance: int) -> int:
    return min(96, max(tolerance + 16, 2 * tolerance))


def rule_score(b: Column, g: Column, r: Column, rules: list[tuple[tuple[int, int, int], tuple[int, int, int]]]) -> Column:
    """Best of 1 - max(d / (tolerance + 1)) over (RGB, tolerance) rules; 0 where none fits."""
    scores = [F.lit(0.0)]
    for (tr, tg, tb), tol in rules:
        off = [F.abs(c - t) / F.lit(float(m + 1)) for c, t, m in zip((r, g, b), (tr, tg, tb), tol)]
        worst = F.greatest(*off)
        fits = reduce(lambda x, y: x & y, (F.abs(c - t) <= m for c, t, m in zip((r, g, b), (tr, tg, tb), tol)))
        scores.append(F.when(fits, F.lit(1.0) - worst).otherwise(0.0))
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def clip_roi(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The part of a rectangle inside an image (bigint arithmetic); null if nothing is left."""
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    right = F.least(x.cast("long") + w, width.cast("long"))
    bottom = F.least(y.cast("long") + h, height.cast("long"))
    box = F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), (right - left).cast("int").alias("w"), (bottom - top).cast("int").alias("h"))
    return F.when((right > left) & (bottom > top), box)


def intersection(a, b) -> Column:
    """Shared area of two structs with x, y, w, h, in bigint."""
    side = lambda p, n: F.greatest(F.lit(0).cast("long"), F.least(a[p].cast("long") + a[n], b[p].cast("long") + b[n]) - F.greatest(a[p], b[p]))
    return side("x", "w") * side("y", "h")


def iou(a, b) -> Column:
    inter = intersection(a, b)
    union = a["w"].cast("long") * a["h"] + b["w"].cast("long") * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def offset_axis(value: Column, by: Column | int) -> Column:
    """value + by where that is a 32-bit integer, else null."""
    moved = value.cast("long") + by
    return F.when(moved.between(-(2**31), 2**31 - 1), moved.cast("int"))


def unclip_distance(w: Column, h: Column, ratio: float) -> Column:
    return F.ceil(w * h * F.lit(float(max(0.0, ratio))) / (2 * (w + h))).cast("int")


def adaptive_scale(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(3.0), 1536 / F.greatest(width, height), F.sqrt(F.lit(4e6) / (width * height))))


def letterbox(width: Column, height: Column, size: int) -> Column:
    """Scale and truncated padding that fit an image into a square."""
    scale = F.least(size / width, size / height)
    new_w, new_h = F.floor(width * scale), F.floor(height * scale)
    return F.struct(scale.alias("scale"), F.floor((size - new_w) / 2).cast("int").alias("pad_x"), F.floor((size - new_h) / 2).cast("int").alias("pad_y"))


def mapped_point(v: Column, from_start: int, from_size: int, to_start: int, to_size: int) -> Column:
    """A coordinate of one rectangle in another, rounded half to even."""
    return (to_start + F.bround((v - from_start) * F.lit(float(to_size)) / from_size)).cast("int")


def trace_masks(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """Demonstration masks: green, dark and bright strokes."""
    value = gray(b, g, r)
    return {"green": (g >= 90) & (g - r >= 25) & (g - b >= 15), "dark": value <= 96, "bright": value >= 200}
