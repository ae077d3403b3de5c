"""Queries on 8 x 8 rasters made from the embeddings table, with their SQL.

A vector of 64 floats is an 8 x 8 image: v = clamp(floor((e + 1) * 127.5), 0, 255).  Blue is the
vector itself, green and red are its rotations by 21 and 42 places.

An image is one row, and stays one: the whole-image queries hand Arrow batches of images to NumPy
and shuffle nothing.  Queries that give one row per pixel of its own value are column expressions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.backends import mock_detector
from opalgrid.functions import pixels as P
from opalgrid.operators.boxes import label_components
from opalgrid.operators.decode import with_labels
from opalgrid.operators.match import find_templates, suppress
from opalgrid.operators.recognize import adaptive_masks, stretch
from opalgrid.operators.search import compact_hits, detections_json, run_detector
from opalgrid.operators.trace import thin, trace_json

SIDE, TEMPLATES, TEMPLATE_SIDE = 8, 5, 3
ROI = (2, 1, 5, 6)
TARGET, TOLERANCE = 0x808080, 12


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, v): one array of 64 bytes for each image."""
    value = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1.0) * 127.5))).cast("int")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.transform("embedding", value).alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, b, g, r)."""
    one = vectors(spark, sf_dir).select("image_id", "v", F.posexplode("v").alias("i", "b"))
    at = lambda k: F.element_at("v", (F.col("i") + k) % 64 + 1)
    return one.select("image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), "b", at(21).alias("g"), at(42).alias("r"))


def _per_image(spark, sf_dir, task, schema: str) -> DataFrame:
    """Runs task(ids, bgr) on batches of images; bgr is (n, 8, 8, 3).  The task gives arrays by column."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.stack([batch.column("v").flatten().to_numpy().reshape(-1, SIDE * SIDE)[:, (np.arange(SIDE * SIDE) + k) % (SIDE * SIDE)] for k in (0, 21, 42)], axis=-1)
                found = task(batch.column("image_id").to_numpy(), v.reshape(-1, SIDE, SIDE, 3).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.values()], names=list(found))

    return vectors(spark, sf_dir).mapInArrow(run, schema)


def _grays(bgr: np.ndarray, rounded: int = 0) -> np.ndarray:
    return (29 * bgr[..., 0] + 150 * bgr[..., 1] + 77 * bgr[..., 2] + 128 * rounded) >> 8


def _cells(ids: np.ndarray, **values: np.ndarray) -> dict:
    """One row per pixel of (n, 8, 8) values."""
    n, h, w = next(iter(values.values())).shape
    i, y, x = np.indices((n, h, w), np.int32).reshape(3, -1)
    return {"image_id": ids[i], "y": y, "x": x, **{k: v.reshape(-1) for k, v in values.items()}}


def _gray(rounded: bool = False):
    return P.gray(F.col("b"), F.col("g"), F.col("r"), rounded).alias("gray")


def grays(spark: SparkSession, sf_dir: str, rounded: bool = False) -> DataFrame:
    return pixels(spark, sf_dir).select("image_id", "y", "x", _gray(rounded))


PX = """
px AS (SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, v[i + 1] AS b, v[(i + 21) % 64 + 1] AS g, v[(i + 42) % 64 + 1] AS r
  FROM (SELECT vec_id, v, unnest(range(64)) AS i FROM (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 1.0) * 127.5))) AS INTEGER)) AS v FROM embeddings))),
gr AS (SELECT image_id, y, x, b, g, r, (29 * b + 150 * g + 77 * r) >> 8 AS gray, (29 * b + 150 * g + 77 * r + 128) >> 8 AS rounded FROM px)"""
WITH = "WITH " + PX


def raster_gray(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "y", "x", _gray(), _gray(True).alias("rounded"))


def raster_threshold(spark, sf_dir):
    return grays(spark, sf_dir).select("image_id", "y", "x", P.threshold(F.col("gray"), 128).alias("value"))


def raster_roi(spark, sf_dir):
    """Pixels of a rectangle that reaches over the image's edge."""
    box = P.clip_roi(F.lit(-2), F.lit(5), F.lit(6), F.lit(9), F.lit(SIDE), F.lit(SIDE))
    rows = grays(spark, sf_dir).withColumn("roi", box)
    r = F.col("roi")
    inside = (F.col("x") >= r.x) & (F.col("x") < r.x + r.w) & (F.col("y") >= r.y) & (F.col("y") < r.y + r.h)
    return rows.where(inside).select("image_id", (F.col("y") - r.y).alias("y"), (F.col("x") - r.x).alias("x"), "gray")


def color_stats(spark, sf_dir):
    def task(ids, bgr):
        gray, n = _grays(bgr).reshape(len(ids), -1), SIDE * SIDE
        mean = bgr.reshape(len(ids), n, 3).sum(axis=1) / n
        return {"image_id": ids, **{f"mean_{c}": mean[:, k] for k, c in enumerate("bgr")}, "min_gray": gray.min(axis=1).astype(np.int32), "max_gray": gray.max(axis=1).astype(np.int32), "pixels": np.full(len(ids), n)}

    return _per_image(spark, sf_dir, task, "image_id long, mean_b double, mean_g double, mean_r double, min_gray int, max_gray int, pixels long")


def color_find(spark, sf_dir):
    """Pixels near a colour: how many, their share, the first in row-major order, their bounds."""

    def task(ids, bgr):
        aim = np.array([TARGET & 255, TARGET >> 8 & 255, TARGET >> 16])
        hit = (np.abs(bgr - aim) <= TOLERANCE).all(axis=3)
        n, flat = hit.sum(axis=(1, 2)), hit.reshape(len(ids), -1)
        some, first = n > 0, flat.argmax(axis=1)
        out = {"image_id": ids, "n": n, "ratio": n / (SIDE * SIDE), "first_x": np.where(some, first % SIDE, -1), "first_y": np.where(some, first // SIDE, -1)}
        for name, size, lines in (("x", "w", hit.any(axis=1)), ("y", "h", hit.any(axis=2))):
            low, high = lines.argmax(axis=1), SIDE - 1 - lines[:, ::-1].argmax(axis=1)
            out |= {name: np.where(some, low, 0), size: np.where(some, high - low + 1, 0)}
        order = ("image_id", "n", "ratio", "first_x", "first_y", "x", "y", "w", "h")
        return {c: out[c].astype(np.int32) if c in order[3:] else out[c] for c in order}

    return _per_image(spark, sf_dir, task, "image_id long, n long, ratio double, first_x int, first_y int, x int, y int, w int, h int")


def _histograms(gray: np.ndarray) -> np.ndarray:
    """(n, 256) counts."""
    n = len(gray)
    return np.bincount((gray.reshape(n, -1) + 256 * np.arange(n)[:, None]).ravel(), minlength=256 * n).reshape(n, 256)


def gray_histogram(spark, sf_dir):
    def task(ids, bgr):
        bins = _histograms(_grays(bgr))
        i, value = np.nonzero(bins)
        return {"image_id": ids[i], "gray": value.astype(np.int32), "n": bins[i, value]}

    return _per_image(spark, sf_dir, task, "image_id long, gray int, n long")


def otsu_threshold(spark, sf_dir):
    """The first gray value with the largest wb * wf * (mb - mf)^2; 127 for flat images.

    Compared as the integers (sb * n - st * nb)^2 * n^2 / (nb * nf), with one division."""

    def task(ids, bgr):
        bins = _histograms(_grays(bgr))
        nb, sb = bins.cumsum(axis=1), (bins * np.arange(256)).cumsum(axis=1)
        n, off = nb[:, -1:], sb * nb[:, -1:] - sb[:, -1:] * nb
        score = np.where((bins > 0) & (nb < n), (off * off).astype(float) / np.maximum(1, nb * (n - nb)), -1.0)
        return {"image_id": ids, "threshold": np.where(score.max(axis=1) < 0, 127, score.argmax(axis=1)).astype(np.int32)}

    return _per_image(spark, sf_dir, task, "image_id long, threshold int")


def integral_image(spark, sf_dir):
    return _per_image(spark, sf_dir, lambda ids, bgr: _cells(ids, total=_grays(bgr).cumsum(axis=1).cumsum(axis=2)), "image_id long, y int, x int, total long")


def _mosaics(spark, sf_dir, across: int) -> DataFrame:
    """(mosaic, slots, pixels): rasters of across x across whole images, gray rounded.

    Images come numbered, so that a mosaic's images meet in one small group."""
    n = across * across
    rows = _arrays(spark, sf_dir, True).select(F.floor(F.col("image_id") / n).alias("mosaic"), F.struct((F.col("image_id") % n).alias("slot"), "gray").alias("part"))
    return rows.groupBy("mosaic").agg(F.sort_array(F.collect_list("part")).alias("parts")).where(F.size("parts") == n)


def _mosaic(row, across: int) -> np.ndarray:
    tiles = np.array(row.column("parts")[0].values.field("gray").flatten().to_numpy()).reshape(across, across, SIDE, SIDE)
    return tiles.transpose(0, 2, 1, 3).reshape(across * SIDE, across * SIDE)


def _on_mosaics(spark, sf_dir, across: int, task, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                found = _cells(row.column("mosaic").to_numpy(), **{c: v[None] for c, v in task(_mosaic(row, across)).items()})
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.values()], names=["mosaic", *list(found)[1:]])

    return _mosaics(spark, sf_dir, across).mapInArrow(run, schema)


def adaptive_mask(spark, sf_dir):
    """Pixels of 32 x 32 mosaics brighter or darker than the mean of their clipped 31 x 31 window by 8."""

    def task(value):
        bright, dark = adaptive_masks(value)
        return {"bright": bright, "dark": dark}

    return _on_mosaics(spark, sf_dir, 4, task, "mosaic long, y int, x int, bright boolean, dark boolean")


def foreground_summary(spark, sf_dir):
    """Bounds (exclusive ends), count and distinct columns of the pixels from 128 on."""
    rows = grays(spark, sf_dir).where(P.is_foreground(F.col("gray"), 128))
    return rows.groupBy("image_id").agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("bottom"), F.count("*").alias("n"), F.countDistinct("x").alias("active_columns"))


def useful_masks(spark, sf_dir):
    """Images whose foreground is neither too little nor too much to be text."""
    rows = grays(spark, sf_dir).groupBy("image_id").agg(F.count_if(F.col("gray") >= 136).alias("n"), F.count("*").alias("total"))
    return rows.where((F.col("n") > 0) & (F.col("n") * 1000 >= F.col("total")) & (F.col("n") * 100 <= F.col("total") * 45)).select("image_id", "n")


def gray_contrast(spark, sf_dir):
    """Histogram stretch of 16 x 16 mosaics between the first and the last percent."""
    return _on_mosaics(spark, sf_dir, 2, lambda value: {"value": stretch(value.astype(np.uint8)).astype(np.int32)}, "mosaic long, y int, x int, value int")


RULES = [((140, 120, 130), (20, 16, 24)), ((110, 130, 120), (12, 12, 12))]


def color_rule_mask(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("score", P.rule_score(F.col("b"), F.col("g"), F.col("r"), RULES))
    return rows.where("score > 0").select("image_id", "y", "x", F.round("score", 9).alias("score"))


def trace_masks(spark, sf_dir):
    rows = pixels(spark, sf_dir)
    masks = P.trace_masks(F.col("b"), F.col("g"), F.col("r"))
    return rows.groupBy("image_id").agg(*[F.count_if(m).alias(name) for name, m in masks.items()])


def _templates(spark, sf_dir) -> tuple[list[int], np.ndarray]:
    """Numbers and grays (n, 3, 3) of the corners of the first TEMPLATES images."""
    rows = _arrays(spark, sf_dir).where((F.col("image_id") >= 0) & (F.col("image_id") < TEMPLATES)).orderBy("image_id").collect()
    return [r.image_id for r in rows], np.array([r.gray for r in rows], np.int64).reshape(-1, SIDE, SIDE)[:, :TEMPLATE_SIDE, :TEMPLATE_SIDE]


PLACES = SIDE - TEMPLATE_SIDE + 1
PLACE = "image_id long, template_index int, y int, x int"


def _windows(gray: np.ndarray) -> np.ndarray:
    """(n, 6, 6, 3, 3) windows of all places."""
    return np.lib.stride_tricks.sliding_window_view(gray, (TEMPLATE_SIDE, TEMPLATE_SIDE), axis=(1, 2))


def _differences(ids, bgr, corners) -> np.ndarray:
    """(n, templates, 6, 6): each gray difference counts for three channels."""
    near = _windows(_grays(bgr))
    return 3 * np.stack([np.abs(near - c).sum(axis=(3, 4)) for c in corners], axis=1) if len(corners) else np.zeros((len(ids), 0, PLACES, PLACES), np.int64)


def _places(ids, numbers, shape) -> dict:
    i, t, y, x = np.indices(shape, np.int32).reshape(4, -1)
    return {"image_id": ids[i], "template_index": np.array(numbers, np.int32)[t], "y": y, "x": x}


def _score():
    return (F.lit(1.0) - F.col("diff") / F.lit(765.0 * TEMPLATE_SIDE * TEMPLATE_SIDE)).alias("score")


def template_sad_scores(spark, sf_dir):
    numbers, corners = _templates(spark, sf_dir)

    def task(ids, bgr):
        diff = _differences(ids, bgr, corners)
        return _places(ids, numbers, diff.shape) | {"diff": diff.ravel().astype(np.int32)}

    return _per_image(spark, sf_dir, task, f"{PLACE}, diff int").select("*", _score())


def template_sad_best(spark, sf_dir):
    """First of the best places in row-major order."""
    numbers, corners = _templates(spark, sf_dir)

    def task(ids, bgr):
        diff = _differences(ids, bgr, corners).reshape(len(ids), len(numbers), -1)
        at = diff.argmin(axis=2)
        return {"image_id": np.repeat(ids, len(numbers)), "template_index": np.tile(np.array(numbers, np.int32), len(ids)), "y": (at // PLACES).ravel().astype(np.int32), "x": (at % PLACES).ravel().astype(np.int32), "diff": diff.min(axis=2).ravel().astype(np.int32)}

    return _per_image(spark, sf_dir, task, f"{PLACE}, diff int").select("*", _score())


MIN_SCORE = 0.95


def template_sad_multi(spark, sf_dir):
    """Places from MIN_SCORE on after greedy suppression of shared areas over 0.30."""
    numbers, corners = _templates(spark, sf_dir)
    budget = int((1 - np.float32(MIN_SCORE)) * 765 * TEMPLATE_SIDE**2)

    def task(ids, bgr):
        diff = _differences(ids, bgr, corners)
        i, t, y, x = np.nonzero(diff <= budget)
        key = i * len(numbers) + t
        kept = []
        for k in np.unique(key):
            own = np.flatnonzero(key == k) if len(key) < 64 else np.arange(np.searchsorted(key, k), np.searchsorted(key, k, "right"))
            kept += [(i[own[0]], t[own[0]], b, a, -d) for d, b, a in suppress([(-int(diff[i[j], t[j], y[j], x[j]]), int(y[j]), int(x[j])) for j in own], TEMPLATE_SIDE, TEMPLATE_SIDE)]
        i, t, y, x, d = (np.array(c, np.int32) for c in zip(*kept)) if kept else (np.empty(0, np.int32),) * 5
        return {"image_id": ids[i], "template_index": np.array(numbers, np.int32)[t], "y": y, "x": x, "diff": d}

    return _per_image(spark, sf_dir, task, f"{PLACE}, diff int").select("*", _score())


def template_stats(spark, sf_dir):
    n = TEMPLATE_SIDE**2
    corner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TEMPLATE_SIDE - 1)), lambda i: F.slice("gray", i * SIDE + 1, TEMPLATE_SIDE)))
    rows = _arrays(spark, sf_dir).where((F.col("image_id") >= 0) & (F.col("image_id") < TEMPLATES)).select(F.col("image_id").cast("int").alias("template_index"), corner.alias("t"))
    total = lambda f: F.aggregate("t", F.lit(0).cast("long"), lambda a, v: a + f(v.cast("long")))
    rows = rows.select("template_index", total(lambda v: v).alias("total"), total(lambda v: v * v).alias("squares"))
    return rows.select("template_index", "total", (F.col("squares") * n - F.col("total") * F.col("total")).alias("energy_n"))


def template_ncc_scores(spark, sf_dir):
    """Zero-mean normalised correlation at every place, from integer sums; -1 for flat sides."""
    numbers, corners = _templates(spark, sf_dir)
    n = TEMPLATE_SIDE**2

    def task(ids, bgr):
        near = _windows(_grays(bgr))
        total = near.sum(axis=(3, 4))
        own = n * (near * near).sum(axis=(3, 4)) - total * total
        scores = []
        for c in corners:
            energy = int(n * (c * c).sum() - c.sum() ** 2)
            shared = n * (near * c).sum(axis=(3, 4)) - total * int(c.sum())
            good = (own > 0) & (energy > 0)
            scores.append(np.where(good, shared / (np.sqrt(np.where(good, own, 1).astype(float)) * np.sqrt(float(max(1, energy)))), -1.0))
        score = np.stack(scores, axis=1) if scores else np.zeros((len(ids), 0, PLACES, PLACES))
        return _places(ids, numbers, score.shape) | {"score": score.ravel()}

    return _per_image(spark, sf_dir, task, f"{PLACE}, score double").withColumn("score", F.round("score", 6))


def local_peaks(spark, sf_dir):
    """Maxima of their 3 x 3 window, of a plateau the first one in row-major order."""

    def task(ids, bgr):
        gray = _grays(bgr)
        edge = np.pad(gray, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
        peak = gray == np.lib.stride_tricks.sliding_window_view(edge, (3, 3), axis=(1, 2)).max(axis=(3, 4))
        peak &= (edge[:, 1:-1, :-2] != gray) & (edge[:, :-2, 1:-1] != gray)
        i, y, x = np.nonzero(peak)
        return {"image_id": ids[i], "y": y.astype(np.int32), "x": x.astype(np.int32), "gray": gray[i, y, x].astype(np.int32)}

    return _per_image(spark, sf_dir, task, "image_id long, y int, x int, gray int")


def color_bias(spark, sf_dir):
    """Images whose colours stay within a tolerance of image 0's, by mean residual."""
    rows = pixels(spark, sf_dir)
    known = F.broadcast(rows.where("image_id = 0").select("y", "x", F.col("b").alias("tb"), F.col("g").alias("tg"), F.col("r").alias("tr")))
    over = reduce(lambda a, b: a + b, (F.greatest(F.abs(F.col(c) - F.col("t" + c)) - 10, F.lit(0)) for c in "bgr"))
    rest = rows.join(known, ["y", "x"]).groupBy("image_id").agg(F.sum(over).alias("residual"), F.count("*").alias("n"))
    return rest.withColumn("score", 1 - F.col("residual") / (F.col("n") * 765)).where("score >= 0.96").select("image_id", "residual", "score")


def _components(gray: np.ndarray):
    """(image, y, x, label) of the pixels from 132 on; a component's label is its first pixel."""
    parts = []
    for i, image in enumerate(gray):
        labels = label_components(image >= 132)
        y, x = np.nonzero(labels)
        firsts = np.unique(labels[y, x], return_index=True)[1]
        parts.append((np.full(len(y), i), y, x, (y * SIDE + x)[firsts][labels[y, x] - 1] if len(y) else y))
    return [np.concatenate(c) for c in zip(*parts)]


def connected_components(spark, sf_dir):
    """4-connected components of the pixels from 132 on, each labelled by its first pixel."""

    def task(ids, bgr):
        i, y, x, label = _components(_grays(bgr))
        return {"image_id": ids[i], "y": y.astype(np.int32), "x": x.astype(np.int32), "label": label.astype(np.int32)}

    return _per_image(spark, sf_dir, task, "image_id long, y int, x int, label int")


def _arrays(spark, sf_dir, rounded: bool = False) -> DataFrame:
    """(image_id, gray array<int>) without a shuffle."""
    at = lambda i, k: F.element_at("v", (i + k) % 64 + 1)
    value = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: P.gray(at(i, 0), at(i, 21), at(i, 42), rounded))
    return vectors(spark, sf_dir).select("image_id", value.alias("gray"))


def component_stats(spark, sf_dir):
    """Bounds, size and mean value of each component."""

    def task(ids, bgr):
        gray = _grays(bgr)
        i, y, x, label = _components(gray)
        key, own = np.unique(i * SIDE * SIDE + label, return_inverse=True)
        low, high = np.full((2, len(key)), SIDE), np.full((2, len(key)), -1)
        for k, v in enumerate((x, y)):
            np.minimum.at(low[k], own, v)
            np.maximum.at(high[k], own, v)
        size, area = (high - low + 1).astype(np.int32), np.bincount(own, minlength=len(key))
        total = np.bincount(own, gray[i, y, x], len(key))
        return {"image_id": ids[key // (SIDE * SIDE)], "label": (key % (SIDE * SIDE)).astype(np.int32), "x": low[0].astype(np.int32), "y": low[1].astype(np.int32), "w": size[0], "h": size[1], "area": area, "mean": total / np.maximum(1, area)}

    return _per_image(spark, sf_dir, task, "image_id long, label int, x int, y int, w int, h int, area long, mean double")


def thin_skeleton(spark, sf_dir):
    def run(frames):
        for frame in frames:
            kept = [(k, int(thin(np.array(v).reshape(SIDE, SIDE) >= 128).sum())) for k, v in zip(frame["image_id"], frame["gray"])]
            yield pd.DataFrame(kept, columns=["image_id", "skeleton_pixels"])

    return _arrays(spark, sf_dir).mapInPandas(run, "image_id long, skeleton_pixels int")


def trace_paths(spark, sf_dir):
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"image_id": frame["image_id"], "trace": [trace_json(np.array(v).reshape(SIDE, SIDE).astype(np.uint8)) for v in frame["gray"]]})

    return _arrays(spark, sf_dir).mapInPandas(run, "image_id long, trace string")


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The rasters as gray images, and the corners of the first ones as templates."""
    rows = _arrays(spark, sf_dir)
    to_bytes = lambda c: F.unhex(F.array_join(F.transform(c, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    images = rows.select(F.col("image_id").cast("string").alias("image_id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(1).alias("format"), to_bytes(F.col("gray")).alias("data"))
    corner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TEMPLATE_SIDE - 1)), lambda i: F.slice("gray", i * SIDE + 1, TEMPLATE_SIDE)))
    known = rows.where(F.col("image_id") < TEMPLATES).select(F.col("image_id").cast("int").alias("template_index"), F.lit(TEMPLATE_SIDE).alias("height"), F.lit(TEMPLATE_SIDE).alias("width"), F.lit(1).alias("format"), to_bytes(corner).alias("data"))
    return images, known


def template_kernel_multi(spark, sf_dir):
    """The same search as template_sad_multi by the operator on stored images; without the metric's gray copies."""
    found = find_templates(*_stored(spark, sf_dir), MIN_SCORE)
    return found.select(F.col("image_id").cast("long").alias("image_id"), "template_index", "y", "x", F.round((1 - F.col("score")) * 765 * TEMPLATE_SIDE**2).cast("int").alias("diff")).withColumn("score", _score())


def template_kernel_ncc(spark, sf_dir):
    """Peaks of the correlation from 0.8 on, after suppression."""
    found = find_templates(*_stored(spark, sf_dir), 0.8, "ncc")
    return found.select(F.col("image_id").cast("long").alias("image_id"), "template_index", "y", "x", F.round("score", 6).alias("score"))


def detect_mock_json(spark, sf_dir):
    """The mock detector's boxes, named, as JSON."""
    images, _ = _stored(spark, sf_dir)
    boxes = run_detector(images, mock_detector(4), 0.5)
    boxes = boxes.select("image_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")], "class_id", "cand")
    named = with_labels(boxes, spark.createDataFrame([(0, "door"), (2, "key")], "class_id int, label string"))
    return detections_json(images, named).select(F.col("image_id").cast("long").alias("image_id"), "json")


def template_text(spark, sf_dir):
    """The hits of template_kernel_multi as compact text, moved by an origin; empty without hits."""
    hits = template_kernel_multi(spark, sf_dir).select("image_id", "template_index", F.lit(0).alias("place"), "x", "y", "diff")
    return compact_hits(vectors(spark, sf_dir).select("image_id"), hits, [F.col("diff"), F.col("y"), F.col("x")], (100, -5))


_SAD = WITH + """,
tpl AS (SELECT CAST(image_id AS INTEGER) AS template_index, y AS dy, x AS dx, gray AS tv FROM gr WHERE image_id < 5 AND x < 3 AND y < 3),
sad AS (SELECT g.image_id, template_index, g.y - dy AS y, g.x - dx AS x, CAST(3 * sum(abs(g.gray - tv)) AS INTEGER) AS diff
  FROM gr g JOIN tpl ON g.y - dy BETWEEN 0 AND 5 AND g.x - dx BETWEEN 0 AND 5 GROUP BY ALL)"""
_NMS = """
WITH RECURSIVE """ + _SAD.removeprefix("WITH ") + """,
hits AS (SELECT image_id, template_index, list({'d': diff, 'y': y, 'x': x} ORDER BY diff, y, x) AS h FROM sad WHERE diff <= 344 GROUP BY ALL),
kept AS (
  SELECT image_id, template_index, h, 1 AS i, h[1:1] AS k FROM hits
  UNION ALL
  SELECT image_id, template_index, h, i + 1, CASE WHEN len(list_filter(k, lambda a: 10 * greatest(0, 3 - abs(a.y - h[i + 1].y)) * greatest(0, 3 - abs(a.x - h[i + 1].x))
      > 3 * (18 - greatest(0, 3 - abs(a.y - h[i + 1].y)) * greatest(0, 3 - abs(a.x - h[i + 1].x))))) > 0 THEN k ELSE list_append(k, h[i + 1]) END
  FROM kept WHERE i < len(h))
SELECT image_id, template_index, u.y AS y, u.x AS x, u.d AS diff, 1.0::DOUBLE - u.d / 6885.0::DOUBLE AS score
FROM (SELECT image_id, template_index, unnest(k) AS u FROM kept WHERE i = len(h))"""

SQL = {
    "raster_gray": WITH + " SELECT image_id, y, x, gray, rounded FROM gr",
    "raster_threshold": WITH + " SELECT image_id, y, x, CASE WHEN gray >= 128 THEN 255 ELSE 0 END AS value FROM gr",
    "raster_roi": WITH + " SELECT image_id, y - 5 AS y, x, gray FROM gr WHERE x < 4 AND y >= 5",
    "color_stats": WITH + " SELECT image_id, avg(b) AS mean_b, avg(g) AS mean_g, avg(r) AS mean_r, min(gray) AS min_gray, max(gray) AS max_gray, count(*) AS pixels FROM gr GROUP BY image_id",
    "color_find": WITH + """, f AS (SELECT image_id, count(*) FILTER (hit) AS n, count(*) AS total, min(y * 8 + x) FILTER (hit) AS first, min(x) FILTER (hit) AS x0, max(x) FILTER (hit) AS x1, min(y) FILTER (hit) AS y0, max(y) FILTER (hit) AS y1
      FROM (SELECT *, abs(b - 128) <= 12 AND abs(g - 128) <= 12 AND abs(r - 128) <= 12 AS hit FROM px) GROUP BY image_id)
      SELECT image_id, n, n / total AS ratio, coalesce(first % 8, -1) AS first_x, coalesce(first // 8, -1) AS first_y, coalesce(x0, 0) AS x, coalesce(y0, 0) AS y, coalesce(x1 - x0 + 1, 0) AS w, coalesce(y1 - y0 + 1, 0) AS h FROM f""",
    "gray_histogram": WITH + " SELECT image_id, gray, count(*) AS n FROM gr GROUP BY image_id, gray",
    "otsu_threshold": WITH + """, h AS (SELECT image_id, gray, count(*) AS n FROM gr GROUP BY image_id, gray),
      c AS (SELECT image_id, gray, sum(n) OVER u AS nb, sum(n * gray) OVER u AS sb, sum(n) OVER w AS n, sum(n * gray) OVER w AS st FROM h
        WINDOW u AS (PARTITION BY image_id ORDER BY gray ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY image_id)),
      s AS (SELECT image_id, gray, CASE WHEN nb < n THEN CAST((sb * n - st * nb) * (sb * n - st * nb) AS DOUBLE) / CAST(nb * (n - nb) AS DOUBLE) END AS score FROM c)
      SELECT image_id, CASE WHEN score IS NULL THEN 127 ELSE gray END AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC NULLS LAST, gray) = 1""",
    "integral_image": WITH + " SELECT a.image_id, a.y, a.x, sum(b.gray) AS total FROM gr a JOIN gr b ON a.image_id = b.image_id AND b.y <= a.y AND b.x <= a.x GROUP BY ALL",
    "adaptive_mask": WITH + """, big AS (SELECT image_id // 16 AS mosaic, CAST(image_id % 16 // 4 * 8 + y AS INTEGER) AS y, CAST(image_id % 4 * 8 + x AS INTEGER) AS x, rounded FROM gr QUALIFY count(*) OVER (PARTITION BY image_id // 16) = 1024),
      m AS (SELECT a.mosaic, a.y, a.x, a.rounded AS gray, sum(b.rounded) // count(*) AS mean FROM big a JOIN big b ON a.mosaic = b.mosaic AND abs(a.y - b.y) <= 15 AND abs(a.x - b.x) <= 15 GROUP BY ALL)
      SELECT mosaic, y, x, gray >= mean + 8 AS bright, gray + 8 <= mean AS dark FROM m""",
    "foreground_summary": WITH + ' SELECT image_id, min(x) AS "left", min(y) AS top, max(x) + 1 AS "right", max(y) + 1 AS bottom, count(*) AS n, count(DISTINCT x) AS active_columns FROM gr WHERE gray >= 128 GROUP BY image_id',
    "useful_masks": WITH + " SELECT image_id, count(*) FILTER (gray >= 136) AS n FROM gr GROUP BY image_id HAVING n > 0 AND n * 1000 >= count(*) AND n * 100 <= count(*) * 45",
    "gray_contrast": WITH + """, big AS (SELECT image_id // 4 AS mosaic, CAST(image_id % 4 // 2 * 8 + y AS INTEGER) AS y, CAST(image_id % 2 * 8 + x AS INTEGER) AS x, rounded AS v FROM gr QUALIFY count(*) OVER (PARTITION BY image_id // 4) = 256),
      ends AS (SELECT mosaic, list_sort(list(v)) AS s FROM big GROUP BY mosaic), cut AS (SELECT mosaic, s[2] AS lo, s[255] AS hi FROM ends),
      safe AS (SELECT mosaic, CASE WHEN hi > lo THEN lo ELSE 0 END AS lo, CASE WHEN hi > lo THEN hi ELSE 255 END AS hi FROM cut)
      SELECT mosaic, y, x, CAST(greatest(0, least(255, trunc((v - lo) * 255 / greatest(1, hi - lo)))) AS INTEGER) AS value FROM big JOIN safe USING (mosaic)""",
    "color_rule_mask": WITH + """ SELECT image_id, y, x, round(score, 9) AS score FROM (SELECT image_id, y, x, greatest(0.0,
      CASE WHEN abs(r - 140) <= 20 AND abs(g - 120) <= 16 AND abs(b - 130) <= 24 THEN 1 - greatest(abs(r - 140) / 21.0::DOUBLE, abs(g - 120) / 17.0::DOUBLE, abs(b - 130) / 25.0::DOUBLE) ELSE 0 END,
      CASE WHEN abs(r - 110) <= 12 AND abs(g - 130) <= 12 AND abs(b - 120) <= 12 THEN 1 - greatest(abs(r - 110), abs(g - 130), abs(b - 120)) / 13.0::DOUBLE ELSE 0 END) AS score FROM px) WHERE score > 0""",
    "trace_masks": WITH + " SELECT image_id, count(*) FILTER (g >= 90 AND g - r >= 25 AND g - b >= 15) AS green, count(*) FILTER (gray <= 96) AS dark, count(*) FILTER (gray >= 200) AS bright FROM gr GROUP BY image_id",
    "template_sad_scores": _SAD + " SELECT image_id, template_index, y, x, diff, 1.0::DOUBLE - diff / 6885.0::DOUBLE AS score FROM sad",
    "template_sad_best": _SAD + " SELECT image_id, template_index, y, x, diff, 1.0::DOUBLE - diff / 6885.0::DOUBLE AS score FROM sad QUALIFY row_number() OVER (PARTITION BY image_id, template_index ORDER BY diff, y, x) = 1",
    "template_sad_multi": _NMS,
    "template_kernel_multi": _NMS,
    "detect_mock_json": """WITH d AS (SELECT i, round(8 * (0.2::DOUBLE + i * 0.001::DOUBLE), 6) AS a, round(8 * (0.7::DOUBLE + i * 0.001::DOUBLE), 6) AS b FROM range(4) r(i))
      SELECT vec_id AS image_id, (SELECT CAST(to_json(list({'x1': a, 'y1': a, 'x2': b, 'y2': b, 'cx': (a + b) * 0.5::DOUBLE, 'cy': (a + b) * 0.5::DOUBLE, 'score': 0.99::DOUBLE, 'class_id': i % 3, 'label': ['door', '1', 'key'][i % 3 + 1]} ORDER BY i)) AS VARCHAR) FROM d) AS json FROM embeddings""",
    "template_text": _NMS.replace("SELECT image_id, template_index, u.y AS y, u.x AS x, u.d AS diff, 1.0::DOUBLE - u.d / 6885.0::DOUBLE AS score", "SELECT image_id, coalesce(t, '') AS points, n FROM (SELECT vec_id AS image_id FROM embeddings) LEFT JOIN (SELECT image_id, count(*) AS n, string_agg(concat_ws(',', template_index, u.x + 100, u.y - 5), '|' ORDER BY template_index, u.d, u.y, u.x) AS t").removesuffix(")") + ") GROUP BY image_id) USING (image_id)",
    "template_stats": _SAD + " SELECT template_index, sum(tv) AS total, 9 * sum(tv * tv) - sum(tv) * sum(tv) AS energy_n FROM tpl GROUP BY template_index",
    "template_ncc_scores": _SAD + """, s AS (SELECT g.image_id, template_index, g.y - dy AS y, g.x - dx AS x, sum(gray) AS sa, sum(tv) AS sb, sum(gray * gray) AS aa, sum(tv * tv) AS bb, sum(gray * tv) AS ab
      FROM gr g JOIN tpl ON g.y - dy BETWEEN 0 AND 5 AND g.x - dx BETWEEN 0 AND 5 GROUP BY ALL)
      SELECT image_id, template_index, y, x, round(CASE WHEN 9 * aa > sa * sa AND 9 * bb > sb * sb THEN CAST(9 * ab - sa * sb AS DOUBLE) / (sqrt(CAST(9 * aa - sa * sa AS DOUBLE)) * sqrt(CAST(9 * bb - sb * sb AS DOUBLE))) ELSE -1.0 END, 6) AS score FROM s""",
    "thin_skeleton": "WITH RECURSIVE " + PX + """, img AS (SELECT image_id, list(CASE WHEN gray >= 128 THEN 1 ELSE 0 END ORDER BY y, x) AS m FROM gr GROUP BY image_id),
      t AS (SELECT image_id, 0 AS k, m FROM img UNION ALL
        SELECT image_id, k + 1, list_transform(list_transform(range(64), lambda i: {'i': i, 'r': [m[i - 7], m[i - 6], m[i + 2], m[i + 10], m[i + 9], m[i + 8], m[i], m[i - 8]]}), lambda p:
          CASE WHEN m[p.i + 1] = 1 AND p.i % 8 BETWEEN 1 AND 6 AND p.i // 8 BETWEEN 1 AND 6 AND list_sum(p.r) BETWEEN 2 AND 6
            AND len(list_filter(range(8), lambda j: p.r[j + 1] = 0 AND p.r[(j + 1) % 8 + 1] = 1)) = 1
            AND p.r[1] * p.r[3] * p.r[CASE WHEN k % 2 = 0 THEN 5 ELSE 7 END] = 0 AND p.r[CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END] * p.r[5] * p.r[7] = 0 THEN 0 ELSE m[p.i + 1] END)
        FROM t WHERE k < 16)
      SELECT image_id, CAST(list_sum(m) AS INTEGER) AS skeleton_pixels FROM t WHERE k = 16""",
    "local_peaks": WITH + """, m AS (SELECT a.image_id, a.y, a.x, a.gray, max(b.gray) AS m, max(CASE WHEN (b.y = a.y AND b.x = a.x - 1) OR (b.x = a.x AND b.y = a.y - 1) THEN CAST(b.gray = a.gray AS INTEGER) ELSE 0 END) AS again
      FROM gr a JOIN gr b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT image_id, y, x, gray FROM m WHERE gray = m AND again = 0""",
    "color_bias": WITH + """, s AS (SELECT p.image_id, sum(greatest(abs(p.b - t.b) - 10, 0) + greatest(abs(p.g - t.g) - 10, 0) + greatest(abs(p.r - t.r) - 10, 0)) AS residual, count(*) AS n FROM px p JOIN px t ON t.image_id = 0 AND p.y = t.y AND p.x = t.x GROUP BY p.image_id)
      SELECT image_id, residual, 1 - residual / (n * 765) AS score FROM s WHERE score >= 0.96""",
    "connected_components": "WITH RECURSIVE " + PX + """, f AS (SELECT image_id, y, x, y * 8 + x AS p FROM gr WHERE gray >= 132),
      reach AS (SELECT image_id, y, x, p AS label FROM f UNION SELECT f.image_id, f.y, f.x, r.label FROM reach r JOIN f ON f.image_id = r.image_id AND abs(f.y - r.y) + abs(f.x - r.x) = 1)
      SELECT image_id, y, x, min(label) AS label FROM reach GROUP BY image_id, y, x""",
    "component_stats": "WITH RECURSIVE " + PX + """, f AS (SELECT image_id, y, x, gray, y * 8 + x AS p FROM gr WHERE gray >= 132),
      reach AS (SELECT image_id, y, x, p AS label FROM f UNION SELECT f.image_id, f.y, f.x, r.label FROM reach r JOIN f ON f.image_id = r.image_id AND abs(f.y - r.y) + abs(f.x - r.x) = 1),
      l AS (SELECT image_id, y, x, min(label) AS label FROM reach GROUP BY image_id, y, x)
      SELECT image_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, avg(gray) AS mean FROM l JOIN f USING (image_id, y, x) GROUP BY image_id, label""",
}

# correlation as in template_ncc_scores, but 1 for flat sides, which the exact score then rejects
SQL["template_kernel_ncc"] = "WITH RECURSIVE " + SQL["template_ncc_scores"].removeprefix("WITH ").split("SELECT image_id, template_index, y, x, round(")[0].rstrip() + """,
  e AS (SELECT *, 9 * aa - sa * sa AS ea, 9 * bb - sb * sb AS eb FROM s),
  c AS (SELECT image_id, template_index, y, x, CASE WHEN ea > 0 AND eb > 0 THEN CAST(9 * ab - sa * sb AS DOUBLE) / (sqrt(CAST(ea AS DOUBLE)) * sqrt(CAST(eb AS DOUBLE))) ELSE 1.0 END AS v, ea > 0 AND eb > 0 AS real FROM e),
  f AS (SELECT *, CASE WHEN v < 0.8::DOUBLE - 1e-6 THEN -1.0::DOUBLE ELSE v END AS u FROM c),
  p AS (SELECT a.image_id, a.template_index, a.y, a.x, a.u, a.v, a.real, max(b.u) AS top, max(CASE WHEN (b.y = a.y AND b.x = a.x - 1) OR (b.x = a.x AND b.y = a.y - 1) THEN CAST(abs(b.u - a.u) <= 1e-7 AS INTEGER) ELSE 0 END) AS again
    FROM f a JOIN f b ON a.image_id = b.image_id AND a.template_index = b.template_index AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
  h AS (SELECT image_id, template_index, list({'s': CASE WHEN v > 1 - 1e-6 THEN 1.0::DOUBLE ELSE v END, 'y': y, 'x': x} ORDER BY CASE WHEN v > 1 - 1e-6 THEN 1.0::DOUBLE ELSE v END DESC, y, x) AS h
    FROM p WHERE u >= 0.8::DOUBLE - 1e-6 AND u + 1e-6 >= top AND again = 0 AND real AND v >= 0.8::DOUBLE GROUP BY ALL),
  kept AS (
    SELECT image_id, template_index, h, 1 AS i, h[1:1] AS k FROM h
    UNION ALL
    SELECT image_id, template_index, h, i + 1, CASE WHEN len(list_filter(k, lambda a: 10 * greatest(0, 3 - abs(a.y - h[i + 1].y)) * greatest(0, 3 - abs(a.x - h[i + 1].x))
        > 3 * (18 - greatest(0, 3 - abs(a.y - h[i + 1].y)) * greatest(0, 3 - abs(a.x - h[i + 1].x))))) > 0 THEN k ELSE list_append(k, h[i + 1]) END
    FROM kept WHERE i < len(h))
  SELECT image_id, template_index, u.y AS y, u.x AS x, round(u.s, 6) AS score FROM (SELECT image_id, template_index, unnest(k) AS u FROM kept WHERE i = len(h))"""

QUERIES = (
    raster_gray, raster_threshold, raster_roi, color_stats, color_find, gray_histogram, otsu_threshold, integral_image, adaptive_mask, foreground_summary, useful_masks, gray_contrast,
    color_rule_mask, trace_masks, template_sad_scores, template_sad_best, template_sad_multi, template_kernel_multi, template_kernel_ncc, template_text, detect_mock_json, template_stats, template_ncc_scores, local_peaks, color_bias,
    connected_components, component_stats, thin_skeleton, trace_paths,
)
