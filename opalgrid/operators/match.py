"""Template search: absolute differences and normalised correlation, as relations and as kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.schema import MATCH
from opalgrid.sources.images import to_bgr

OVERLAP, SNAP, MAX_TEMPLATES_BYTES = 0.30, 1e-6, 256 << 20


def sad_map(image: np.ndarray, template: np.ndarray, mask: np.ndarray | None = None, tolerance=(0, 0, 0)) -> np.ndarray:
    """1 - sum |difference| / (765 n) for every place, BGR; masked-out pixels do not count."""
    th, tw = template.shape[:2]
    if th > image.shape[0] or tw > image.shape[1]:
        return np.empty((0, 0))
    shape = image.shape[0] - th + 1, image.shape[1] - tw + 1
    keep = np.ones((th, tw), bool) if mask is None else mask
    total, n = np.zeros(shape, np.int64), int(keep.sum())
    if not n:
        raise ValueError("the template has no visible pixel")
    tol = np.array(tolerance, np.int16)
    wide = image.astype(np.int16)
    for y, x in zip(*np.nonzero(keep)):
        off = np.abs(wide[y : y + shape[0], x : x + shape[1]] - template[y, x].astype(np.int16)) - tol
        total += np.maximum(off, 0).sum(axis=2)
    return 1.0 - total / (765.0 * n)


def _window_sums(plane: np.ndarray, th: int, tw: int) -> np.ndarray:
    sums = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1))
    sums[1:, 1:] = plane.cumsum(0).cumsum(1)
    return sums[th:, tw:] - sums[:-th, tw:] - sums[th:, :-tw] + sums[:-th, :-tw]


def _correlate(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    shape = image.shape[0] - template.shape[0] + 1, image.shape[1] - template.shape[1] + 1
    size = image.shape
    product = np.fft.rfft2(image, size) * np.conj(np.fft.rfft2(template, size))
    return np.fft.irfft2(product, size)[: shape[0], : shape[1]]


def ncc_map(image: np.ndarray, template: np.ndarray, centered: bool = True, floor: float | None = None) -> np.ndarray:
    """Normalised correlation over all channels (zero-mean if centered); flat windows and flat
    templates give 1 as the fast path does.  Values under ``floor`` are -1."""
    image, template = np.atleast_3d(image).astype(float), np.atleast_3d(template).astype(float)
    th, tw, channels = template.shape
    if th > image.shape[0] or tw > image.shape[1]:
        return np.empty((0, 0))
    n, cross, energy, own = th * tw, 0.0, 0.0, 0.0
    for c in range(channels):
        t = template[:, :, c] - (template[:, :, c].mean() if centered else 0.0)
        sums, squares = _window_sums(image[:, :, c], th, tw), _window_sums(image[:, :, c] ** 2, th, tw)
        cross = cross + _correlate(image[:, :, c], t)
        energy = energy + squares - (sums * sums / n if centered else 0.0)
        own += float((t * t).sum())
    energy = np.maximum(energy, 0.0)
    flat = (energy < 0.5) | (own < 0.5)
    score = np.where(flat, 1.0, cross / np.sqrt(np.where(flat, 1.0, energy * own)))
    score = np.clip(score, -1.0, 1.0)
    return score if floor is None else np.where(score < floor, -1.0, score)


def _products(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """``_correlate`` of whole numbers, exact: a transform's error is rounded off where it is surely small."""
    shape = image.shape[0] - template.shape[0] + 1, image.shape[1] - template.shape[1] + 1
    size = np.sqrt((image.astype(float) ** 2).sum() * (template.astype(float) ** 2).sum())
    if template.size > 64 and size * np.log2(image.size + 1) < 1e12:
        return np.rint(_correlate(image.astype(float), template.astype(float))).astype(np.int64)
    image, total = image.astype(np.int64), np.zeros(shape, np.int64)
    for y, x in np.argwhere(template).tolist():
        total += image[y : y + shape[0], x : x + shape[1]] * int(template[y, x])
    return total


def whole_ncc_map(image: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero-mean correlation of bytes over all channels, from sums of whole numbers: places of equal sums
    get equal scores.  Also which places are flat, or all if the template is; these score 1."""
    image, template = np.atleast_3d(image), np.atleast_3d(template)
    if (image == image[:, :, :1]).all() and (template == template[:, :, :1]).all():
        image, template = image[:, :, :1], template[:, :, :1]
    th, tw, channels = template.shape
    n, cross, energy, own = th * tw, 0, 0, 0
    whole = np.int64 if n < 1 << 22 else np.float64  # n * n * 255**2 * 3 has to fit
    for c in range(channels):
        a, b = image[:, :, c].astype(float), template[:, :, c].astype(whole)
        sums, squares = (_window_sums(x, th, tw).astype(whole) for x in (a, a * a))
        cross = cross + n * _products(image[:, :, c], template[:, :, c]).astype(whole) - sums * b.sum()
        energy = energy + n * squares - sums * sums
        own += n * (b * b).sum() - b.sum() ** 2
    flat = (energy <= 0) | (own <= 0)
    return np.where(flat, 1.0, cross / (np.sqrt(np.where(flat, 1, energy)) * np.sqrt(max(own, 1)))), flat


def exact_ncc(window: np.ndarray, template: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Zero-mean correlation at one place over the visible pixels; -1 if either side is flat."""
    window, template = np.atleast_3d(window).astype(float), np.atleast_3d(template).astype(float)
    keep = np.ones(template.shape[:2], bool) if mask is None else mask
    a, b = window[keep], template[keep]
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    energy = float((a * a).sum() * (b * b).sum())
    if energy <= 0:
        return -1.0
    score = float((a * b).sum() / np.sqrt(energy))
    return 1.0 if score > 1 - SNAP else max(-1.0, score)


def masked_ncc_map(image: np.ndarray, template: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``exact_ncc`` at every place, by correlation sums over the visible pixels."""
    image, template = np.atleast_3d(image).astype(float), np.atleast_3d(template).astype(float)
    m, n = mask.astype(float), int(mask.sum())
    cross, energy, own = 0.0, 0.0, 0.0
    for c in range(template.shape[2]):
        t = np.where(mask, template[:, :, c] - template[:, :, c][mask].mean(), 0.0)
        sums, squares = _correlate(image[:, :, c], m), _correlate(image[:, :, c] ** 2, m)
        cross, energy, own = cross + _correlate(image[:, :, c], t), energy + squares - sums * sums / n, own + float((t * t).sum())
    flat = (energy < 0.5) | (own <= 0)
    score = np.where(flat, -1.0, cross / np.sqrt(np.where(flat, 1.0, energy * own)))
    return np.where(score > 1 - SNAP, 1.0, np.maximum(score, -1.0))


def visible_mask(template: np.ndarray, key: tuple[int, int, int]) -> np.ndarray | None:
    """Pixels that differ from the (R, G, B) key; None if all do; ValueError if none does."""
    mask = (template[:, :, ::-1] != np.array(key, np.uint8)).any(axis=2)
    if not mask.any():
        raise ValueError("the template is fully transparent")
    return None if mask.all() else mask


def fill_hidden(template: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Hidden pixels become the visible pixels' mean gray."""
    b, g, r = (template[:, :, c].astype(int) for c in range(3))
    gray = (29 * b + 150 * g + 77 * r) >> 8
    out = template.copy()
    out[~mask] = int(gray[mask].mean())
    return out


PEAK_SLACK, PLATEAU_SLACK = 1e-6, 1e-7


def local_peaks(score: np.ndarray, minimum: float, height: int, width: int) -> list[tuple[int, int]]:
    """(y, x) of window maxima at least ``minimum``, of a plateau the first in row-major order.

    Scores are compared in 64 bits, as the queries' SQL has it; one within ``PEAK_SLACK`` of its window's
    maximum is a maximum, as rounding may part equal ones."""
    ry, rx = max(1, int(height * 0.30)), max(1, int(width * 0.30))
    padded = np.pad(score, ((ry, ry), (rx, rx)), constant_values=-np.inf)
    across = sliding_window_view(padded, 2 * rx + 1, axis=1).max(axis=2)
    best = sliding_window_view(across, 2 * ry + 1, axis=0).max(axis=2)
    peak = np.isfinite(score) & (score >= minimum) & (score + PEAK_SLACK >= best)
    for axis in (0, 1):
        again = np.abs(np.diff(score, axis=axis)) <= PLATEAU_SLACK
        peak &= ~np.pad(again, [(1, 0) if k == axis else (0, 0) for k in (0, 1)])
    return [tuple(p) for p in np.argwhere(peak).tolist()]


def bias_ok(window: np.ndarray, template: np.ndarray, tolerance, minimum: float, mask: np.ndarray | None = None) -> bool:
    """Mean residual beyond the (B, G, R) tolerance, as a score, reaches the minimum."""
    keep = np.ones(template.shape[:2], bool) if mask is None else mask
    off = np.abs(window[keep].astype(int) - template[keep].astype(int)) - np.array(tolerance)
    return 1 - np.maximum(off, 0).sum() / (keep.sum() * template.shape[2] * 255) >= minimum


def suppress(found: list[tuple[float, int, int]], h: int, w: int, overlap: float = OVERLAP) -> list[tuple[float, int, int]]:
    """Greedy suppression of (score, y, x) hits of one template."""
    kept: list[tuple[float, int, int]] = []
    for hit in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        _, y, x = hit
        if all((s := max(0, h - abs(y - b)) * max(0, w - abs(x - a))) <= overlap * (2 * h * w - s) for _, b, a in kept):
            kept.append(hit)
    return kept


def _gray(image: np.ndarray) -> np.ndarray:
    return ((29 * image[:, :, 0].astype(int) + 150 * image[:, :, 1] + 77 * image[:, :, 2]) >> 8).astype(np.uint8)


def find_all(image, template, minimum: float, metric: str = "sad", mode: int = 0, key=None, tolerance=(0, 0, 0), alpha=None) -> list[tuple[float, int, int]]:
    """(score, y, x) hits of a template.  metric sad or ncc; mode 1 compares gray; key hides a colour;
    tolerance is (B, G, R); alpha hides template pixels of a sad search."""
    th, tw = template.shape[:2]
    if th > image.shape[0] or tw > image.shape[1]:
        return []
    if metric == "sad":
        score = sad_map(image, template, alpha, tolerance)
        n = th * tw if alpha is None else int(alpha.sum())
        budget = int((1 - np.float32(minimum)) * n * 765)
        ok = (score >= minimum) & (np.rint((1 - score) * 765 * n) <= budget)
        return suppress([(float(score[y, x]), y, x) for y, x in np.argwhere(ok).tolist()], th, tw)
    mask = visible_mask(template, key) if key is not None else None
    if mode == 1 and mask is None:
        image_, template_ = _gray(image)[:, :, None], _gray(template)[:, :, None]
    else:
        image_, template_ = image, template
    if mask is None:
        own, flat = whole_ncc_map(image_, template_)
        if not (own >= minimum).any():
            return []
        score = np.where(own < minimum - PEAK_SLACK, -1.0, own)
    else:
        score = masked_ncc_map(image_, template_, mask)
    hits = []
    for y, x in local_peaks(score, minimum - PEAK_SLACK, th, tw):
        window = image[y : y + th, x : x + tw]
        if mask is not None:
            exact = exact_ncc(image_[y : y + th, x : x + tw], template_, mask)
        else:
            exact = -1.0 if flat[y, x] else 1.0 if own[y, x] > 1 - SNAP else float(own[y, x])
        if exact >= minimum and (mode == 1 or not any(tolerance) or bias_ok(window, template, tolerance, minimum, mask)):
            hits.append((exact, y, x))
    return suppress(hits, th, tw)


def find_one(image, template, minimum: float, metric: str = "sad", mode: int = 0, key=None, tolerance=(0, 0, 0), alpha=None) -> tuple[float, int, int] | None:
    """The best hit.  The ncc search ranks by plain normalised correlation; in colour the winner is
    scored again exactly, and if that fails its neighbourhood is struck out and the search goes on."""
    th, tw = template.shape[:2]
    if th > image.shape[0] or tw > image.shape[1]:
        return None
    if metric == "sad":
        score = sad_map(image, template, alpha, tolerance)
        y, x = np.unravel_index(int(np.argmax(score)), score.shape)
        return (float(score[y, x]), int(y), int(x)) if score[y, x] >= minimum else None
    mask = visible_mask(template, key) if key is not None else None
    if mode == 1 and mask is None:
        score = ncc_map(_gray(image), _gray(template), centered=False)
        y, x = np.unravel_index(int(np.argmax(score)), score.shape)
        return (float(score[y, x]), int(y), int(x)) if score[y, x] >= minimum else None
    coarse = ncc_map(image, template if mask is None else fill_hidden(template, mask), centered=False)
    while coarse.max() >= min(minimum, 0.5):
        y, x = map(int, np.unravel_index(int(np.argmax(coarse)), coarse.shape))
        window = image[y : y + th, x : x + tw]
        exact = exact_ncc(window, template, mask)
        if exact >= minimum and (not any(tolerance) or bias_ok(window, template, tolerance, minimum, mask)):
            return exact, y, x
        ry, rx = max(1, int(th * 0.30)), max(1, int(tw * 0.30))
        coarse[max(0, y - ry) : y + ry + 1, max(0, x - rx) : x + rx + 1] = -1
    return None


def find_templates(images: DataFrame, templates: DataFrame, minimum: float = 0.9, metric: str = "sad", best: bool = False, **options) -> DataFrame:
    """Hits of all templates (template_index, height, width, format, data) in all images.

    Templates are sent to every task; their size is checked first, and a larger set is searched in
    blocks.  Images are not shuffled."""
    size = templates.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // MAX_TEMPLATES_BYTES))
    out = None
    for block in range(blocks):
        rows = templates.where(F.pmod(F.col("template_index"), F.lit(blocks)) == block).orderBy("template_index").collect()
        known = [(r.template_index, *to_bgr(bytes(r.data), r.height, r.width, r.format)) for r in rows]

        def search(frames: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            for frame in frames:
                hits = []
                for r in frame.itertuples():
                    if r.data is None:
                        continue
                    image, _ = to_bgr(bytes(r.data), int(r.height), int(r.width), int(r.format))
                    for index, template, alpha in known:
                        keep = None if (alpha == 255).all() else alpha > 0
                        th, tw = template.shape[:2]
                        if best:
                            one = find_one(image, template, minimum, metric, alpha=keep, **options)
                            found = [one] if one else []
                        else:
                            found = find_all(image, template, minimum, metric, alpha=keep, **options)
                        hits += [(r.image_id, index, x, y, tw, th, s) for s, y, x in found]
                yield pd.DataFrame(hits, columns=["image_id", "template_index", "x", "y", "w", "h", "score"])

        part = images.select("image_id", "height", "width", "format", "data").mapInPandas(search, MATCH)
        out = part if out is None else out.unionByName(part)
    return out
