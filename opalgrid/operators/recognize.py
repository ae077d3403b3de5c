"""Text recognition around a pluggable recogniser: candidates, their evaluation, and the choice."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from opalgrid.functions.text import parse_color_rules
from opalgrid.operators.trace import otsu
from opalgrid.sources.images import to_bgr

MAX_CANDIDATES, ADAPTIVE_RADIUS, ADAPTIVE_OFFSET = 5, 15, 8
BRIGHT = [((255, 255, 255), (128, 128, 128))]
SPACES = " \t\n\v\f\r"


@dataclass
class TextLine:
    x: int
    y: int
    w: int
    h: int
    confidence: float
    text: str


@dataclass
class Candidate:
    """A preprocessed image to be recognised; ``mask`` marks its foreground, if known."""

    name: str
    pixels: np.ndarray
    scale_x: float = 1.0
    scale_y: float = 1.0
    mask: np.ndarray | None = None


@dataclass
class Evaluation:
    target_groups: int = 0
    complete: bool = False
    coverage: float = 1.0
    leading: int = 0
    trailing: int = 0
    overlap_ratio: float = 0.0
    fragmented_pairs: int = 0
    suspicious: bool = True
    strong: bool = False
    mean_confidence: float = 0.0
    chars: int = 0
    high_confidence_chars: int = 0
    plausible_lines: int = 0
    quality: float = 0.0


@dataclass
class Recognition:
    """A recogniser's result: lines, and where lines were merged, the unmerged ones as well."""

    lines: list[TextLine]
    split: list[TextLine] | None = None
    boxes: int = 0


@dataclass
class Attempt:
    candidate: str
    evaluation: Evaluation | None
    reason: str = ""
    selected: bool = False


@dataclass
class Selection:
    lines: list[TextLine] = field(default_factory=list)
    attempts: list[Attempt] = field(default_factory=list)


def gray_rounded(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[:, :, c].astype(int) for c in range(3))
    return ((77 * r + 150 * g + 29 * b + 128) >> 8).astype(np.uint8)


def _three(gray: np.ndarray) -> np.ndarray:
    return np.repeat(gray[:, :, None], 3, 2)


def stretch(gray: np.ndarray) -> np.ndarray:
    """Contrast between the first and the last percent of the histogram, over 0..255."""
    h = np.bincount(gray.ravel(), minlength=256)
    part = gray.size // 100
    low = int(np.argmax(np.cumsum(h) >= part))
    high = 255 - int(np.argmax(np.cumsum(h[::-1]) >= part))
    if high <= low:
        low, high = 0, 255
    scaled = (gray.astype(int) - low) * 255 / max(1, high - low)
    return np.clip(np.trunc(scaled), 0, 255).astype(np.uint8)


def scale_for(width: int, height: int) -> float:
    return max(1.0, min(3.0, 1536 / max(width, height), math.sqrt(4e6 / (width * height))))


def useful(count: int, total: int) -> bool:
    return count > 0 and 1000 * count >= total and 100 * count <= 45 * total


def color_mask(bgr: np.ndarray, rules, binary: bool, antialias: bool = False) -> Candidate:
    """Foreground by colour rules; soft values fall with the distance from the colour."""
    best = np.zeros(bgr.shape[:2])
    hit = np.zeros(bgr.shape[:2], bool)
    for rgb, tolerance in rules:
        tol = np.array([min(96, max(t + 16, 2 * t)) if antialias else t for t in tolerance])[::-1]
        off = np.abs(bgr.astype(int) - np.array(rgb)[::-1])
        ok = (off <= tol).all(axis=2)
        score = 1 - (off / (tol + 1)).max(axis=2)
        best = np.where(ok, np.maximum(best, score), best)
        hit |= ok
    value = np.where(hit, 255 if binary else np.clip(np.rint(best * 255), 1, 255), 0).astype(np.uint8)
    return Candidate("color", _three(value), mask=hit)


def _half_pixel(n: int, size: int) -> tuple[np.ndarray, ...]:
    """Places of n samples over size pixels: lower and upper neighbour, share of the upper, nearest.

    All in 32 bits, as thresholds are compared with the results.  The share comes from the place
    before it is held inside the image, so the first samples of an enlarged edge still blend."""
    at = (np.arange(n, dtype=np.float32) + np.float32(0.5)) / (np.float32(n) / np.float32(size)) - np.float32(0.5)
    low = np.floor(at)
    inside = np.clip(low.astype(int), 0, size - 1)
    near = np.clip(np.floor(at.astype(float) + 0.5).astype(int), 0, size - 1)
    return inside, np.minimum(inside + 1, size - 1), np.clip(at - low, 0, 1), near


def enlarge(pixels: np.ndarray, height: int, width: int, nearest: bool = False) -> np.ndarray:
    y0, y1, fy, ny = _half_pixel(height, pixels.shape[0])
    x0, x1, fx, nx = _half_pixel(width, pixels.shape[1])
    if nearest:
        return pixels[ny][:, nx]
    a, one = pixels.astype(np.float32), np.float32(1)
    fx, fy = fx[None, :, None], fy[:, None, None]
    rows = [a[y][:, x0] * (one - fx) + a[y][:, x1] * fx for y in (y0, y1)]
    return np.clip(rows[0] * (one - fy) + rows[1] * fy, 0, 255).astype(np.uint8)


def resized(candidate: Candidate, scale: float, name: str, nearest: bool = False) -> Candidate:
    """The candidate enlarged; sizes round half up, and a scale of 1 leaves it as it is."""
    if np.float32(scale) <= np.float32(1.0001):
        return replace(candidate, name=name)
    h, w = candidate.pixels.shape[:2]
    nh, nw = (max(1, math.floor(float(np.float32(n) * np.float32(scale)) + 0.5)) for n in (h, w))
    sy, sx = np.float32(nh) / np.float32(h), np.float32(nw) / np.float32(w)
    mask = candidate.mask
    if mask is not None:
        at = [np.clip(np.floor(np.arange(n, dtype=np.float32) / s).astype(int), 0, m - 1) for n, s, m in ((nh, sy, h), (nw, sx, w))]
        mask = mask[at[0]][:, at[1]]
    return Candidate(name, enlarge(candidate.pixels, nh, nw, nearest), float(sx), float(sy), mask)


def otsu_candidates(gray: Candidate) -> list[Candidate]:
    value = gray.pixels[:, :, 0]
    at = otsu(np.bincount(value.ravel(), minlength=256))
    out = []
    for name, mask in (("otsu_bright_3x", value > at), ("otsu_dark_3x", value <= at)):
        if useful(int(mask.sum()), mask.size):
            out.append(replace(gray, name=name, pixels=_three(mask.astype(np.uint8) * 255), mask=mask))
    return out


def adaptive_masks(value: np.ndarray, radius: int = ADAPTIVE_RADIUS, offset: int = ADAPTIVE_OFFSET) -> tuple[np.ndarray, np.ndarray]:
    """(bright, dark): pixels that differ from their clipped window's mean by the offset."""
    h, w = value.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = value.astype(np.int64).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(0, np.arange(h) - radius), np.minimum(h, np.arange(h) + radius + 1)
    x0, x1 = np.maximum(0, np.arange(w) - radius), np.minimum(w, np.arange(w) + radius + 1)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    mean = total // ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return value >= mean + offset, value + offset <= mean


def adaptive_candidate(gray: Candidate) -> Candidate | None:
    masks = [m for m in adaptive_masks(gray.pixels[:, :, 0].astype(int)) if useful(int(m.sum()), m.size)]
    if not masks:
        return None
    aim = gray.pixels[:, :, 0].size * 8 // 100
    mask = min(masks, key=lambda m: abs(int(m.sum()) - aim))
    return replace(gray, name="adaptive_3x", pixels=_three(mask.astype(np.uint8) * 255), mask=mask)


def candidates(bgr: np.ndarray, rules=()) -> list[Candidate]:
    """Preprocessing hypotheses in their fixed order."""
    h, w = bgr.shape[:2]
    scale, total, out = scale_for(w, h), h * w, []

    def admit(count: int) -> bool:
        return count > 0 and 2000 * count >= total and 100 * count < 60 * total

    if rules:
        strict = 0
        for prefix, antialias in (("color", False), ("color_antialias", True)):
            soft = color_mask(bgr, rules, False, antialias)
            count = int(soft.mask.sum())
            if admit(count) and count >= strict:
                out.append(resized(soft, scale, f"{prefix}_soft_scaled"))
                out.append(resized(color_mask(bgr, rules, True, antialias), scale, f"{prefix}_binary_scaled", nearest=True))
            strict = count
    original = Candidate("original", bgr)
    out.append(original)
    scaled = resized(original, scale, "bgr_scaled")
    if scaled.pixels.shape != bgr.shape:
        out.append(scaled)
    gray = replace(scaled, name="gray_contrast_3x", pixels=_three(stretch(gray_rounded(scaled.pixels))))
    adaptive = adaptive_candidate(gray)
    return [*out, gray, *otsu_candidates(gray), *([adaptive] if adaptive else [])]


def remap(lines: list[TextLine], candidate: Candidate, width: int, height: int) -> list[TextLine]:
    """Lines of a scaled candidate in the original image, outwards to whole pixels."""
    sx, sy = candidate.scale_x, candidate.scale_y
    if sx <= 1.0001 and sy <= 1.0001:
        return list(lines)
    out = []
    for t in lines:
        x = min(max(math.floor(t.x / sx), 0), max(0, width - 1))
        y = min(max(math.floor(t.y / sy), 0), max(0, height - 1))
        w = min(max(math.ceil((t.x + t.w) / sx) - x, 1), max(1, width - x))
        h = min(max(math.ceil((t.y + t.h) / sy) - y, 1), max(1, height - y))
        out.append(replace(t, x=x, y=y, w=w, h=h))
    return out


def _chars(text: str) -> int:
    return sum(c not in SPACES for c in text)


def _support(candidate: Candidate, lines: list[TextLine], width: int) -> tuple[int, int, int, int]:
    """(active columns, covered ones, uncovered before the first, after the last covered one)."""
    at = np.clip(np.floor(np.arange(width) * candidate.scale_x).astype(int), 0, candidate.mask.shape[1] - 1)
    active = candidate.mask.any(axis=0)[at]
    covered = np.zeros(width, bool)
    for t in lines:
        covered[min(max(t.x, 0), width) : min(max(t.x + t.w, 0), width)] = True
    marks = covered[active]
    hits = np.flatnonzero(marks)
    if not len(hits):
        return len(marks), 0, len(marks), 0
    return len(marks), len(hits), int(hits[0]), int(len(marks) - 1 - hits[-1])


def evaluate(lines: list[TextLine], width: int, height: int, minimum: float, targets: list[list[str]] | None = None, candidate: Candidate | None = None, boxes: int | None = None) -> Evaluation:
    """Quality, coverage and flags of one candidate's lines."""
    e = Evaluation()
    area = max(1, width) * max(1, height)
    kept = [t for t in lines if t.text and t.w > 0 and t.h > 0]
    sure = [min(max(t.confidence, 0.0), 1.0) if math.isfinite(t.confidence) else 0.0 for t in kept]
    sizes = [_chars(t.text) for t in kept]
    share = [t.w * t.h / area for t in kept]
    e.chars = sum(sizes)
    best = max(sure, default=0.0)
    passes = [c >= minimum for c in sure]
    full_frame = any(s >= 0.85 or (t.w >= width * 9 // 10 and t.h >= height * 9 // 10) for s, t in zip(share, kept))
    counted = [(n, c) for n, c in zip(sizes, sure) if c >= 0.20 and n > 0]
    plausible = [n for n, c, s in zip(sizes, sure, share) if c >= 0.50 and n > 0 and s < 0.85]
    e.high_confidence_chars, e.plausible_lines = sum(plausible), len(plausible)
    e.quality = sum(n * c * c for n, c in counted) + 1.5 * len(plausible)
    weight = sum(n for n, _ in counted)
    e.mean_confidence = sum(n * c for n, c in counted) / weight if weight else 0.0
    e.target_groups = sum(any(v and v in t.text for ok, t in zip(passes, kept) if ok for v in group) for group in targets or [])
    if candidate is not None and candidate.mask is not None and candidate.mask.any():
        active, covered, e.leading, e.trailing = _support(candidate, kept, width)
        e.coverage = covered / active if active else 1.0
        edge = max(2, math.ceil(height * 0.15))
        e.complete = e.coverage >= 0.92 and e.leading <= edge and e.trailing <= edge
    elif candidate is not None and candidate.mask is None:
        e.complete = True
    if not lines or not e.chars:
        e.coverage, e.complete = 0.0, False
    for a, b in zip(lines, lines[1:]):
        shared = max(0, min(a.y + a.h, b.y + b.h) - max(a.y, b.y))
        reach = sum(max(1, math.ceil(t.h * 0.25)) for t in (a, b))
        e.fragmented_pairs += 2 * shared >= min(a.h, b.h) and b.x - (a.x + a.w) < reach
    if len(lines) >= 2:
        e.overlap_ratio = e.fragmented_pairs / (len(lines) - 1)
    alone = False
    if len(lines) == 1 and max(width, height) <= 512:
        t = lines[0]
        unsure = best < 0.80 and max(0, height - t.h) >= t.h + 8
        tail = max(math.ceil(t.h * 1.5), math.ceil(width * 0.15))
        gap = width >= 3 * height and max(0, t.x) <= max(2, t.h // 2) and max(0, width - t.x - t.w) >= tail and 100 * t.w < 85 * width
        alone = unsure or gap
    shattered = boxes is not None and boxes >= 3 and e.overlap_ratio >= 0.50
    readable = any(ok and n > 0 for ok, n in zip(passes, sizes))
    e.suspicious = not readable or best < 0.35 or full_frame or alone or not e.complete or shattered
    e.strong = not e.suspicious and e.high_confidence_chars >= 4 and e.mean_confidence >= 0.75 and e.target_groups == len(targets or [])
    return e


def better(a: Evaluation, b: Evaluation) -> bool:
    """Whether a is preferred to b.  Margins make this no order: fold, do not sort."""
    if a.target_groups != b.target_groups:
        return a.target_groups > b.target_groups
    if a.complete != b.complete:
        return a.complete
    single, cover, share = np.float32, np.float32(0.05), np.float32(0.20)
    # a gain of the whole margin decides for coverage, but only more than it for overlaps
    if single(a.coverage) >= single(b.coverage) + cover or single(b.coverage) >= single(a.coverage) + cover:
        return a.coverage > b.coverage
    if single(a.overlap_ratio) + share < single(b.overlap_ratio) or single(b.overlap_ratio) + share < single(a.overlap_ratio):
        return a.overlap_ratio < b.overlap_ratio
    if a.suspicious != b.suspicious:
        return b.suspicious
    if single(a.mean_confidence) >= single(b.mean_confidence) + single(0.05) and a.chars >= b.chars:
        return True
    if a.chars > b.chars and single(a.mean_confidence) + single(0.10) >= single(b.mean_confidence):
        return True
    return a.quality > 0 if b.quality <= 0 else a.quality >= 1.10 * b.quality


def rejection(lost: Evaluation, won: Evaluation) -> str:
    """Why a candidate lost, the weightiest reason first."""
    reasons = (
        (lost.target_groups < won.target_groups, "the winner holds more of the wanted texts"),
        (won.complete and not lost.complete, "it leaves part of the foreground unread"),
        (lost.coverage + 0.05 < won.coverage, "it covers less of the foreground"),
        (lost.overlap_ratio > won.overlap_ratio + 0.20, "its lines are more broken up"),
        (lost.suspicious and not won.suspicious, "its shape or confidence is doubtful"),
        (lost.mean_confidence + 0.05 < won.mean_confidence, "it is less sure"),
        (lost.chars < won.chars, "it is shorter"),
    )
    return next((text for holds, text in reasons if holds), "the winner scores higher on the whole")


def confident(lines: list[TextLine], minimum: float, rule: str = "finite") -> list[TextLine]:
    """Lines of at least the minimum confidence.  What is no number goes with the rules ``finite`` (infinite
    ones too) and ``reached``, and stays with ``not_below``."""
    keep = {
        "finite": lambda c: math.isfinite(c) and c >= minimum,
        "reached": lambda c: c >= minimum,
        "not_below": lambda c: not c < minimum,
    }[rule]
    return [t for t in lines if keep(t.confidence)]


def recognize(bgr: np.ndarray, recognizer: Callable[[np.ndarray], Recognition], rules=(), minimum: float = 0.0, targets: list[list[str]] | None = None) -> Selection:
    """Recognises candidates in order, at most five, until one is strong; keeps the preferred one.

    A recogniser that raises fails its candidate only; if all fail the last error is raised."""
    if not 0 <= minimum <= 1:
        raise ValueError("the minimum confidence must lie in 0..1")
    h, w = bgr.shape[:2]
    out = Selection()
    best: tuple[Evaluation, list[TextLine], Attempt] | None = None
    support: Candidate | None = None
    failure: Exception | None = None

    def measure(lines, candidate, boxes) -> Evaluation:
        e = evaluate(lines, w, h, minimum, targets, candidate, boxes)
        if support is not None:
            s = evaluate(lines, w, h, minimum, targets, support, boxes)
            e.coverage, e.leading, e.trailing = min(e.coverage, s.coverage), max(e.leading, s.leading), max(e.trailing, s.trailing)
            e.complete &= s.complete
            e.suspicious |= not e.complete
            e.strong &= e.complete
        return e

    def attempt(candidate: Candidate) -> Evaluation:
        nonlocal best, failure
        try:
            found = recognizer(candidate.pixels)
        except Exception as error:  # noqa: BLE001  the caller's code may raise anything
            failure = error
            out.attempts.append(Attempt(candidate.name, None, str(error) or "recognition failed"))
            return Evaluation()
        lines = remap(found.lines, candidate, w, h)
        own = Attempt(candidate.name, measure(lines, candidate, found.boxes))
        out.attempts.append(own)
        if found.split:
            own.candidate += "/merged"
            parts = remap(found.split, candidate, w, h)
            other = Attempt(candidate.name + "/split", measure(parts, candidate, found.boxes))
            out.attempts.append(other)
            if better(other.evaluation, own.evaluation):
                own.reason = rejection(own.evaluation, other.evaluation)
                own, lines = other, parts
            else:
                other.reason = rejection(other.evaluation, own.evaluation)
        if best is None or better(own.evaluation, best[0]):
            if best is not None:
                best[2].reason = rejection(best[0], own.evaluation)
            best = own.evaluation, lines, own
        else:
            own.reason = rejection(own.evaluation, best[0])
        return own.evaluation

    def find_support() -> Candidate | None:
        gray = Candidate("source_gray", _three(gray_rounded(bgr)))
        return next(iter(otsu_candidates(gray)), None)

    def plan() -> Iterator[tuple[Candidate, bool]]:
        """(candidate, whether to stop as soon as it is not suspicious)."""
        nonlocal support
        if rules:
            support = find_support()
            for c in candidates(bgr, rules):
                yield c, False
            return
        yield Candidate("original", bgr), True
        support = find_support()
        if w <= 512 and h <= 256:
            yield resized(color_mask(bgr, BRIGHT, False), 1.0, "auto_bright_soft_scaled"), False
        for c in candidates(bgr):
            if c.name != "original":
                yield c, False

    for executed, (candidate, easy) in enumerate(plan(), 1):
        e = attempt(candidate)
        if best is not None and (e.strong or easy and not e.suspicious) or executed >= MAX_CANDIDATES:
            break
    if best is None:
        raise failure or RuntimeError("nothing was recognised")
    best[2].selected, best[2].reason = True, ""
    out.lines = confident(best[1], minimum)
    return out


LINES = "image_id string, line_no int, x int, y int, w int, h int, confidence double, text string, candidate string, status int, error string"


def recognize_images(images: DataFrame, recognizer: Callable[[np.ndarray], Recognition], rules: str = "", minimum: float = 0.0, targets: list[list[str]] | None = None) -> DataFrame:
    """One row per recognised line; an image that fails gives one row with its error."""
    parsed = parse_color_rules(rules)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                try:
                    bgr, _ = to_bgr(bytes(r.data), int(r.height), int(r.width), int(r.format))
                    found = recognize(bgr, recognizer, parsed, minimum, targets)
                    name = next((a.candidate for a in found.attempts if a.selected), None)
                    rows += [(r.image_id, n, t.x, t.y, t.w, t.h, t.confidence, t.text, name, 0, None) for n, t in enumerate(found.lines)]
                except Exception as error:  # noqa: BLE001  one image does not fail the job
                    rows.append((r.image_id, None, None, None, None, None, None, None, None, -1, str(error)))
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])
            yield made.astype({c: "Int32" for c in ("line_no", "x", "y", "w", "h")})

    return images.mapInPandas(run, LINES)
