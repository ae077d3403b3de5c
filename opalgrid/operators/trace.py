"""Stroke tracing: thinning, ordered paths, a point budget, and the result as JSON."""

from __future__ import annotations

import json

import numpy as np

from opalgrid.operators.boxes import label_components

# Clockwise from the pixel above: (dy, dx).
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
POINTS, MOST_POINTS = 4096, 100_000


def otsu(histogram: np.ndarray) -> int:
    """First threshold with the largest between-class variance; 127 for an empty histogram."""
    h = histogram.astype(float)
    total, mass = h.sum(), (h * np.arange(256)).sum()
    below, sums = np.cumsum(h), np.cumsum(h * np.arange(256))
    ok = (below > 0) & (below < total)
    if not ok.any():
        return 127
    above = total - below
    spread = np.where(ok, below * above * (sums / np.where(below > 0, below, 1) - (mass - sums) / np.where(above > 0, above, 1)) ** 2, -1.0)
    return int(np.argmax(spread))


def _ring(image: np.ndarray) -> np.ndarray:
    padded = np.pad(image, 1)
    h, w = image.shape
    return np.stack([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in RING])


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen skeleton; pixels on the border stay, images under 3 x 3 are left alone."""
    image = mask.astype(np.uint8)
    h, w = image.shape
    if h < 3 or w < 3:
        return image.astype(bool)
    inner = np.zeros((h, w), bool)
    inner[1:-1, 1:-1] = True
    # of the neighbours above, right, below and left, the triples that may not all be set
    triples = (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6)))
    for _ in range(min(128, max(h, w))):
        changed = False
        for step in triples:
            ring = _ring(image)
            n = ring.sum(axis=0)
            rises = ((ring == 0) & (np.roll(ring, -1, axis=0) == 1)).sum(axis=0)
            go = inner & (image == 1) & (n >= 2) & (n <= 6) & (rises == 1)
            for t in step:
                go &= ring[list(t)].prod(axis=0) == 0
            image[go] = 0
            changed |= bool(go.any())
        if not changed:
            break
    return image.astype(bool)


def paths(skeleton: np.ndarray) -> list[list[tuple[int, int]]]:
    """Pixels (y, x) of each 8-connected component in walking order.

    A walk starts at the first end point (else the first pixel) and goes depth-first to neighbours
    with fewer neighbours first, then in row-major order.  Components come by top, left, size."""
    labels = label_components(skeleton, eight=True)
    degree = _ring(skeleton.astype(np.uint8)).sum(axis=0)
    out, places = [], np.argwhere(labels > 0)  # row-major
    own = labels[labels > 0]
    order = np.argsort(own, kind="stable")
    for part in np.split(places[order], np.flatnonzero(np.diff(own[order])) + 1) if len(own) else []:
        pixels = [tuple(p) for p in part.tolist()]
        ends = [p for p in pixels if degree[p] <= 1]
        own, walk, stack = set(pixels), [], [(ends or pixels)[0]]
        while stack:
            p = stack.pop()
            if p not in own:
                continue
            own.discard(p)
            walk.append(p)
            near = [q for q in ((p[0] + dy, p[1] + dx) for dy, dx in RING) if q in own]
            stack += sorted(near, key=lambda q: (degree[q], q), reverse=True)
        out.append(walk)
    return sorted(out, key=lambda w: (min(p[0] for p in w), min(p[1] for p in w), -len(w)))


def budget(walks: list[list], limit: int = 0) -> list[list]:
    """At most ``limit`` points over all paths (4096 if 0); the path that does not fit is thinned
    evenly, later ones go."""
    left = POINTS if limit <= 0 else min(limit, MOST_POINTS)
    out = []
    for walk in walks:
        n, k = len(walk), min(len(walk), left)
        if not left:
            break
        out.append(walk if k == n else [walk[i * (n - 1) // (k - 1)] if k > 1 else walk[0] for i in range(k)])
        left -= k
    return out


def trace(gray: np.ndarray, threshold: int = -1, invert: bool = False, roi=None, max_points: int = 0) -> dict:
    """Foreground, skeleton and paths of a gray image; threshold -1 is Otsu's."""
    x0, y0, w, h = roi or (0, 0, gray.shape[1], gray.shape[0])
    part = gray[y0 : y0 + h, x0 : x0 + w]
    at = otsu(np.bincount(part.ravel(), minlength=256)) if threshold < 0 else threshold
    mask = part <= at if invert else part >= at
    skeleton = thin(mask)
    found = paths(skeleton)
    made = []
    for whole, walk in zip(found, budget(found, max_points)):
        ys, xs = [p[0] for p in whole], [p[1] for p in whole]
        made.append({"bounds": {"x": x0 + min(xs), "y": y0 + min(ys), "w": max(xs) - min(xs) + 1, "h": max(ys) - min(ys) + 1}, "points": [[x0 + x, y0 + y] for y, x in walk]})
    return {
        "width": w,
        "height": h,
        "roi": {"x": x0, "y": y0, "w": w, "h": h},
        "threshold": at,
        "invert": invert,
        "foreground_pixels": int(mask.sum()),
        "skeleton_pixels": int(skeleton.sum()),
        "max_points": POINTS if max_points <= 0 else min(max_points, MOST_POINTS),
        "paths": made,
        "path_count": len(made),
        "point_count": sum(len(p["points"]) for p in made),
    }


def trace_json(gray: np.ndarray, **options) -> str:
    return json.dumps(trace(gray, **options), separators=(",", ":"))
