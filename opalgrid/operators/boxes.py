"""Boxes: suppression, reading order, fragment merging, text regions of a probability map."""

from __future__ import annotations

import math
from bisect import insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.functions.pixels import intersection, iou

TEMPLATE_OVERLAP, DETECTION_OVERLAP, CELL = 0.30, 0.45, 64
ORDERED_BOX = "image_id bigint, line_no int, pos int, detection_index int, x int, y int, w int, h int"


def overlap_pairs(boxes: DataFrame, group: str, key: str, cell: int = CELL) -> DataFrame:
    """Pairs of boxes of one group (key < key2) with a shared area, and their IoU.

    Boxes meet in the cells of a grid that they touch, not in all pairs of a group; a pair counts in
    the cell that holds its shared area's first corner."""
    at = lambda c: F.floor(c / cell)
    box = F.struct("x", "y", "w", "h")
    covers = lambda c, n: F.sequence(at(F.col(c)), at(F.col(c) + F.greatest(F.col(n), F.lit(1)) - 1))
    rows = boxes.select(group, F.col(key).alias("key"), box.alias("box"), F.explode(covers("x", "w")).alias("cx"), covers("y", "h").alias("cys")).select(group, "key", "box", "cx", F.explode("cys").alias("cy"))
    a = rows.select(group, "cx", "cy", F.col("key").alias("key_a"), F.col("box").alias("a"))
    b = rows.select(group, "cx", "cy", F.col("key").alias("key_b"), F.col("box").alias("b"))
    both = a.join(b, [group, "cx", "cy"]).where(F.col("key_a") < F.col("key_b"))
    first = lambda c: at(F.greatest(F.col("a")[c], F.col("b")[c]))
    shared = intersection(F.col("a"), F.col("b"))
    return both.where((shared > 0) & (first("x") == F.col("cx")) & (first("y") == F.col("cy"))).select(group, "key_a", "key_b", iou(F.col("a"), F.col("b")).alias("iou"))


def keep_greedily(box: np.ndarray, limit: float) -> list[int]:
    """Rows of (x, y, w, h), in order, that share no more than ``limit`` with a row kept before them."""
    if len(box) == 1:
        return [0]
    low, high = box[:, :2], box[:, :2] + box[:, 2:]
    area = box[:, 2] * box[:, 3]
    alive = np.ones(len(box), bool)
    for i in range(len(box)):
        if alive[i]:
            side = np.maximum(0, np.minimum(high[i], high[i + 1 :]) - np.maximum(low[i], low[i + 1 :]))
            shared = side[:, 0] * side[:, 1]
            union = area[i] + area[i + 1 :] - shared
            alive[i + 1 :] &= ~(np.divide(shared, union, out=np.zeros(len(union)), where=union > 0) > limit)
    return np.flatnonzero(alive).tolist()


def suppress(boxes: DataFrame, group: list[str], order: list[Column], overlap: float, fields: list[str]) -> DataFrame:
    """Greedy suppression inside each group, in the given (total) order; fields hold x, y, w and h.

    A box stays unless its IoU with a box that stayed before it is over ``overlap`` (strictly).  A
    group's boxes meet in one row; NumPy walks them, one kept box at a time."""
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("box"))
    listed = boxes.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("boxes"))
    listed = listed.select(*group, F.transform("boxes", lambda b: b["box"]).alias("boxes"))
    types = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*group, *fields))

    def run(batches):
        for batch in batches:
            lists = batch.column("boxes")
            flat = lists.flatten()
            box = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xywh"])
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            rows, owners = [], []
            for i, (lo, hi) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                kept = keep_greedily(box[lo:hi], overlap)
                rows += [lo + k for k in kept]
                owners += [i] * len(kept)
            rows, owners = pa.array(rows, pa.int64()), pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owners) for c in group), *(flat.field(c).take(rows) for c in fields)], names=[*group, *fields])

    return listed.mapInArrow(run, schema)


@dataclass
class Line:
    """Boxes of one text line with running medians of doubled centres and of heights."""

    members: list[int] = field(default_factory=list)
    centers: list[int] = field(default_factory=list)
    heights: list[int] = field(default_factory=list)
    top: int = 2**31

    @staticmethod
    def _median(values: list[int]) -> int:
        n = len(values)
        middle = values[n // 2]
        return middle if n % 2 else int((values[n // 2 - 1] + middle) / 2)  # truncates towards zero

    def add(self, index: int, y: int, h: int) -> None:
        self.members.append(index)
        insort(self.centers, 2 * y + h)
        insort(self.heights, max(1, h))
        self.top = min(self.top, y)

    @property
    def center(self) -> int:
        return self._median(self.centers)

    @property
    def height(self) -> int:
        return max(1, self._median(self.heights))


def reading_lines(boxes: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Indices of (x, y, w, h) boxes by text line, in reading order.

    Boxes go by centre to the line that they overlap most (at least half of the smaller height, or
    with centres within 0.35 of it); ties go to the nearer centre, then to the older line."""
    lines: list[Line] = []
    for i in sorted(range(len(boxes)), key=lambda i: (2 * boxes[i][1] + boxes[i][3], boxes[i][0], i)):
        _, y, _, h = boxes[i]
        tall, best = max(1, h), None
        for n, line in enumerate(lines):
            center, height = line.center, line.height
            top = int((center - height) / 2)
            smaller = min(tall, height)
            shared = np.float32(max(0, min(y + tall, top + height) - max(y, top))) / np.float32(smaller)
            distance = abs(2 * y + tall - center)
            if shared >= 0.5 or np.float32(distance) <= np.float32(0.7) * np.float32(smaller):
                rank = (-shared, distance, n)
                best = rank if best is None or rank < best else best
        if best is None:
            lines.append(Line())
            best = (0, 0, len(lines) - 1)
        lines[best[2]].add(i, y, h)
    lines.sort(key=lambda line: (line.center, line.top, min(line.members)))
    return [sorted(line.members, key=lambda i: (boxes[i][0], boxes[i][1], i)) for line in lines]


def merge_fragments(boxes: list[tuple[int, int, int, int]], padding_ratio: float = 0.25) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, fragments) after joining the fragments of split words inside each line.

    Neighbours within 1.5 line heights form a run.  Two boxes join if they overlap; three or more
    if two pairs overlap, or if one does and the run is compact."""
    out = []
    for line in reading_lines(boxes):
        run: list[int] = []
        runs = [run]
        tall = sorted(max(1, boxes[i][3]) for i in line)
        height = Line._median(tall)
        reach = max(2, math.ceil(np.float32(height) * np.float32(1.5)))
        for i in line:
            if run and boxes[i][0] - boxes[run[-1]][0] - boxes[run[-1]][2] > reach:
                run = []
                runs.append(run)
            run.append(i)
        for run in runs:
            own = [boxes[i] for i in run]
            gaps = [b[0] - a[0] - a[2] for a, b in zip(own, own[1:])]
            pads = [max(1, math.ceil(np.float32(max(1, b[3])) * np.float32(padding_ratio))) for b in own]
            left, right = min(b[0] for b in own), max(b[0] + b[2] for b in own)
            touching = sum(g < 0 for g in gaps)
            near = any(g < p + q for g, p, q in zip(gaps, pads, pads[1:]))
            compact = np.float32(sum(b[2] for b in own)) / np.float32(max(1, right - left)) >= np.float32(0.85)
            if touching if len(own) == 2 else len(own) > 2 and (touching >= 2 or touching and near and compact):
                top, bottom = min(b[1] for b in own), max(b[1] + b[3] for b in own)
                out.append((left, top, max(1, right - left), max(1, bottom - top), len(own)))
            else:
                out += [(*b, 1) for b in own]
    return out


def reading_order(boxes: DataFrame) -> DataFrame:
    """(image_id, line_no, pos, detection_index, x, y, w, h): boxes of each image in reading order.

    Needs (image_id, detection_index, x, y, w, h); an image's boxes meet in one task."""
    item = F.struct("detection_index", "x", "y", "w", "h")
    return order_lists(boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("boxes")))


def order_lists(listed: DataFrame) -> DataFrame:
    """``reading_order`` of rows (image_id, boxes): one list of structs with x, y, w, h per image, and with
    detection_index or else numbered by place."""

    def run(batches):
        for batch in batches:
            flat = batch.column("boxes").flatten()
            ends = np.cumsum(batch.column("boxes").value_lengths().to_numpy(zero_copy_only=False)).tolist()
            own = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in "xywh"}
            box = list(zip(*(v.tolist() for v in own.values())))
            rows, owner, line_no, pos = [], [], [], []
            for i, (lo, hi) in enumerate(zip([0, *ends], ends)):
                lines = reading_lines(box[lo:hi])
                order = [k for line in lines for k in line]
                rows += [lo + k for k in order]
                owner += [i] * len(order)
                line_no += [n for n, line in enumerate(lines) for _ in line]
                pos += range(len(order))
            at = np.array(rows, np.int64)
            place = at - np.array([0, *ends], np.int64)[np.array(owner, np.int64)]
            index = flat.field("detection_index").to_numpy(zero_copy_only=False)[at] if flat.type.get_field_index("detection_index") >= 0 else place
            yield pa.record_batch(
                {
                    "image_id": batch.column("image_id").take(pa.array(owner, pa.int64())),
                    **{k: pa.array(np.array(v, np.int32)) for k, v in (("line_no", line_no), ("pos", pos), ("detection_index", index))},
                    **{c: pa.array(v[at].astype(np.int32)) for c, v in own.items()},
                }
            )

    return listed.select(F.col("image_id").cast("long").alias("image_id"), "boxes").mapInArrow(run, ORDERED_BOX)


def merge_lists(listed: DataFrame, padding_ratio: float = 0.25) -> DataFrame:
    """(image_id, n, x, y, w, h, fragments): ``merge_fragments`` of rows (image_id, boxes), in reading order."""

    def run(batches):
        for batch in batches:
            flat = batch.column("boxes").flatten()
            ends = np.cumsum(batch.column("boxes").value_lengths().to_numpy(zero_copy_only=False)).tolist()
            box = list(zip(*(flat.field(c).to_pylist() for c in "xywh")))
            merged = [merge_fragments(box[lo:hi], padding_ratio) for lo, hi in zip([0, *ends], ends)]
            owner = [i for i, m in enumerate(merged) for _ in m]
            table = np.array([(n, *b) for m in merged for n, b in enumerate(m)], np.int32).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(owner, pa.int64())), *(pa.array(c) for c in table.T)], names=["image_id", "n", "x", "y", "w", "h", "fragments"])

    return listed.select(F.col("image_id").cast("long").alias("image_id"), "boxes").mapInArrow(run, "image_id long, n int, x int, y int, w int, h int, fragments int")


def label_components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Component labels from 1 in row-major order of first pixels; 0 is background."""
    h, w = mask.shape
    big = h * w
    label = np.where(mask, np.arange(big).reshape(h, w), big)
    shifts = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    while True:
        new = label.copy()
        for dy, dx in shifts:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
            both = mask[a] & mask[b]
            low = np.minimum(new[a], new[b])
            np.minimum(new[a], low, out=new[a], where=both)  # a and b overlap: never raise a label
            np.minimum(new[b], low, out=new[b], where=both)
        flat = np.append(new.ravel(), big)
        jumped = np.where(mask, flat[flat[new]], big)  # a label leads to its own pixel's label
        if (jumped == label).all():
            break
        label = jumped
    roots = np.unique(label[mask])
    out = np.zeros((h, w), np.int64)
    out[mask] = np.searchsorted(roots, label[mask]) + 1
    return out


def text_boxes(prob: np.ndarray, threshold: float = 0.3, box_threshold: float = 0.6, min_area: int = 10, ratio: float = 1.5, eight: bool = True) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of a detector's probability map.

    Components that are large and sure enough are primary.  Each other one is added, in label order,
    to the primary box with the smallest horizontal gap within reach, which grows at once."""
    labels = label_components(prob >= np.float32(threshold), eight)
    n = int(labels.max(initial=0))
    if not n:
        return []
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs] - 1
    area = np.bincount(own, minlength=n)
    score = np.bincount(own, prob[ys, xs].astype(float), n)
    box = np.empty((n, 4), np.int64)
    box[:, :2], box[:, 2:] = 2**31, -1
    for c, v in ((0, xs), (1, ys)):
        np.minimum.at(box[:, c], own, v)
        np.maximum.at(box[:, c + 2], own, v)
    primary = np.flatnonzero((area >= min_area) & (score / np.maximum(1, area) >= np.float32(box_threshold)))
    if not len(primary):
        return []
    for s in np.setdiff1d(np.arange(n), primary):
        p = box[primary]
        main_h, small_h = p[:, 3] - p[:, 1] + 1, box[s, 3] - box[s, 1] + 1
        drop = np.maximum(0, np.maximum(p[:, 1], box[s, 1]) - np.minimum(p[:, 3], box[s, 3]) - 1)
        gap = np.maximum(0, np.maximum(box[s, 0] - p[:, 2], p[:, 0] - box[s, 2]) - 1)
        fits = (drop <= np.maximum(main_h, small_h) // 2) & (gap <= np.maximum(4, main_h))
        if fits.any():
            m = primary[np.argmin(np.where(fits, gap, 2**31))]
            box[m] = *np.minimum(box[m, :2], box[s, :2]), *np.maximum(box[m, 2:], box[s, 2:])
            area[m] += area[s]
            score[m] += score[s]
    out = []
    h, w = prob.shape
    for m in primary:
        if score[m] / area[m] < np.float32(box_threshold):
            continue
        bw, bh = box[m, 2] - box[m, 0] + 1, box[m, 3] - box[m, 1] + 1
        grow = math.ceil(np.float32(bw * bh) * np.float32(max(0.0, ratio)) / np.float32(2 * (bw + bh)))
        x, y = max(0, box[m, 0] - grow), max(0, box[m, 1] - grow)
        out.append((int(x), int(y), int(max(1, min(w, box[m, 2] + grow + 1) - x)), int(max(1, min(h, box[m, 3] + grow + 1) - y))))
    return out


def map_to_image(boxes: list[tuple[int, int, int, int]], scale_x: float, scale_y: float, width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Map boxes in image coordinates: places truncate, sizes round half up, empty boxes go."""
    out = []
    for x, y, w, h in boxes:
        left, top = max(0, int(x * scale_x)), max(0, int(y * scale_y))
        right, bottom = min(width, left + math.floor(w * scale_x + 0.5)), min(height, top + math.floor(h * scale_y + 0.5))
        if right > left and bottom > top:
            out.append((left, top, right - left, bottom - top))
    return out


def detect_text(prob: np.ndarray, width: int, height: int, **options) -> list[tuple[int, int, int, int]]:
    """Text boxes in reading order.

    In a small image a split of one line along diagonals is taken back: where 4-connected
    components give three boxes or more and 8-connected ones fewer, both on a single line, the
    8-connected boxes stand."""
    h, w = prob.shape
    four = map_to_image(text_boxes(prob, eight=False, **options), width / w, height / h, width, height)
    if height <= 64 and len(four) >= 3:
        eight = map_to_image(text_boxes(prob, eight=True, **options), width / w, height / h, width, height)
        if eight and len(eight) < len(four) and len(reading_lines(four)) == len(reading_lines(eight)) == 1:
            four = eight
    return [four[i] for line in reading_lines(four) for i in line]


def offset_boxes(boxes: DataFrame, group: str, dx: int, dy: int, columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Boxes moved by an origin.  If one box of a group leaves the 32-bit range, the group stays as
    it was and ``rejected`` is set on all its rows."""
    from pyspark.sql import Window

    fits = F.lit(True)
    for c, by in zip(columns, (dx, dy)):
        fits = fits & (F.col(c).cast("long") + by).between(-(2**31), 2**31 - 1)
    all_fit = F.min(fits).over(Window.partitionBy(group))
    out = boxes.withColumn("rejected", ~all_fit)
    for c, by in zip(columns, (dx, dy)):
        out = out.withColumn(c, F.when(F.col("rejected"), F.col(c)).otherwise((F.col(c).cast("long") + by).try_cast("int")))
    return out
