"""Text reading from two models: a detector's probability map, crops of its boxes, a line decoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from opalgrid.operators import boxes as B
from opalgrid.operators import decode as D
from opalgrid.operators.recognize import Recognition, TextLine

ALIGN, SMALL_HEIGHT = 32, 64


def aligned(n: int) -> int:
    """A side of the detector's input: the nearest multiple of 32, at least one."""
    return max(ALIGN, (n + ALIGN // 2) // ALIGN * ALIGN)


class TextReader:
    """A recogniser: ``detect`` maps a tensor to (H, W) probabilities, ``read`` a batch of line tensors to
    logits, (n, T, classes) or (n, classes, T).  Without ``detect`` the whole image is one line.

    The lines of a small image whose boxes are fragments of one line are read twice: joined, and, for
    the caller to choose, as they were.  A batch that fails is read line by line."""

    def __init__(self, detect: Callable[[np.ndarray], np.ndarray] | None, read: Callable[[np.ndarray], np.ndarray], chars: list[str], beam: int = 0, batch: int = 8, padding: float = 0.25):
        self.detect, self.read, self.chars, self.beam, self.batch, self.padding = detect, read, chars, beam, batch, padding

    def boxes(self, bgr: np.ndarray) -> list[tuple[int, int, int, int]]:
        h, w = bgr.shape[:2]
        if self.detect is None:
            return [(0, 0, w, h)]
        prob = np.asarray(self.detect(D.text_detector_tensor(bgr, aligned(h), aligned(w))), np.float32)
        return B.detect_text(prob, w, h)

    def decode(self, logits: np.ndarray) -> tuple[str, float]:
        if D.class_axis(logits.shape, len(self.chars)) == -2:
            logits = logits.T
        found, sure = D.greedy(logits)
        if self.beam:
            found = D.beam_search(logits, self.beam, len(self.chars))
        return "".join(self.chars[i] for i in found if i < len(self.chars)), sure

    def _read(self, tensors: list[np.ndarray]) -> list[np.ndarray]:
        try:
            return list(self.read(np.stack(tensors)))
        except Exception:  # noqa: BLE001  the caller's model may raise anything
            if len(tensors) == 1:
                raise
            return [self.read(t[None])[0] for t in tensors]

    def lines(self, bgr: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> list[TextLine]:
        crops = [D.crop_for_recognition(bgr, b) for b in boxes]
        out: list[TextLine | None] = [None] * len(boxes)
        for group in D.width_batches([c.shape[2] for c in crops], self.batch):
            for i, logits in zip(group, self._read([crops[i] for i in group])):
                text, sure = self.decode(np.asarray(logits))
                out[i] = TextLine(*boxes[i], sure, text)
        return out

    def __call__(self, bgr: np.ndarray) -> Recognition:
        boxes = self.boxes(bgr)
        if bgr.shape[0] <= SMALL_HEIGHT and len(boxes) >= 3 and len(B.reading_lines(boxes)) == 1:
            merged = [b[:4] for b in B.merge_fragments(boxes, self.padding)]
            if len(merged) < len(boxes):
                return Recognition(self.lines(bgr, merged), self.lines(bgr, boxes), len(boxes))
        return Recognition(self.lines(bgr, boxes), None, len(boxes))
