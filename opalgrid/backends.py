"""Recogniser and detector interfaces, deterministic mocks, and a model registry."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Protocol

import numpy as np

from opalgrid.operators.recognize import Recognition, TextLine


class Recognizer(Protocol):
    def __call__(self, bgr: np.ndarray) -> Recognition: ...


class Detector(Protocol):
    def __call__(self, bgr: np.ndarray, confidence: float) -> list[dict]: ...


def null_recognizer(bgr: np.ndarray) -> Recognition:
    raise RuntimeError("no recogniser is loaded")


def mock_recognizer(lines: list[str]) -> Recognizer:
    """Equal horizontal bands, one for each given line, at confidence 0.99."""

    def run(bgr: np.ndarray) -> Recognition:
        h, w = bgr.shape[:2]
        n = max(1, len(lines))
        edge = [h * i // n for i in range(n + 1)]
        return Recognition([TextLine(0, edge[i], w, max(1, edge[i + 1] - edge[i]), 0.99, t) for i, t in enumerate(lines)], boxes=len(lines))

    return run


def mock_detector(count: int = 1) -> Detector:
    """``count`` boxes from 20 % to 70 % of the image, moved by a thousandth each."""

    def run(bgr: np.ndarray, confidence: float = 0.25) -> list[dict]:
        h, w = bgr.shape[:2]
        if confidence > 0.99:
            return []
        return [
            {"x1": w * (0.2 + m), "y1": h * (0.2 + m), "x2": w * (0.7 + m), "y2": h * (0.7 + m), "score": 0.99, "class_id": i % 3}
            for i, m in ((i, 0.001 * (i % 10)) for i in range(count))
        ]

    return run


@dataclass
class Models:
    """Models by handle, each Empty, Loading, Loaded or closed.  A loaded handle is not reloaded."""

    states: dict[int, str] = field(default_factory=dict)
    models: dict[int, object] = field(default_factory=dict)
    latency_us: dict[str, int] = field(default_factory=dict)

    def create(self) -> int:
        handle = max(self.states, default=0) + 1
        self.states[handle] = "Empty"
        return handle

    def load(self, handle: int, make: Callable[[], object]) -> None:
        state = self.states[handle]
        if state != "Empty":
            raise RuntimeError("already loaded" if state == "Loaded" else "busy")
        self.states[handle] = "Loading"
        try:
            self.models[handle] = make()
            self.states[handle] = "Loaded"
        except BaseException:
            self.states[handle] = "Empty"
            raise

    def load_bytes(self, handle: int, data: bytes, make: Callable[[bytes], object]) -> None:
        """Loads a model from memory."""
        if not data:
            raise ValueError("an empty model")
        self.load(handle, lambda: make(data))

    def load_file(self, handle: int, path: str, make: Callable[[bytes], object]) -> None:
        """Loads a model from a file of the driver; a missing one leaves the handle empty."""
        self.load(handle, lambda: make(Path(path).read_bytes()))

    def get(self, handle: int):
        if self.states.get(handle) != "Loaded":
            raise LookupError("no model is loaded")
        return self.models[handle]

    def timed(self, name: str, call: Callable, *args):
        began = time.perf_counter()
        try:
            return call(*args)
        finally:
            self.latency_us[name] = int((time.perf_counter() - began) * 1e6)

    def release(self, handle: int) -> None:
        self.states.pop(handle, None)
        self.models.pop(handle, None)

    def status(self) -> dict:
        return {"models": {str(h): s for h, s in self.states.items()}, "latency_us": dict(self.latency_us)}

    def latency_json(self) -> str:
        """The last latencies in microseconds by name."""
        return json.dumps(self.latency_us, sort_keys=True, separators=(",", ":"))


@dataclass
class RuntimeStatus:
    """What a model runs on; ``degraded`` where it is not what was asked for."""

    runtime_flavor: str = "python"
    ort_version: str = ""
    ort_path: str = ""
    available_providers: list[str] = field(default_factory=list)
    requested: str = "auto"
    active: str = "cpu"
    degraded: bool = False
    selection_basis: str = ""
    calibration_key: str = ""
    cpu_calibration_ms: float = 0.0
    directml_calibration_ms: float = 0.0
    reason: str = ""

    @classmethod
    def choose(cls, requested: str, available: list[str], **known) -> RuntimeStatus:
        """The wanted provider where it is available, else the CPU."""
        good = requested in ("auto", "cpu") or requested in available
        return cls(available_providers=available, requested=requested, active=requested if good and requested != "auto" else "cpu", degraded=not good, reason="" if good else f"{requested} is not available", **known)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, separators=(",", ":"))


class PerWorker:
    """A model that each Python worker makes once, when it is first called.

    Ships only what makes it; the made model lives in the worker process, under its name, and serves
    all tasks that the worker runs."""

    def __init__(self, name: str, make: Callable[[], Callable]):
        self.name, self.make = name, make

    def __call__(self, *args):
        # functions are shipped by value, so a module variable would not outlive a task
        made = sys.__dict__.setdefault("opalgrid_models", {})
        if self.name not in made:
            made[self.name] = self.make()
        return made[self.name](*args)
