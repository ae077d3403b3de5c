"""Text expressions, parsers of rule strings, and result formats."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width marks and what they become.
PUNCTUATION = ("：！【", ":![")
MAX_RULES, MAX_RULE_BYTES = 16, 512
TRUE_WORDS, FALSE_WORDS = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def visible_length(text: Column) -> Column:
    """Code points other than ASCII white space."""
    return F.length(F.regexp_replace(text, "[ \\t\\n\\u000b\\f\\r]", ""))


def normalize_punctuation(text: Column) -> Column:
    return F.translate(text, *PUNCTUATION)


def occurrences(text: Column, target: Column) -> Column:
    """0-based code-point places of all non-overlapping hits, left to right: array<int>."""
    parts = F.split(text, F.concat(F.lit("\\Q"), target, F.lit("\\E")), -1)
    gaps = F.slice(F.transform(parts, lambda p: F.length(p)), F.lit(1), F.size(parts) - 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(a, gap):  # one running fold over what lies before each hit
        hit = a["at"] + gap
        return F.struct((hit + F.length(target)).alias("at"), F.concat(a["hits"], F.array(hit)).alias("hits"))

    return F.when(F.length(target) > 0, F.aggregate(gaps, start, step, lambda a: a["hits"])).otherwise(F.array().cast("array<int>"))


def text_box(box: Column, text: Column, at: Column, n: Column) -> Column:
    """The part of a line's box that n code points from ``at`` take up."""
    total = F.greatest(F.length(text), F.lit(1))
    left = F.floor(box["w"].cast("long") * at / total)
    width = F.ceil(box["w"].cast("long") * n / total)
    width = F.greatest(F.lit(1), F.least(width, box["w"] - left))
    return F.struct((box["x"] + left).cast("int").alias("x"), box["y"].alias("y"), width.cast("int").alias("w"), box["h"].alias("h"))


def compact_points(order: list[Column], number: Column, x: Column, y: Column) -> Column:
    """Aggregate: ``number,x,y`` joined by bars in the given order; empty for no rows."""
    item = F.concat_ws(",", number, x, y)
    keyed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], item.alias("item"))))
    return F.concat_ws("|", F.transform(keyed, lambda s: s["item"]))


def parse_compact_points(text: str) -> list[tuple[int, int, int]]:
    """The inverse of ``compact_points``; raises ValueError on malformed text."""
    out = []
    for item in text.split("|") if text else []:
        if not re.fullmatch(r"-?\d+,-?\d+,-?\d+", item):
            raise ValueError(f"malformed point {item!r}")
        number, x, y = map(int, item.split(","))
        if number < 0:
            raise ValueError("negative id")
        out.append((number, x, y))
    return out


def split_names(text: str) -> list[str]:
    """Alternatives between bars; none may be empty."""
    names = text.split("|")
    if not all(names):
        raise ValueError("empty name")
    return names


def split_targets(text: str) -> list[str]:
    """Alternatives between bars; empty ones are dropped."""
    return [t for t in text.split("|") if t]


def parse_rgb(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"(?:#|0[xX])?([0-9A-Fa-f]{6})", text)
    if not m:
        raise ValueError(f"not an RGB colour: {text!r}")
    return tuple(bytes.fromhex(m[1]))


def parse_color_bias(text: str, mode: int) -> tuple[int, int, int]:
    """R, G, B tolerances: six hex digits in colour mode 0, two in gray mode 1; empty is zero."""
    if mode not in (0, 1):
        raise ValueError("mode must be 0 or 1")
    if not text:
        return 0, 0, 0
    if not re.fullmatch(r"[0-9A-Fa-f]{6}" if mode == 0 else r"[0-9A-Fa-f]{2}", text):
        raise ValueError(f"malformed colour bias {text!r}")
    values = bytes.fromhex(text)
    return tuple(values) if mode == 0 else (values[0],) * 3


def parse_color_rules(text: str | None) -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """``RRGGBB-RRGGBB|...`` as (colour, tolerance) rules; blank text means automatic: no rules."""
    if text is None:
        return []
    if len(text.encode()) > MAX_RULE_BYTES:
        raise ValueError("rules are too long")
    text = text.strip(" \t\r\n\f\v")
    if not text:
        return []
    out = []
    for item in text.split("|"):
        m = re.fullmatch(r"([0-9A-Fa-f]{6})-([0-9A-Fa-f]{6})", item.strip())
        if not m:
            raise ValueError(f"malformed rule {item!r}")
        out.append((tuple(bytes.fromhex(m[1])), tuple(bytes.fromhex(m[2]))))
    if len(out) > MAX_RULES:
        raise ValueError("too many rules")
    return out


def check_score(score: float) -> float:
    if not math.isfinite(score) or not 0 <= score <= 1:
        raise ValueError("a score must be a finite number in 0..1")
    return score


def rgb_hex(value: int) -> str:
    if not 0 <= value <= 0xFFFFFF:
        raise ValueError("not a 24-bit colour")
    return f"{value:06X}"


def truncate_utf8(text: str, limit: int = 511) -> str:
    """At most ``limit`` bytes, cut between code points."""
    return text.encode()[:limit].decode("utf-8", "ignore")


def match_json(order: list[Column], fields: Column) -> Column:
    """Aggregate: a JSON array of structs in the given order."""
    keyed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], fields.alias("item"))))
    return F.to_json(F.transform(keyed, lambda s: s["item"]))


def lines_json(order: list[Column]) -> Column:
    """Aggregate over (text, confidence, x, y, w, h): ``{"lines":[...]}`` in the given order."""
    item = F.struct("text", finite(F.col("confidence")).alias("confidence"), F.struct("x", "y", "w", "h").alias("box"))
    return F.concat(F.lit('{"lines":'), match_json(order, item), F.lit("}"))


def finite(value: Column) -> Column:
    """Zero for what JSON cannot hold."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def text_of_lines(order: list[Column], text: Column) -> Column:
    """Aggregate: the lines' text joined without a separator."""
    keyed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("item"))))
    return F.array_join(F.transform(keyed, lambda s: s["item"]), "")


def log_add(a: Column, b: Column) -> Column:
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))
