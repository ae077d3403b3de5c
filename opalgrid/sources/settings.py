"""Settings files, character sets and label lists."""

from __future__ import annotations

import importlib.resources
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.functions.text import FALSE_WORDS, TRUE_WORDS


class Settings(dict):
    """key = value settings with typed getters that fall back."""

    @classmethod
    def parse(cls, text: str, folder: str = ".") -> Settings:
        found = cls()
        for number, line in enumerate(text.splitlines(), 1):
            line = line.strip()
            if not line or line[0] in "#;":
                continue
            key, equals, value = line.partition("=")
            if not equals or not key.strip():
                raise ValueError(f"line {number}: not key=value")
            key, value = key.strip(), value.strip()
            if key.endswith("_path") and value and not os.path.isabs(value):
                value = os.path.normpath(os.path.join(folder, value))
            found[key] = value
        return found

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        rows = spark.read.text(path, wholetext=True).collect()
        if len(rows) != 1:
            raise ValueError("settings are one file")
        return cls.parse(rows[0][0], os.path.dirname(path))

    def text(self, key: str, default: str = "") -> str:
        return self.get(key, default)

    def integer(self, key: str, default: int = 0) -> int:
        try:
            return int(self[key])
        except (KeyError, ValueError):
            return default

    def number(self, key: str, default: float = 0.0) -> float:
        try:
            return float(self[key])
        except (KeyError, ValueError):
            return default

    def flag(self, key: str, default: bool = False) -> bool:
        word = self.get(key, "").lower()
        return True if word in TRUE_WORDS else False if word in FALSE_WORDS else default


def read_charset(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ch): index 0 is the blank of the decoder, file lines follow, a space ends it."""
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n$", ""), "\n")
    lines = F.when(F.element_at(lines, -1) == " ", lines).otherwise(F.concat(lines, F.array(F.lit(" "))))
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.concat(F.array(F.lit("")), lines)).alias("idx", "ch"))


def charset(chars: list[str]) -> list[str]:
    """The same from inline characters."""
    out = ["", *chars]
    return out if out[-1] == " " else [*out, " "]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, label) from a file with a label on each line; labels hold at most 31 bytes."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("class_id", "label"))
    return lines.where("label <> ''").select("class_id", F.decode(F.substring(F.encode("label", "UTF-8"), 1, 31), "UTF-8").alias("label"))


def embedded_asset(package: str, name: str) -> bytes | None:
    """A file shipped inside a package, or None."""
    found = importlib.resources.files(package).joinpath(name)
    return found.read_bytes() if found.is_file() else None
