"""Images: strict BMP decoding, raw buffers, template folders and archives."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.schema import CHANNELS, ERROR_IMAGE, FORMATS, IMAGE, INT_MIN, OK

# Limits of template archives.  Fixed values.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES, MAX_RATIO = 4096, 64 << 20, 512 << 20, 200


def decode_bmp(data: bytes, allow32: bool = True) -> np.ndarray:
    """An uncompressed 24- or 32-bit BMP as a top-down array (height, width, 3 or 4), BGR(A)."""
    if len(data) < 54 or data[:2] != b"BM":
        raise ValueError("not a BMP")
    offset, dib, width, height, planes, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if dib < 40 or 14 + dib > offset or planes != 1 or packing != 0:
        raise ValueError("unsupported BMP header")
    if bits not in ((24, 32) if allow32 else (24,)):
        raise ValueError(f"{bits}-bit BMP")
    if width <= 0 or height == 0 or height == INT_MIN:
        raise ValueError("bad BMP size")
    rows, n = abs(height), bits // 8
    stride = (width * n + 3) // 4 * 4
    if offset + stride * rows > len(data):
        raise ValueError("truncated BMP")
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)[:, : width * n].reshape(rows, width, n)
    return raw[::-1] if height > 0 else raw


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A 24- or 32-bit bottom-up BMP."""
    h, w, n = pixels.shape
    rows = np.zeros((h, (w * n + 3) // 4 * 4), np.uint8)
    rows[:, : w * n] = pixels[::-1].reshape(h, -1)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, n * 8, 0, len(body), 2835, 2835, 0, 0) + body


def encode_mask(mask: np.ndarray) -> bytes:
    """A mask as a 24-bit gray BMP."""
    return encode_bmp(np.repeat((mask.astype(bool) * 255).astype(np.uint8)[:, :, None], 3, 2))


def image_from_array(pixels: np.ndarray, format: int | None = None) -> tuple[int, int, int, bytes]:
    """(height, width, format, data) of a uint8 array h x w, h x w x 3 or h x w x 4."""
    if pixels.dtype != np.uint8 or pixels.ndim not in (2, 3) or 0 in pixels.shape:
        raise ValueError("a uint8 array of pixels is needed")
    n = 1 if pixels.ndim == 2 else pixels.shape[2]
    format = format or {1: FORMATS["GRAY8"], 3: FORMATS["BGR24"], 4: FORMATS["BGRA32"]}.get(n)
    if format not in CHANNELS or CHANNELS[format] != n:
        raise ValueError("channels do not fit the format")
    return *pixels.shape[:2], format, np.ascontiguousarray(pixels).tobytes()


def image_from_buffer(data: bytes, width: int, height: int, stride: int, format: int, offset: int = 0) -> tuple[int, int, int, bytes]:
    """Tight top-down rows of a strided buffer; a negative stride reads rows upwards."""
    n = CHANNELS.get(format, 0) * width
    if width <= 0 or height <= 0 or not n or abs(stride) < n or offset < 0:
        raise ValueError("bad image layout")
    places = [offset + i * stride for i in range(height)]
    if min(places) < 0 or max(places) + n > len(data):
        raise ValueError("the buffer is too small")
    return height, width, format, b"".join(data[p : p + n] for p in places)


def to_bgr(data: bytes, height: int, width: int, format: int) -> tuple[np.ndarray, np.ndarray]:
    """BGR planes (height, width, 3) and alpha (255 where there is none)."""
    n = CHANNELS[format]
    a = np.frombuffer(data, np.uint8).reshape(height, width, n)
    if n == 1:
        a = np.repeat(a, 3, 2)
    alpha = a[:, :, 3] if n == 4 else np.full((height, width), 255, np.uint8)
    bgr = a[:, :, :3]
    return (bgr[:, :, ::-1] if format in (FORMATS["RGB24"], FORMATS["RGBA32"]) else bgr), alpha


def _decode_rows(allow32: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, content in zip(frame["image_id"], frame["content"]):
                try:
                    height, width, format, data = image_from_array(np.ascontiguousarray(decode_bmp(bytes(content), allow32)))
                    out.append((key, height, width, format, data, OK, None))
                except (ValueError, TypeError) as e:
                    out.append((key, None, None, None, None, ERROR_IMAGE, str(e)))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in IMAGE.split(", ")])
            yield made.astype({"height": "Int32", "width": "Int32", "format": "Int32"})

    return run


def decode_images(binary: DataFrame, allow32: bool = True) -> DataFrame:
    """Images from rows (image_id, content); a bad one gets a status and an error, not a failure."""
    return binary.select(F.col("image_id").cast("string").alias("image_id"), "content").mapInPandas(_decode_rows(allow32), IMAGE)


def write_images(images: DataFrame, folder: str, name: str = "image_id") -> DataFrame:
    """Writes each image as ``<name>.bmp`` into a folder that all executors reach; returns (name, file, bytes).

    Nothing is written before the result is read.  A task that runs again writes the same files."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["data"] is None:
                    continue
                bgr, alpha = to_bgr(bytes(r["data"]), r["height"], r["width"], r["format"])
                data = encode_bmp(np.dstack([bgr, alpha]) if CHANNELS[r["format"]] == 4 else bgr)
                file = re.sub(r"[^A-Za-z0-9._-]", "_", r["name"].rsplit("/", 1)[-1].removesuffix(".bmp")) + ".bmp"
                with store.open_output_stream(f"{root}/{file}") as out:
                    out.write(data)
                rows.append((r["name"], file, len(data)))
            names, files, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch({"name": pa.array(names, pa.string()), "file": pa.array(files, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    return images.select(F.col(name).cast("string").alias("name"), "height", "width", "format", "data").mapInArrow(run, "name string, file string, bytes long")


def read_images(spark: SparkSession, path: str, allow32: bool = True, recursive: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return decode_images(files.select(F.col("path").alias("image_id"), "content"), allow32)


def read_templates(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(key, height, width, format, data) of a folder's .bmp and .BMP files.

    The key is the base name; of equal keys the one with the largest path stays; files that do not
    decode are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{bmp,BMP}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    images = decode_images(files.select(F.col("path").alias("image_id"), "content")).where(f"status = {OK}")
    keyed = images.withColumn("key", F.element_at(F.split("image_id", "/"), -1))
    latest = keyed.groupBy("key").agg(F.max("image_id").alias("image_id"))
    return keyed.join(latest, ["key", "image_id"]).select("key", "height", "width", "format", "data")


def _safe_name(name: str) -> bool:
    return not (name.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", name) or ".." in re.split(r"[/\\]", name) or "\0" in name)


def unpack_templates(archive: bytes) -> list[tuple[str, bytes]]:
    """(key, BMP bytes) of a template archive; ValueError if any rule is broken."""
    tail = archive.rfind(b"PK\x05\x06")
    if tail < 0 or len(archive) < tail + 22:
        raise ValueError("not a ZIP archive")
    disk, start_disk, here, total, _, start = struct.unpack_from("<HHHHII", archive, tail + 4)
    if disk or start_disk or here != total or total == 0xFFFF or start == 0xFFFFFFFF or archive[max(0, tail - 20) : tail][:4] == b"PK\x06\x07":
        raise ValueError("multi-disk or ZIP64 archive")
    try:
        zipped = zipfile.ZipFile(io.BytesIO(archive))
    except (zipfile.BadZipFile, NotImplementedError) as e:
        raise ValueError(str(e)) from e
    entries = zipped.infolist()
    if len(entries) > MAX_ENTRIES:
        raise ValueError("too many entries")
    found, seen, size = [], set(), 0
    for e in entries:
        if e.flag_bits & 1:
            raise ValueError("encrypted entry")
        if not _safe_name(e.orig_filename):
            raise ValueError("unsafe path")
        if e.is_dir() or not e.filename.lower().endswith(".bmp"):
            continue
        if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError("unsupported compression")
        size += e.file_size
        if e.file_size > MAX_ENTRY_BYTES or size > MAX_TOTAL_BYTES or e.file_size > MAX_RATIO * max(1, e.compress_size):
            raise ValueError("entry too large")
        key = re.split(r"[/\\]", e.filename)[-1]
        if key.lower() in seen:
            raise ValueError("duplicate name")
        seen.add(key.lower())
        try:
            data = zipped.read(e)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as x:
            raise ValueError(str(x)) from x
        decode_bmp(data)
        found.append((key, data))
    if not found:
        raise ValueError("no BMP in the archive")
    return found


def _unpack_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for archive, content in zip(frame["archive"], frame["content"]):
            try:
                rows = [(archive, k, d, OK, None) for k, d in unpack_templates(bytes(content))]
            except ValueError as e:
                rows = [(archive, None, None, ERROR_IMAGE, str(e))]
            yield pd.DataFrame(rows, columns=["archive", "key", "content", "status", "error"])


def read_template_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, key, content, status, error): all templates of an archive, or one error row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("archive"), "content").mapInPandas(_unpack_rows, "archive string, key string, content binary, status int, error string")


class TemplateStore:
    """Template sets by handle.  A set is swapped only when it loads whole."""

    def __init__(self):
        self._sets: dict[int, DataFrame | None] = {}

    def create(self) -> int:
        handle = max(self._sets, default=0) + 1
        self._sets[handle] = None
        return handle

    def load(self, handle: int, templates: DataFrame) -> int:
        if handle not in self._sets:
            raise KeyError(f"no such handle {handle}")
        n = templates.count()
        self._sets[handle] = templates
        return n

    def load_archive(self, spark: SparkSession, handle: int, archive: bytes) -> int:
        rows = [(k, *image_from_array(np.ascontiguousarray(decode_bmp(d)))) for k, d in unpack_templates(archive)]
        return self.load(handle, spark.createDataFrame(rows, "key string, height int, width int, format int, data binary"))

    def templates(self, handle: int) -> DataFrame:
        found = self._sets[handle]
        if found is None:
            raise LookupError("no templates are loaded")
        return found

    def find(self, handle: int, names: list[str]) -> DataFrame:
        """Templates of the names in order (template_index); a missing one raises LookupError.

        A name is looked up as it is, else by its base name."""
        from_set = self.templates(handle)
        rows = [(i, name, re.split(r"[/\\]", name)[-1]) for i, name in enumerate(names)]
        wanted = from_set.sparkSession.createDataFrame(rows, "template_index int, name string, base string")
        keys = from_set.select("key").distinct()
        exact, base = (keys.select(F.col("key").alias(c)) for c in ("exact", "loose"))
        named = wanted.join(exact, F.col("name") == F.col("exact"), "left").join(base, F.col("base") == F.col("loose"), "left")
        chosen = named.select("template_index", F.coalesce("exact", "loose").alias("key"), "name").collect()  # one row per name
        lost = [r.name for r in chosen if r.key is None]
        if lost:
            raise LookupError(f"no template {lost[0]!r}")
        chosen = from_set.sparkSession.createDataFrame([(r.template_index, r.key) for r in chosen], "template_index int, key string")
        return from_set.join(chosen, "key")

    def clear(self, handle: int) -> None:
        self._sets[handle] = None

    def release(self, handle: int) -> None:
        del self._sets[handle]
