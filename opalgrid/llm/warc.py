"""WARC archives in Zstandard frames.

An archive begins with a skippable frame that holds the dictionary (itself compressed); each record
is one frame of its own.  The reader loads the dictionary from the leading frame, decodes one frame
per record and validates version line, headers, lengths and digests.

Records with equal payloads of at least ``REVISIT_BYTES`` bytes are written once, as the response
with the largest page_id; the others are revisit records that name it and carry no payload.

Archives go to the shared folder as files of about ``FILE_BYTES`` payload bytes, under a name that
a retried task does not share, and are moved into place when complete; a manifest, a table with one
row per archive of the finished job, says which files count.  Reading deals the manifest out to
tasks, each of which opens its archives and yields one record at a time.

Every response and revisit names its page's URL (WARC-Target-URI) where the page has one, with
blanks, controls and characters beyond ASCII percent-encoded.  A revisit's length and digest are
checked against the response it names.

Defined results: null html is an empty payload; a null page_id counts as smaller than any other and
is written as such; a null url leaves the header out; rows that repeat page_id and html are all
written, and those that hold the largest page_id are all responses; empty tables give no archive; a
page may be as long as a task's memory allows; other columns, whatever their names, are not looked
at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._store import BROADCAST_ROWS, fresh_path, stored

REVISIT_BYTES, FILE_BYTES, READ_BYTES, LEVEL = 1000, 16 << 20, 16 << 10, 3
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 64 << 10, 256, 16 << 10
SKIPPABLE = 0x184D2A5D
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
ARCHIVES_PER_TASK, READ_ROWS = 16, 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one record; raises WarcError."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise WarcError("no version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"malformed header {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length", "warc-date"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("malformed length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"length {len(rest) - 4} where {n} is declared")
    return headers, rest[:n]


def read_archive(data: bytes):
    """Yields (headers, block) of each record of a zstd archive."""
    at, dictionary = 0, None
    view = memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", data, 4)[0]
        body = bytes(view[8 : 8 + n])
        if len(body) != n:
            raise WarcError("the dictionary frame is cut off")
        if body[:4] == b"\x28\xb5\x2f\xfd":
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary = zstandard.ZstdCompressionDict(body) if body else None
        at = 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        one, parts, begun = reader.decompressobj(), [], at
        try:
            while not one.eof and at < len(view):
                piece = view[at : at + READ_BYTES]  # so that what is left over is never a large copy
                parts.append(one.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as e:
            raise WarcError(f"broken frame at byte {begun}") from e
        if not one.eof:
            raise WarcError(f"the frame at byte {begun} is cut off")
        at -= len(one.unused_data)
        yield parse_record(b"".join(parts))


def _train(pages: DataFrame) -> bytes:
    """A dictionary from the starts of at most SAMPLE_ROWS pages (low id hashes).

    Hashes above a bound that follows the number of pages go first, so that all tasks together
    send about twice the sample to the driver, however many they are."""
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, pages.count()))
    low = F.shiftrightunsigned("k", 33) < F.lit(int(share * (1 << 31)))
    rows = pages.select(F.substring("html", 1, SAMPLE_CHARS).alias("h"), F.xxhash64("page_id").alias("k")).where("h <> ''").where(low).orderBy("k", "h").limit(SAMPLE_ROWS).collect()
    samples = [r.h.encode() for r in rows]
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES // 4 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_id(page, digest: str) -> str:
    """The record's name: the same for a page and payload, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def target_uri(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def _write_task(path: str, dictionary: bytes, date: str):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(path)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        out = name = None
        size = records = 0

        def close():
            out.close()
            store.move(f"{folder}/_{name}", f"{folder}/{name}")
            return pa.record_batch({"file": pa.array([name]), "records": pa.array([records], pa.int64())})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "kind", "refers_to")]
            for page, url, html, digest, kind, refers in zip(*columns):
                page, url, payload, digest, refers, kind = page.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers.as_py(), kind.as_py()
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{folder}/_{name}", compression=None)
                    out.write(dictionary_frame(dictionary))
                headers = [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", record_id(page, digest)),
                    ("WARC-Date", date),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("X-Payload-Length", str(len(payload))),
                ]
                if url is not None:
                    headers.append(("WARC-Target-URI", target_uri(url)))
                if page is not None:
                    headers.append(("X-Page-ID", str(page)))
                if kind == "revisit":
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page", str(refers))]
                frame = packer.compress(record_bytes(headers, b"" if kind == "revisit" else payload))
                out.write(frame)
                size, records = size + len(payload), records + 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def planned(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, digest, kind and refers_to of the records to write."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("large", F.octet_length("html") >= REVISIT_BYTES)
    latest = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    latest = stored(latest.select("digest", "latest", F.lit(True).alias("large")), "latest")
    # few enough repeats leave the pages where they are; more of them meet the pages in a shuffle
    few = latest.count() <= broadcast_rows
    joined = rows.join(F.broadcast(latest) if few else latest, ["digest", "large"], "left")
    again = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return joined.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("latest")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Writes archives of pages; returns their folder and the manifest (file, records)."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return path, stored(planned(pages).mapInArrow(_write_task(path, _train(pages), date), "file string, records long"), "manifest")


def _checked(headers: dict[str, str], block: bytes) -> tuple:
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    length = int(headers.get("x-payload-length", len(block)))
    if kind == "response" and (len(block) != length or "sha1:" + hashlib.sha1(block).hexdigest() != digest):
        raise WarcError("a payload does not match its digest or length")
    if kind == "revisit" and headers.get("warc-profile") != PROFILE:
        raise WarcError("a revisit record without its profile")
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
    return None if page is None else int(page), length, digest.removeprefix("sha1:"), kind, None if refers is None else int(refers), headers.get("warc-target-uri")


def _read_task(path: str):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in RESULT.split(", ")]

    def table(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                rows, n = [], 0
                with store.open_input_file(f"{folder}/{file}") as f:
                    data = f.read_buffer()
                for headers, block in read_archive(data):
                    rows.append(_checked(headers, block))
                    n += 1
                    if len(rows) == READ_ROWS:
                        yield table(rows)
                        rows = []
                if n != records:
                    raise WarcError(f"{n} records where the manifest has {records}")
                if rows:
                    yield table(rows)

    return run


def read_archives(path: str, manifest: DataFrame) -> DataFrame:
    """The records of the archives that a manifest names: page_id, payload length and digest, type, what a
    revisit refers to, and the URL.  Raises WarcError where a revisit and its response disagree."""
    spark = manifest.sparkSession
    files = manifest.count()
    tasks = max(1, min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), files // ARCHIVES_PER_TASK)))
    records = stored(manifest.repartition(tasks).mapInArrow(_read_task(path), RESULT), "records")
    named = records.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    if not named.join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").isEmpty():
        raise WarcError("a revisit names no response of its digest and length")
    return records


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives and reads them back."""
    return read_archives(*write_archives(pages))
