"""Images, archives and settings, also broken ones."""

import io
import struct
import zipfile

import numpy as np
import pytest

from opalgrid.sources import images as I
from opalgrid.sources.settings import Settings, charset, read_charset

PIXELS = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)


def test_bmp_round_trip():
    assert (I.decode_bmp(I.encode_bmp(PIXELS)) == PIXELS).all()
    four = np.dstack([PIXELS, PIXELS[:, :, :1]])
    assert (I.decode_bmp(I.encode_bmp(four)) == four).all()
    with pytest.raises(ValueError):
        I.decode_bmp(I.encode_bmp(four), allow32=False)


@pytest.mark.parametrize("at, value", [(22, -(2**31)), (18, 2**31 - 1), (14, -1), (22, 0)])
def test_bad_headers(at, value):
    data = bytearray(I.encode_bmp(PIXELS))
    struct.pack_into("<i", data, at, value)
    with pytest.raises(ValueError):
        I.decode_bmp(bytes(data))


def test_truncated():
    with pytest.raises(ValueError):
        I.decode_bmp(I.encode_bmp(PIXELS)[:55])


def test_buffers():
    assert I.image_from_array(PIXELS)[:3] == (5, 7, 2)
    assert I.image_from_buffer(b"abcdef", 2, 2, -3, 1, 3)[3] == b"deab"
    for bad in (dict(width=0), dict(stride=1), dict(offset=5)):
        with pytest.raises(ValueError):
            I.image_from_buffer(**({"data": b"abcdef", "width": 2, "height": 2, "stride": 3, "format": 1} | bad))


def zipped(entries, **flags):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, how in entries:
            z.writestr(zipfile.ZipInfo(name), data, how)
    return out.getvalue()


def test_archives():
    bmp = I.encode_bmp(PIXELS)
    good = zipped([("a/0.bmp", bmp, zipfile.ZIP_STORED), ("1.BMP", bmp, zipfile.ZIP_DEFLATED), ("x.txt", b"?", zipfile.ZIP_BZIP2)])
    assert [k for k, _ in I.unpack_templates(good)] == ["0.bmp", "1.BMP"]
    bad = {
        "duplicate": zipped([("a/0.bmp", bmp, 0), ("b/0.BMP", bmp, 0)]),
        "none": zipped([("x.txt", b"?", 0)]),
        "broken": zipped([("0.bmp", bmp[:60], 0)]),
        "traversal": zipped([("../0.bmp", bmp, 0)]),
        "bomb": zipped([("0.bmp", I.encode_bmp(np.zeros((400, 400, 3), np.uint8)), zipfile.ZIP_DEFLATED)]),
        "crc": good.replace(bmp[54:80], bytes(26), 1),
        "short": good[:40],
    }
    for name, data in bad.items():
        with pytest.raises(ValueError):
            I.unpack_templates(data)


def test_images_and_store(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(I.encode_bmp(PIXELS))
    (tmp_path / "b.BMP").write_bytes(I.encode_bmp(PIXELS[:3]))
    (tmp_path / "c.bmp").write_bytes(b"BM")
    rows = {r.image_id.rsplit("/", 1)[1]: r for r in I.read_images(spark, str(tmp_path)).collect()}
    assert rows["a.bmp"].status == 0 and rows["a.bmp"].width == 7 and rows["c.bmp"].status < 0 and rows["c.bmp"].error
    store = I.TemplateStore()
    h = store.create()
    assert store.load(h, I.read_templates(spark, str(tmp_path))) == 2
    with pytest.raises(ValueError):
        store.load_archive(spark, h, b"PK")
    assert [r.key for r in store.find(h, ["x/a.bmp", "b.BMP"]).orderBy("template_index").collect()] == ["a.bmp", "b.BMP"]
    with pytest.raises(LookupError):
        store.find(h, ["none.bmp"])


def test_find_templates(spark):
    from opalgrid.operators.match import find_templates

    rng = np.random.default_rng(1)
    frame = rng.integers(0, 256, (40, 50, 3), np.uint8)
    images = spark.createDataFrame([("i", *I.image_from_array(frame)), ("none", None, None, None, None)], "image_id string, height int, width int, format int, data binary")
    templates = spark.createDataFrame([(0, *I.image_from_array(frame[5:12, 9:20].copy())), (1, *I.image_from_array(frame[30:36, 3:9].copy()))], "template_index int, height int, width int, format int, data binary")
    for metric in ("sad", "ncc"):
        assert [(r.template_index, r.x, r.y) for r in find_templates(images, templates, 0.99, metric).orderBy("template_index").collect()] == [(0, 9, 5), (1, 3, 30)]


def test_settings(spark, tmp_path):
    s = Settings.parse("# c\n a = 1 \n; d\nflag=Yes\nmodel_path=x/y\n", "/base")
    assert s.integer("a") == 1 and s.flag("flag") and s["model_path"] == "/base/x/y" and s.number("none", 2.5) == 2.5
    with pytest.raises(ValueError, match="line 2"):
        Settings.parse("a=1\nbroken\n")
    (tmp_path / "d.txt").write_text("a\r\nb\n\nc\n")
    assert [r.ch for r in read_charset(spark, str(tmp_path / "d.txt")).orderBy("idx").collect()] == ["", "a", "b", "", "c", " "]
    assert charset(["x"]) == ["", "x", " "]


def test_written_images_read_back(spark, tmp_path):
    four = np.dstack([PIXELS, np.full(PIXELS.shape[:2], 9, np.uint8)])
    rows = [("a/x.bmp", *I.image_from_array(PIXELS)), ("y", *I.image_from_array(four)), ("bad", None, None, None, None)]
    images = spark.createDataFrame(rows, "image_id string, height int, width int, format int, data binary")
    made = I.write_images(images, f"file://{tmp_path}/out").collect()
    assert sorted((r.name, r.file) for r in made) == [("a/x.bmp", "x.bmp"), ("y", "y.bmp")]
    got = {r.image_id.rsplit("/", 1)[-1]: bytes(r.data) for r in I.read_images(spark, f"{tmp_path}/out").collect()}
    assert got == {"x.bmp": PIXELS.tobytes(), "y.bmp": four.tobytes()}


def test_stream(spark, tmp_path):
    from opalgrid.streaming import run_batches, stream_images

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bmp").write_bytes(I.encode_bmp(PIXELS))
    run_batches(stream_images(spark, str(tmp_path / "in")), lambda b: b.select("image_id", "width"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.width for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [7]


def test_text_search(spark):
    from pyspark.sql import functions as F

    from opalgrid.functions import text as X

    df = spark.createDataFrame([("A你B好", "你B"), ("aaaa", "aa"), ("x", ""), ("a.b.c", ".")], "t string, n string")
    at = [r[0] for r in df.select(X.occurrences(F.col("t"), F.col("n"))).collect()]
    assert at == [[1], [0, 2], [], [1, 3]]
    box = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    assert tuple(df.limit(1).select(X.text_box(box, F.col("t"), F.lit(1), F.lit(2)).alias("b")).first().b) == (2, 0, 4, 8)
