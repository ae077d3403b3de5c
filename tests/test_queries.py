"""Every registered query of the engine against its SQL on the smallest tables."""

import json
import os

import numpy as np
import pytest

import opalgrid.catalog as catalog
from opalgrid.operators import boxes as B
from opalgrid.operators import decode as D
from opalgrid.operators import recognize as R
from opalgrid.operators import trace as T
from opalgrid.plans import rasters, regions

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if not isinstance(value, (int, bool, type(None))) else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" if os.path.isfile(f"{DATA}/{f}") else f"{DATA}/{f}/*.parquet"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    return con


def checked_reading_order(found, duck):
    """Lines of each image, computed from rows that another engine reads."""
    want = set()
    sql = f"{regions.BOX} SELECT image_id, list((score, x, y, w, h) ORDER BY score, x, y, w, h) FROM bx GROUP BY image_id"
    for image, rows in duck.execute(sql).fetchall():
        box = [tuple(r)[1:] for r in rows]
        order = [(n, i) for n, line in enumerate(B.reading_lines(box)) for i in line]
        want |= {(image, n, pos, i, *box[i]) for pos, (n, i) in enumerate(order)}
        for n in {n for n, _ in order}:
            line = [box[i] for m, i in order if m == n]
            assert [b[0] for b in line] == sorted(b[0] for b in line)
    assert {tuple(r[c] for c in ("image_id", "line_no", "pos", "detection_index", "x", "y", "w", "h")) for r in found} == want and len(found) == len(want)


def checked_merged_fragments(found, duck):
    """Runs of boxes joined per line: areas are covered, counts add up."""
    got = {}
    for r in found:
        got.setdefault(r.image_id, []).append((r.n, r.x, r.y, r.w, r.h, r.fragments))
    sql = f"{regions.BOX} SELECT image_id, list((score, x, y, w, h) ORDER BY score, x, y, w, h) FROM bx GROUP BY image_id"
    for image, rows in duck.execute(sql).fetchall():
        box = [tuple(r)[1:] for r in rows]
        own = sorted(got.pop(image))
        assert [tuple(o[1:]) for o in own] == B.merge_fragments(box) and sum(o[-1] for o in own) == len(box)
        for x, y, w, h in box:
            assert any(a <= x and b <= y and x + w <= a + c and y + h <= b + d for _, a, b, c, d, _ in own)
    assert not got


def checked_candidate_fold(found, duck):
    want = {}
    for conv, rows in duck.execute(f"{regions.LN} SELECT conv_id, list((length(text) % 4, turn, text) ORDER BY length(text) % 4, turn, text) FROM ln GROUP BY conv_id").fetchall():
        best = None
        for k in range(4):
            own = [R.TextLine(4, t * 20, max(1, len(s) % 90), 16, 0.3 + (len(s) % 7) / 10, s) for c, t, s in rows if c == k]
            if own:
                e = R.evaluate(own, 120, 200, 0.5)
                best = (k, e) if best is None or R.better(e, best[1]) else best
        want[conv] = best[0], best[1].chars
    assert {r.conv_id: (r.candidate, r.chars) for r in found} == want


def checked_trace_paths(found, duck):
    """Each skeleton pixel is on one path; a path's bounds hold its points and no less."""
    gray = {}
    for image, y, x, v in duck.execute(f"{rasters.WITH} SELECT image_id, y, x, gray FROM gr").fetchall():
        gray.setdefault(image, np.zeros((8, 8), np.uint8))[y, x] = v
    assert {r.image_id for r in found} == set(gray)
    for r in found:
        out, image = json.loads(r.trace), gray[r.image_id]
        spread = [(image <= t).sum() * (image > t).sum() * (image[image <= t].mean() - image[image > t].mean()) ** 2 if (image <= t).any() and (image > t).any() else -1 for t in range(256)]
        assert max(spread) < 0 or spread[out["threshold"]] >= max(spread) * (1 - 1e-9)
        points = [tuple(p) for path in out["paths"] for p in path["points"]]
        skeleton = T.thin(image >= out["threshold"])
        assert sorted(points) == sorted((x, y) for y, x in np.argwhere(skeleton).tolist()) and out["point_count"] == len(points) == out["skeleton_pixels"]
        for path in out["paths"]:
            xs, ys = zip(*path["points"])
            assert path["bounds"] == {"x": min(xs), "y": min(ys), "w": max(xs) - min(xs) + 1, "h": max(ys) - min(ys) + 1}


def checked_ctc_beam(found, duck):
    want = {}
    for seq, values in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall():
        steps = np.array(values, np.float32).astype(float).reshape(8, 8)
        want[seq] = "".join(regions.CHARS[i] for i in D.beam_search(steps, 5, 8)), round(D.greedy(steps)[1], 6)
    assert {r.seq_id: (r.text, r.confidence) for r in found} == want


CHECKED = {"reading_order": checked_reading_order, "merged_fragments": checked_merged_fragments, "candidate_fold": checked_candidate_fold, "trace_paths": checked_trace_paths, "ctc_beam": checked_ctc_beam}


def test_every_query_is_checked():
    assert set(catalog.queries()) == set(SQL) | set(CHECKED)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    rows = catalog.queries()[name](spark, DATA)
    columns = sorted(rows.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=str)
    if name not in SQL:
        CHECKED[name](rows.collect(), duck)
        return
    made = duck.execute(SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in made.fetchall()), key=str)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert all(x == y or isinstance(x, float) and abs(x - float(y)) < 1e-5 or str(x) == str(y) for x, y in zip(a, b)), (a, b)


def test_correlation_at_the_limit(spark, duck, tmp_path):
    """A place whose correlation is 0.8 but for rounding is a hit if it is one for the SQL."""
    raw = (
        "818976686a869677868e75748b867a607c8f76a97a868e778e8c7e7a8b739f648b838d7492887b7b8474827a7e5f6ca5757d77816494928d9e7792847a837c67",
        "7d64827486907677949976788f696dac8d7f5d65836f948a74998688868a7c7573937d5885687a867490696c7c886e716c6f7b88838469836d8178757c868a79",
    )
    table = [(i, [(v + 0.5) / 127.5 - 1 for v in bytes.fromhex(x)]) for i, x in enumerate(raw)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duck.cursor()
    con.execute(f"create temp view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(SQL["template_kernel_ncc"]).fetchall()
    assert (1, 0, 0.8) in {(r[0], r[1], r[4]) for r in want}
    assert sorted(map(tuple, rasters.template_kernel_ncc(spark, str(tmp_path)).collect())) == sorted(want)
