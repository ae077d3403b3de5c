"""Queries on boxes, detections, sequences and text lines made from the test tables.

Boxes come from lineitem (an order is an image), logits from embeddings (8 steps of 8 classes), and
text lines from conversations.  A few targets are literals.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions import pixels as P
from opalgrid.functions import text as X
from opalgrid.operators import boxes as B
from opalgrid.operators import decode as D
from opalgrid.operators import recognize as R
from opalgrid.operators import search as S

TARGETS = ["the", "ing", "on t", "absent"]


def boxes(spark, sf_dir, distinct: bool = True) -> DataFrame:
    """(image_id, x, y, w, h, score): one box for each (distinct) line of an order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_partkey") % 97).cast("int").alias("x"),
        (F.col("l_suppkey") % 53).cast("int").alias("y"),
        (F.floor("l_quantity") % 40 + 10).cast("int").alias("w"),
        (F.col("l_partkey") % 30 + 10).cast("int").alias("h"),
        (F.round(F.col("l_discount") * 100).cast("int") * 10 + F.col("l_linenumber") % 10).alias("score"),
    )
    return rows.distinct() if distinct else rows


BOX = """WITH bx AS (SELECT DISTINCT l_orderkey AS image_id, CAST(l_partkey % 97 AS INTEGER) AS x, CAST(l_suppkey % 53 AS INTEGER) AS y, CAST(floor(l_quantity) % 40 + 10 AS INTEGER) AS w,
  CAST(l_partkey % 30 + 10 AS INTEGER) AS h, CAST(round(l_discount * 100) AS INTEGER) * 10 + l_linenumber % 10 AS score FROM lineitem)"""
INTER = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"


def _key():
    return F.struct("score", "x", "y", "w", "h")


def box_iou_pairs(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("key", F.concat_ws(",", "score", "x", "y", "w", "h"))
    pairs = B.overlap_pairs(rows, "image_id", "key")
    return pairs.select("image_id", "key_a", "key_b", F.round("iou", 9).alias("iou"))


def box_nms(spark, sf_dir):
    """Greedy suppression over 0.45, whatever the class; ties by x, y, w, h."""
    rows = boxes(spark, sf_dir)
    return B.suppress(rows, ["image_id"], [-F.col("score"), F.col("x"), F.col("y"), F.col("w"), F.col("h")], B.DETECTION_OVERLAP, ["x", "y", "w", "h", "score"])


def origin_offset(spark, sf_dir):
    """Boxes moved by an origin near the edge of 32 bits; an image with any overflow keeps its boxes."""
    return B.offset_boxes(boxes(spark, sf_dir), "image_id", 2**31 - 90, -5)


def box_unclip(spark, sf_dir):
    """Boxes grown by area * 1.5 / perimeter inside a map of 160 x 120."""
    d = P.unclip_distance(F.col("w"), F.col("h"), 1.5)
    rows = boxes(spark, sf_dir).withColumn("d", d)
    left, top = F.greatest(F.lit(0), F.col("x") - F.col("d")), F.greatest(F.lit(0), F.col("y") - F.col("d"))
    right, bottom = F.least(F.lit(160), F.col("x") + F.col("w") + F.col("d")), F.least(F.lit(120), F.col("y") + F.col("h") + F.col("d"))
    return rows.select("image_id", "score", left.alias("left"), top.alias("top"), F.greatest(F.lit(1), right - left).alias("width"), F.greatest(F.lit(1), bottom - top).alias("height"))


def box_remap(spark, sf_dir):
    """Boxes of images scaled by 3, taken back outwards to whole pixels."""
    rows = boxes(spark, sf_dir)
    x, y = F.floor(F.col("x") / 3).cast("int"), F.floor(F.col("y") / 3).cast("int")
    right, bottom = F.ceil((F.col("x") + F.col("w")) / 3).cast("int"), F.ceil((F.col("y") + F.col("h")) / 3).cast("int")
    return rows.select("image_id", "score", F.least(x, F.lit(99)).alias("left"), F.least(y, F.lit(79)).alias("top"), F.greatest(F.lit(1), F.least(right - x, 100 - x)).alias("width"), F.greatest(F.lit(1), F.least(bottom - y, 80 - y)).alias("height"))


def box_centers(spark, sf_dir):
    """Screen order inside an image and integer centres."""
    order = Window.partitionBy("image_id").orderBy("y", "x", F.desc("score"), "w", "h")
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    return boxes(spark, sf_dir).select("image_id", F.row_number().over(order).alias("n"), (F.col("x") + half("w")).alias("cx"), (F.col("y") + half("h")).alias("cy"))


def compact_points(spark, sf_dir):
    order = [F.col("y"), F.col("x"), -F.col("score"), F.col("w"), F.col("h")]
    return boxes(spark, sf_dir).groupBy("image_id").agg(X.compact_points(order, F.col("score") % 10, F.col("x"), F.col("y")).alias("points"))


def match_json(spark, sf_dir):
    """Matches of an image as JSON in screen order."""
    order = [F.col("y"), F.col("x"), -F.col("score"), F.col("w"), F.col("h")]
    item = F.struct((F.col("score") % 10).alias("template_index"), "x", "y", "w", "h", F.col("score"))
    return boxes(spark, sf_dir).groupBy("image_id").agg(X.match_json(order, item).alias("json"), F.count("*").alias("n"))


def median_height(spark, sf_dir):
    """Median of heights, the mean of an even count's middle two truncated."""
    rows = boxes(spark, sf_dir).groupBy("image_id").agg(F.percentile("h", 0.5).alias("m"))
    return rows.select("image_id", F.floor("m").cast("int").alias("median_h"))


def latency_percentiles(spark, sf_dir):
    """The two percentile rules of the benchmarks over order prices of a customer: indices
    floor(0.95 (n - 1)) and ceil(0.95 n) - 1."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_totalprice")).alias("v"))
    n = F.size("v")
    return rows.select("o_custkey", F.element_at("v", F.expr("(95 * (size(v) - 1)) div 100 + 1").cast("int")).alias("low"), F.element_at("v", F.expr("(95 * size(v) + 99) div 100").cast("int")).alias("high"), n.alias("n"))


def fragment_runs(spark, sf_dir):
    """Runs of boxes of an image in x order whose gaps stay within 6 pixels."""
    order = Window.partitionBy("image_id").orderBy("x", "y", "w", "h", "score")
    rows = boxes(spark, sf_dir)
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    rows = rows.withColumn("fresh", F.when(gap.isNull() | (gap > 6), 1).otherwise(0)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("image_id", "run").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.count("*").alias("fragments"))


def fragment_pairs(spark, sf_dir):
    """Share of neighbours in x order that overlap in height and nearly touch."""
    order = Window.partitionBy("image_id").orderBy("x", "y", "w", "h", "score")
    last = {c: F.lag(c).over(order) for c in "xywh"}
    rows = boxes(spark, sf_dir).select("image_id", "x", "y", "w", "h", *[v.alias("p" + c) for c, v in last.items()])
    shared = F.greatest(F.lit(0), F.least(F.col("py") + F.col("ph"), F.col("y") + F.col("h")) - F.greatest("py", "y"))
    pad = F.ceil(F.col("ph") / 4) + F.ceil(F.col("h") / 4)
    near = (2 * shared >= F.least("ph", "h")) & (F.col("x") - F.col("px") - F.col("pw") < pad)
    return rows.groupBy("image_id").agg(F.count_if(near).alias("pairs"), F.count("*").alias("n")).where("n > 1").select("image_id", "pairs", (F.col("pairs") / (F.col("n") - 1)).alias("ratio"))


def coverage_gaps(spark, sf_dir):
    """Columns 0..127 that no box of an image covers: how many, and the runs at both ends."""
    rows = boxes(spark, sf_dir).select("image_id", F.explode(F.sequence(F.col("x"), F.least(F.lit(127), F.col("x") + F.col("w") - 1))).alias("c"))
    found = rows.groupBy("image_id").agg(F.countDistinct("c").alias("covered"), F.min("c").alias("leading"), (127 - F.max("c")).alias("trailing"))
    return found.select("image_id", (128 - F.col("covered")).alias("uncovered"), "leading", "trailing")


def detections(spark, sf_dir) -> DataFrame:
    """(image_id, cand, values): 64 floats as 8 candidates of cx, cy, w, h and 4 class scores."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1.0) * 500))
    listed = rows.select(F.col("vec_id").alias("image_id"), v.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("cand"))
    # scores as shares of 1000, so that equal ones tie in both engines
    return listed.select("image_id", "cand", F.transform(F.slice("v", F.col("cand") * 8 + 1, F.lit(8)), lambda x, i: F.when(i < 4, x * 0.64).otherwise(x / 1000)).alias("values"))


def detect_decode(spark, sf_dir):
    """Boxes of a 640 square with padding 80 above, in an image of 1280 x 960."""
    found = D.yolo_decode(detections(spark, sf_dir), F.lit(0.5), F.lit(0), F.lit(80), F.lit(1280), F.lit(960), 0.6)
    return found.select("image_id", "cand", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")], "class_id")


def detect_labels(spark, sf_dir):
    """Classes by name; those without a name by number."""
    labels = spark.createDataFrame([(0, "door"), (2, "key")], "class_id int, label string")
    return D.with_labels(detect_decode(spark, sf_dir), labels).groupBy("label").agg(F.count("*").alias("n"))


def logits(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    listed = rows.select(F.col("vec_id").alias("seq_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    return listed.select("seq_id", "t", F.slice("embedding", F.col("t") * 8 + 1, F.lit(8)).alias("probs"))


CHARS = ["", "a", "b", "c", "d", "e", "f", " "]


def ctc_greedy(spark, sf_dir):
    chars = spark.createDataFrame(list(enumerate(CHARS)), "idx int, ch string")
    found = D.ctc_greedy(logits(spark, sf_dir), chars)
    return found.select("seq_id", "text", F.round("confidence", 6).alias("confidence"))


def ctc_beam(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    return D.ctc_beam(rows.select(F.col("vec_id").alias("seq_id"), steps.alias("steps")), CHARS).withColumn("confidence", F.round("confidence", 6))


LABELS = [(0, "door"), (2, "key")]


def detect_json(spark, sf_dir):
    """Each image's detections as JSON; boxes to a thousandth of a pixel."""
    placed = {"scale": F.lit(0.5), "pad_x": F.lit(0), "pad_y": F.lit(80), "width": F.lit(1280), "height": F.lit(960)}
    rows = detections(spark, sf_dir).select("*", *[v.alias(k) for k, v in placed.items()])
    found = S.detect(rows, spark.createDataFrame(LABELS, "class_id int, label string"), 0.6)
    found = found.select("image_id", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2", "score")], "class_id", "cand", "label")
    return S.detections_json(rows, found)


def lines(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, box, text): a box of 8 pixels for each character."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    box = F.struct(F.lit(4).alias("x"), (F.col("turn") * 20).cast("int").alias("y"), (F.length("text") * 8).alias("w"), F.lit(16).alias("h"))
    return rows.select("conv_id", "turn", box.alias("box"), X.normalize_punctuation(F.col("text")).alias("text"))


def _hits(spark, sf_dir) -> DataFrame:
    """Targets are a bounded list of literals; each line is matched with all of them in its row."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("target_index"), F.lit(t).alias("target")) for i, t in enumerate(TARGETS)]))
    rows = lines(spark, sf_dir).select("conv_id", "turn", "box", "text", each.alias("t")).select("*", "t.*")
    rows = rows.where(F.contains("text", "target"))
    rows = rows.select("conv_id", "turn", "box", "text", "target_index", "target", F.explode(X.occurrences(F.col("text"), F.col("target"))).alias("hit_at"))
    sub = X.text_box(F.col("box"), F.col("text"), F.col("hit_at"), F.length("target"))
    return rows.select("conv_id", "turn", "target_index", "hit_at", sub.alias("b")).select("conv_id", "turn", "target_index", "hit_at", "b.x", "b.y", "b.w", "b.h")


def find_text_all(spark, sf_dir):
    return _hits(spark, sf_dir)


def find_text_first(spark, sf_dir):
    """First hit of a conversation: the earliest target with any, then by turn and place."""
    first = _hits(spark, sf_dir).groupBy("conv_id").agg(F.min(F.struct("target_index", "turn", "hit_at", "x", "y", "w", "h")).alias("m"))
    return first.select("conv_id", "m.*")


GROUPS = [["absent", "ing", "the"], ["nowhere"], ["on t", "the"]]


def _recognized(spark, sf_dir) -> DataFrame:
    """Lines with a confidence; every seventh one is not a number, others are low."""
    sure = F.when(F.length("text") % 7 == 0, F.lit(float("nan"))).otherwise((F.length("text") % 10) / 10)
    return lines(spark, sf_dir).select(F.col("conv_id").alias("image_id"), F.col("turn").alias("line_no"), "box.*", sure.alias("confidence"), "text")


def find_text_groups(spark, sf_dir):
    """Hits of groups of variants in lines from 0.3 on, moved by an origin."""
    return S.find_text(_recognized(spark, sf_dir), GROUPS, 0.3, (7, -3)).drop("confidence")


def find_text_points(spark, sf_dir):
    rows = _recognized(spark, sf_dir)
    return S.text_points(rows, S.find_text(rows, GROUPS, 0.3, (7, -3)))


def lines_json(spark, sf_dir):
    """Recognised lines as JSON; what is no number is zero."""
    rows = _recognized(spark, sf_dir).withColumn("text", F.translate("text", "\\\"\n\r\t", ""))
    order = [F.col("line_no"), F.col("text")]
    return rows.groupBy("image_id").agg(X.lines_json(order).alias("json"))


def target_groups(spark, sf_dir):
    """Groups of alternative targets that a conversation's lines match."""
    groups = [["absent", "ing"], ["nowhere"], ["the"]]
    rows = lines(spark, sf_dir)
    any_of = [F.coalesce(F.bool_or(F.exists(F.array(*map(F.lit, g)), lambda v: F.contains(F.col("text"), v))), F.lit(False)).cast("int") for g in groups]
    return rows.groupBy("conv_id").agg((any_of[0] + any_of[1] + any_of[2]).alias("matched"))


def line_text(spark, sf_dir):
    """A conversation's text in turn order without separators, and its visible characters."""
    rows = lines(spark, sf_dir).groupBy("conv_id").agg(X.text_of_lines([F.col("turn"), F.col("text")], F.col("text")).alias("all_text"), F.sum(X.visible_length(F.col("text"))).alias("visible"))
    return rows.select("conv_id", F.length("all_text").alias("n"), F.md5("all_text").alias("digest"), "visible")


def point_budget(spark, sf_dir, limit: int = 12):
    """Points that each box of an image may emit when all share a budget, largest first."""
    order = Window.partitionBy("image_id").orderBy(F.desc("w"), "x", "y", "h", "score")
    rows = boxes(spark, sf_dir).withColumn("n", F.expr("w div 8"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("image_id", "x", "y", "score", F.greatest(F.lit(0), F.least(F.col("n"), limit - before)).alias("points")).where("points > 0")


def _listed(spark, sf_dir) -> DataFrame:
    """Distinct boxes of each image, numbered by score and place, from one gather."""
    rows = boxes(spark, sf_dir, False)
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_set(F.struct("score", "x", "y", "w", "h"))).alias("boxes"))


def reading_order(spark, sf_dir):
    return B.order_lists(_listed(spark, sf_dir))


def merged_fragments(spark, sf_dir):
    return B.merge_lists(_listed(spark, sf_dir))


def candidate_fold(spark, sf_dir):
    """The preferred one of four candidates of each conversation, by the fold with margins."""

    def choose(found) -> tuple[int, int]:
        best, name = None, -1
        for k in sorted({r["candidate"] for r in found}):
            own = [R.TextLine(4, r["turn"] * 20, max(1, len(r["text"]) % 90), 16, 0.3 + (len(r["text"]) % 7) / 10, r["text"]) for r in found if r["candidate"] == k]
            e = R.evaluate(own, 120, 200, 0.5)
            if best is None or R.better(e, best):
                best, name = e, k
        return name, best.chars

    def run(batches):
        for batch in batches:
            chosen = [choose(found.as_py()) for found in batch.column("found")]
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "candidate": pa.array([c for c, _ in chosen], pa.int32()), "chars": pa.array([n for _, n in chosen], pa.int64())})

    item = F.struct((F.length("text") % 4).cast("int").alias("candidate"), F.col("turn").cast("int").alias("turn"), "text")
    rows = lines(spark, sf_dir).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("found"))
    return rows.mapInArrow(run, "conv_id long, candidate int, chars long")


def adaptive_scale(spark, sf_dir):
    rows = boxes(spark, sf_dir).select((F.col("w") * 40).alias("width"), (F.col("h") * 40).alias("height")).distinct()
    return rows.select("width", "height", F.round(P.adaptive_scale(F.col("width"), F.col("height")), 6).alias("scale"))


def letterbox_geometry(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("w", "h").distinct().withColumn("b", P.letterbox(F.col("w"), F.col("h"), 640))
    return rows.select("w", "h", F.round("b.scale", 9).alias("scale"), "b.pad_x", "b.pad_y")


LN = """WITH ln AS (SELECT conv_id, turn, CAST(turn * 20 AS INTEGER) AS box_y, CAST(length(text) * 8 AS INTEGER) AS box_w, translate(text, '：！【', ':![') AS text FROM conversations WHERE text IS NOT NULL)"""
HITS = LN + """, tg AS (SELECT * FROM (VALUES (0, 'the'), (1, 'ing'), (2, 'on t'), (3, 'absent')) v(target_index, target)),
pt AS (SELECT conv_id, turn, box_y, box_w, text, target_index, target, string_split(text, target) AS parts FROM ln, tg WHERE contains(text, target)),
oc AS (SELECT *, CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(target) AS INTEGER) AS hit_at FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM pt)),
ht AS (SELECT conv_id, turn, target_index, hit_at, 4 + box_w * hit_at // greatest(1, length(text)) AS x, box_y AS y,
  greatest(1, least(CAST(ceil(CAST(box_w AS BIGINT) * length(target) / greatest(1, length(text))) AS BIGINT), box_w - box_w * hit_at // greatest(1, length(text)))) AS w, 16 AS h FROM oc)"""
GROUPED = HITS.replace("(VALUES (0, 'the'), (1, 'ing'), (2, 'on t'), (3, 'absent')) v(target_index, target)", "(VALUES (0, 0, 'absent'), (0, 1, 'ing'), (0, 2, 'the'), (1, 0, 'nowhere'), (2, 0, 'on t'), (2, 1, 'the')) v(target_index, variant, target)").replace(
    "SELECT conv_id, turn, box_y, box_w, text, target_index, target, string_split", "SELECT conv_id, turn, box_y, box_w, text, target_index, variant, target, string_split"
).replace("WHERE contains(text, target))", "WHERE contains(text, target) AND length(text) % 7 <> 0 AND (length(text) % 10) / 10 >= 0.3::DOUBLE QUALIFY variant = min(variant) OVER (PARTITION BY conv_id, target_index))").replace(
    "ht AS (SELECT conv_id, turn, target_index,", "hg AS (SELECT conv_id AS image_id, turn AS line_no, target_index, variant,"
)
ORDERED = "(PARTITION BY image_id ORDER BY x, y, w, h, score)"

SQL = {
    "box_iou_pairs": BOX + f""", k AS (SELECT *, concat_ws(',', score, x, y, w, h) AS key FROM bx), p AS (SELECT a.image_id, a.key AS key_a, b.key AS key_b, {INTER.format(a='a', b='b')} AS i, a.w * a.h + b.w * b.h AS s FROM k a JOIN k b ON a.image_id = b.image_id AND a.key < b.key)
      SELECT image_id, key_a, key_b, round(i / (s - i), 9) AS iou FROM p WHERE i > 0""",
    "box_nms": "WITH RECURSIVE " + BOX.removeprefix("WITH ") + """, l AS (SELECT image_id, list({'s': score, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY score DESC, x, y, w, h) AS b FROM bx GROUP BY image_id),
      k AS (SELECT image_id, b, 1 AS i, b[1:1] AS kept FROM l UNION ALL
        SELECT image_id, b, i + 1, CASE WHEN len(list_filter(kept, lambda a: """ + INTER.replace("{b}", "b[i + 1]").replace("{a}", "a") + """ > 0.45::DOUBLE * (a.w * a.h + b[i + 1].w * b[i + 1].h - """ + INTER.replace("{b}", "b[i + 1]").replace("{a}", "a") + """))) > 0 THEN kept ELSE list_append(kept, b[i + 1]) END FROM k WHERE i < len(b))
      SELECT image_id, u.x AS x, u.y AS y, u.w AS w, u.h AS h, u.s AS score FROM (SELECT image_id, unnest(kept) AS u FROM k WHERE i = len(b))""",
    "origin_offset": BOX + ", r AS (SELECT *, max(CAST(x AS BIGINT) + 2147483558) OVER (PARTITION BY image_id) > 2147483647 AS rejected FROM bx) SELECT image_id, CASE WHEN rejected THEN x ELSE CAST(CAST(x AS BIGINT) + 2147483558 AS INTEGER) END AS x, CASE WHEN rejected THEN y ELSE y - 5 END AS y, w, h, score, rejected FROM (SELECT * REPLACE (rejected AS rejected) FROM r)".replace("CAST(CAST(x AS BIGINT) + 2147483558 AS INTEGER)", "TRY_CAST(CAST(x AS BIGINT) + 2147483558 AS INTEGER)"),
    "box_unclip": BOX + ", d AS (SELECT *, CAST(ceil(w * h * 1.5::DOUBLE / (2 * (w + h))) AS INTEGER) AS d FROM bx), e AS (SELECT *, greatest(0, x - d) AS l, greatest(0, y - d) AS t, least(160, x + w + d) AS r, least(120, y + h + d) AS b FROM d) SELECT image_id, score, l AS \"left\", t AS top, greatest(1, r - l) AS width, greatest(1, b - t) AS height FROM e",
    "box_remap": BOX + " SELECT image_id, score, least(x // 3, 99) AS \"left\", least(y // 3, 79) AS top, greatest(1, least((x + w + 2) // 3 - x // 3, 100 - x // 3)) AS width, greatest(1, least((y + h + 2) // 3 - y // 3, 80 - y // 3)) AS height FROM bx",
    "box_centers": BOX + " SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY y, x, score DESC, w, h) AS n, x + w // 2 AS cx, y + h // 2 AS cy FROM bx",
    "compact_points": BOX + " SELECT image_id, string_agg(concat_ws(',', score % 10, x, y), '|' ORDER BY y, x, score DESC, w, h) AS points FROM bx GROUP BY image_id",
    "match_json": BOX + " SELECT image_id, CAST(to_json(list({'template_index': score % 10, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score} ORDER BY y, x, score DESC, w, h)) AS VARCHAR) AS json, count(*) AS n FROM bx GROUP BY image_id",
    "median_height": BOX + " SELECT image_id, CAST(floor(quantile_cont(h, 0.5)) AS INTEGER) AS median_h FROM bx GROUP BY image_id",
    "latency_percentiles": "SELECT o_custkey, v[(95 * (len(v) - 1)) // 100 + 1] AS low, v[(95 * len(v) + 99) // 100] AS high, len(v) AS n FROM (SELECT o_custkey, list(o_totalprice ORDER BY o_totalprice) AS v FROM orders GROUP BY o_custkey)",
    "fragment_runs": BOX + f", g AS (SELECT *, x - lag(x + w) OVER {ORDERED} AS gap FROM bx), r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY x, y, w, h, score ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT image_id, run, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS fragments FROM r GROUP BY image_id, run",
    "fragment_pairs": BOX + f", p AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM bx WINDOW o AS {ORDERED}) SELECT image_id, count(*) FILTER (2 * greatest(0, least(py + ph, y + h) - greatest(py, y)) >= least(ph, h) AND x - px - pw < (ph + 3) // 4 + (h + 3) // 4 AND px IS NOT NULL) AS pairs, pairs / (count(*) - 1) AS ratio FROM p GROUP BY image_id HAVING count(*) > 1",
    "coverage_gaps": BOX + ", c AS (SELECT image_id, unnest(range(x, least(128, x + w))) AS c FROM bx) SELECT image_id, 128 - count(DISTINCT c) AS uncovered, min(c) AS leading, 127 - max(c) AS trailing FROM c GROUP BY image_id",
    "detect_decode": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor((CAST(e AS DOUBLE) + 1.0) * 500)) AS v FROM embeddings),
      c AS (SELECT vec_id AS image_id, k AS cand, list_transform(v[k * 8 + 1:k * 8 + 4], lambda x: x * 0.64::DOUBLE) AS b, v[k * 8 + 5:k * 8 + 8] AS s FROM (SELECT *, unnest(range(8)) AS k FROM v)),
      d AS (SELECT *, list_max(s) AS m FROM c)
      SELECT image_id, CAST(cand AS INTEGER) AS cand, round(least(greatest((b[1] - b[3] / 2) / 0.5::DOUBLE, 0), 1280), 6) AS x1, round(least(greatest((b[2] - b[4] / 2 - 80) / 0.5::DOUBLE, 0), 960), 6) AS y1,
        round(least(greatest((b[1] + b[3] / 2) / 0.5::DOUBLE, 0), 1280), 6) AS x2, round(least(greatest((b[2] + b[4] / 2 - 80) / 0.5::DOUBLE, 0), 960), 6) AS y2, round(m / 1000, 6) AS score, CAST(list_position(s, m) - 1 AS INTEGER) AS class_id FROM d WHERE m >= 600""",
    "ctc_greedy": """WITH l AS (SELECT vec_id AS seq_id, t, list_transform(embedding[t * 8 + 1:t * 8 + 8], lambda e: CAST(e AS DOUBLE)) AS p FROM (SELECT *, unnest(range(8)) AS t FROM embeddings)),
      m AS (SELECT seq_id, t, list_position(p, list_max(p)) - 1 AS idx, CASE WHEN list_min(p) >= -1e-6 AND list_max(p) <= 1 + 1e-6 AND list_sum(p) > 0.95 AND list_sum(p) < 1.05 THEN list_max(p) ELSE 1.0 / list_sum(list_transform(p, lambda x: exp(x - list_max(p)))) END AS c FROM l),
      e AS (SELECT *, idx <> 0 AND idx IS DISTINCT FROM lag(idx) OVER (PARTITION BY seq_id ORDER BY t) AS emit FROM m)
      SELECT seq_id, coalesce(string_agg(['', 'a', 'b', 'c', 'd', 'e', 'f', ' '][idx + 1], '' ORDER BY t) FILTER (emit), '') AS text, round(coalesce(avg(c) FILTER (emit), 0), 6) AS confidence FROM e GROUP BY seq_id""",
    "find_text_all": HITS + " SELECT conv_id, turn, target_index, hit_at, x, y, w, h FROM ht",
    "find_text_first": HITS + " SELECT conv_id, target_index, turn, hit_at, x, y, w, h FROM ht QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY target_index, turn, hit_at, x, y, w, h) = 1",
    "find_text_groups": GROUPED + " SELECT image_id, target_index, variant, line_no, hit_at, x + 7 AS x, y - 3 AS y, w, h, x + 7 + w // 2 AS cx, y - 3 + h // 2 AS cy, false AS rejected FROM hg",
    "find_text_points": GROUPED + ", p AS (SELECT image_id, string_agg(concat_ws(',', target_index, x + 7 + w // 2, y - 3 + h // 2), '|' ORDER BY target_index, line_no, hit_at) AS points FROM hg GROUP BY image_id) SELECT i.image_id, coalesce(points, '') AS points FROM (SELECT DISTINCT conv_id AS image_id FROM ln) i LEFT JOIN p USING (image_id)",
    "lines_json": LN + """, c AS (SELECT *, translate(text, chr(92) || chr(34) || chr(10) || chr(13) || chr(9), '') AS plain, CASE WHEN length(text) % 7 = 0 THEN 0 ELSE (length(text) % 10) / 10 END AS sure FROM ln)
      SELECT conv_id AS image_id, '{"lines":' || CAST(to_json(list({'text': plain, 'confidence': sure, 'box': {'x': 4, 'y': box_y, 'w': box_w, 'h': 16}} ORDER BY turn, plain)) AS VARCHAR) || '}' AS json FROM c GROUP BY conv_id""",
    "target_groups": LN + " SELECT conv_id, CAST(bool_or(contains(text, 'absent') OR contains(text, 'ing')) AS INTEGER) + CAST(bool_or(contains(text, 'nowhere')) AS INTEGER) + CAST(bool_or(contains(text, 'the')) AS INTEGER) AS matched FROM ln GROUP BY conv_id",
    "line_text": LN + ", t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS all_text, sum(length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]', '', 'g'))) AS visible FROM ln GROUP BY conv_id) SELECT conv_id, length(all_text) AS n, md5(all_text) AS digest, CAST(visible AS BIGINT) AS visible FROM t",
    "point_budget": BOX + ", p AS (SELECT *, w // 8 AS n, coalesce(sum(w // 8) OVER (PARTITION BY image_id ORDER BY w DESC, x, y, h, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM bx) SELECT image_id, x, y, score, CAST(greatest(0, least(n, 12 - b)) AS BIGINT) AS points FROM p WHERE least(n, 12 - b) > 0",
    "adaptive_scale": BOX + " SELECT DISTINCT w * 40 AS width, h * 40 AS height, round(greatest(1.0, least(3.0, 1536 / greatest(w * 40, h * 40), sqrt(4000000.0 / (w * h * 1600)))), 6) AS scale FROM bx",
    "letterbox_geometry": BOX + ", s AS (SELECT DISTINCT w, h, least(640 / w, 640 / h) AS s FROM bx) SELECT w, h, round(s, 9) AS scale, CAST(floor((640 - floor(w * s)) / 2) AS INTEGER) AS pad_x, CAST(floor((640 - floor(h * s)) / 2) AS INTEGER) AS pad_y FROM s",
}
# the decoded boxes of detect_decode, at full precision, through the greedy fold
SQL["detect_json"] = (
    "WITH RECURSIVE " + SQL["detect_decode"].removeprefix("WITH ").split("SELECT image_id, CAST(cand")[0].rstrip() + """,
      e AS (SELECT image_id, CAST(cand AS INTEGER) AS cand, least(greatest((b[1] - b[3] / 2) / 0.5::DOUBLE, 0), 1280) AS x, least(greatest((b[2] - b[4] / 2 - 80) / 0.5::DOUBLE, 0), 960) AS y,
        least(greatest((b[1] + b[3] / 2) / 0.5::DOUBLE, 0), 1280) AS x2, least(greatest((b[2] + b[4] / 2 - 80) / 0.5::DOUBLE, 0), 960) AS y2, m / 1000 AS s, CAST(list_position(s, m) - 1 AS INTEGER) AS c FROM d WHERE m >= 600),
      l AS (SELECT image_id, list({'x': x, 'y': y, 'w': x2 - x, 'h': y2 - y, 'x2': x2, 'y2': y2, 's': s, 'c': c, 'k': cand} ORDER BY s DESC, cand) AS b FROM e GROUP BY image_id),
      k AS (SELECT image_id, b, 1 AS i, b[1:1] AS kept FROM l UNION ALL
        SELECT image_id, b, i + 1, CASE WHEN len(list_filter(kept, lambda a: """ + INTER.replace("{b}", "b[i + 1]").replace("{a}", "a") + """ > 0.45::DOUBLE * (a.w * a.h + b[i + 1].w * b[i + 1].h - """ + INTER.replace("{b}", "b[i + 1]").replace("{a}", "a") + """))) > 0 THEN kept ELSE list_append(kept, b[i + 1]) END FROM k WHERE i < len(b)),
      u AS (SELECT image_id, unnest(kept) AS u FROM k WHERE i = len(b)),
      r AS (SELECT image_id, round(u.x, 3) AS x1, round(u.y, 3) AS y1, round(u.x2, 3) AS x2, round(u.y2, 3) AS y2, round(u.s, 3) AS score, u.c AS class_id, u.k AS cand, CASE u.c WHEN 0 THEN 'door' WHEN 2 THEN 'key' ELSE CAST(u.c AS VARCHAR) END AS label FROM u),
      j AS (SELECT image_id, CAST(to_json(list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'cx': (x1 + x2) * 0.5::DOUBLE, 'cy': (y1 + y2) * 0.5::DOUBLE, 'score': score, 'class_id': class_id, 'label': label} ORDER BY score DESC, cand)) AS VARCHAR) AS json FROM r GROUP BY image_id)
      SELECT vec_id AS image_id, coalesce(json, '[]') AS json FROM embeddings LEFT JOIN j ON image_id = vec_id"""
)
SQL["detect_labels"] = SQL["detect_decode"].replace("WITH v AS", "WITH dd AS (WITH v AS") + ") SELECT CASE class_id WHEN 0 THEN 'door' WHEN 2 THEN 'key' ELSE CAST(class_id AS VARCHAR) END AS label, count(*) AS n FROM dd GROUP BY label"

QUERIES = (
    box_iou_pairs, box_nms, origin_offset, box_unclip, box_remap, box_centers, compact_points, match_json, median_height, latency_percentiles, fragment_runs, fragment_pairs, coverage_gaps,
    detect_decode, detect_labels, detect_json, ctc_greedy, ctc_beam, find_text_all, find_text_first, find_text_groups, find_text_points, lines_json, target_groups, line_text, point_budget, reading_order, merged_fragments, candidate_fold, adaptive_scale, letterbox_geometry,
)
