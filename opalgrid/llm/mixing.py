"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``SHARE`` times all
words; a target stops at ``MOST`` times its source's words and the excess is shared again by weight.
Each document of a source expects target / source words copies.  Documents are ordered by size and a
keyed hash, the expected copies are summed along that order, a random offset of the source is added
once, and a document is emitted once per integer boundary that its step crosses.

Prefix sums are distributed: rows are sorted into ranges, each range knows its rows' places, and only
the counts of (range, source) are summed along the ranges.  A range ends where it is full, within a
source or not, so a source with a third of all rows is spread over many tasks.  Sources are ranked
in the same way, and the level at which targets stop is found by one aggregate a round.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source of
its own; repeated rows are sampled row by row (which of rows that agree in doc_id, source and size is
taken oftener is left open); null doc_ids are allowed; empty tables give no rows; other columns,
whatever their names, are kept by ``mix``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.llm._store import bounded, stored
from opalgrid.llm._text import BLANK, chunks, spans

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 20240229
START_BITS = 28


def _size_task(batches):
    for rows, data, offsets in chunks(batches):
        _, _, bounds = spans(data, offsets, BLANK)
        names = [c for c in rows.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(np.diff(bounds), pa.int64())], names=[*names, "size"])


def word_sizes(documents: DataFrame, **key: Column) -> DataFrame:
    """(doc_id, source, size) of each row, after further columns of long numbers."""
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "text": F.col("text").cast("string")}
    docs = documents.select(*[c.alias(k) for k, c in (key | own).items()])
    fields = "".join(f"{k} long, " for k in key)
    return docs.mapInArrow(_size_task, f"{fields}doc_id long, source string, size long")


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with mix_rank: each row's place, from 0, among those of its group (not null) in an order."""
    at = stored(rows.orderBy(group, *order).withColumn("mix_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("mix_at", 33)
    parts = at.groupBy(group, part.alias("mix_range")).agg(F.min("mix_at").alias("mix_first"), F.count("*").alias("mix_n"))
    # a group has one row per range here
    before = Window.partitionBy(group).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select(group, "mix_range", "mix_first", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_before")), "offsets")
    found = at.withColumn("mix_range", part).join(bounded(parts), [group, "mix_range"])
    return found.withColumn("mix_rank", F.col("mix_at") - F.col("mix_first") + F.col("mix_before")).drop("mix_at", "mix_range", "mix_first", "mix_before")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target), one row per source.

    Sources fill up together in proportion to their weights; each round finds those that the level
    would fill beyond ``most`` times their size and shares what they leave, until none is added."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(table, (F.pmod("mix_rank", F.lit(len(weights))) + 1).cast("int")).alias("mix_weight")
    order = ranked(totals.withColumn("mix_all", F.lit(0)), "mix_all", F.col("source").isNull(), F.col("source"))
    goals = stored(order.select("source", "source_size", weight), "sources")

    def full(level: float) -> Column:
        return F.col("mix_weight") * F.lit(level) > F.col("source_size") * F.lit(float(most))

    level, known = 0.0, None
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = full(level) if known is not None else F.lit(False)
        n, size, open_ = goals.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("mix_weight")))).first()
        if n == known or not open_:
            break
        level, known = (share * total - most * (size or 0)) / open_, n
    target = F.when(full(level), F.col("source_size") * F.lit(float(most))).otherwise(F.col("mix_weight") * F.lit(level))
    return goals.select("source", "source_size", target.alias("target"))


def copies(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and mix_copies to stored rows of (doc_id, source, size, ...)."""
    keyed = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    goals = stored(source_targets(sized, weights, share, most).withColumn("mix_source", keyed).drop("source"), "targets")
    mark = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary")), 1, 16)
    rows = sized.withColumn("mix_source", keyed).withColumn("mix_mark", mark).withColumn("mix_tie", F.monotonically_increasing_id())
    # the tie spreads rows that agree in all else over ranges
    found = ranked(rows, "mix_source", F.col("size"), F.col("mix_mark"), F.col("doc_id"), F.col("mix_tie")).join(bounded(goals), "mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("mix_source")).cast("binary")), 1, START_BITS // 4)
    start = F.conv(draw, 16, 10).cast("double") / F.lit(float(1 << START_BITS))
    crossed = F.floor((F.col("mix_rank") + 1) * rate + start) - F.floor(F.col("mix_rank") * rate + start)
    # a document never exceeds `most` copies, whatever the rounding of the two sums
    return found.withColumn("mix_copies", F.least(crossed, F.ceil(rate), F.floor(F.lit(float(most))))).drop("mix_source", "mix_mark", "mix_tie", "mix_rank")


def plan(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of documents."""
    found = copies(stored(word_sizes(documents), "sizes"), **options)
    return found.select("doc_id", "size", "source_size", "target", (F.col("mix_copies") * F.col("size")).cast("long").alias("taken"), F.col("mix_copies").cast("long").alias("copies"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """Rows of documents, each as often as the mix takes it, with mix_copy (0, 1, ...); the column is
    called mix_copy_2, mix_copy_3, ... where documents has the name before it.

    Rows are told apart by doc_id, source and two hashes of the text; where some agree in all of
    these, the documents are written once more with a number for each row."""
    text = F.col("text").cast("string")
    key = {"mix_id": F.col("doc_id").cast("long"), "mix_a": F.xxhash64(text), "mix_b": F.xxhash64(F.lit(1), text, F.length(text), F.col("source").cast("string"))}
    sized = stored(word_sizes(documents, **key), "sizes")
    columns = documents.columns
    if not sized.groupBy(*key).count().where("count > 1").isEmpty():
        documents = stored(documents.withColumn("__mix_row", F.monotonically_increasing_id()), "numbered")
        key = {"mix_row": F.col("__mix_row")}
        sized = stored(word_sizes(documents, **key), "sizes")
    found = copies(sized, **options).where("mix_copies > 0").select(*[F.col(k).alias(f"__{k}_of") for k in key], F.col("mix_copies").cast("int").alias("__mix_times"))
    same = F.lit(True)
    for k, c in key.items():
        same = same & F.col(f"__{k}").eqNullSafe(F.col(f"__{k}_of"))
    rows = documents.select("*", *[c.alias(f"__{k}") for k, c in key.items() if k != "mix_row"])
    name = next(n for n in ("mix_copy", *(f"mix_copy_{i}" for i in range(2, len(columns) + 3))) if n not in columns)
    taken = F.explode(F.sequence(F.lit(0), F.col("__mix_times") - 1)).alias(name)
    return rows.join(found, same).select(*[F.col(f"`{c}`") for c in columns], taken)
