"""Quality rules with host verdicts.

Each text is measured once; a document that fails a base rule is rejected.  Lines and windows count
as equal if their bytes are.  Rule failures are summed by host (the ``source`` column), the hosts'
failure rates are shrunk towards the corpus by a beta prior fitted to all hosts by moments, and
hosts whose shrunk rate lies ``HOST_MARGIN`` or more above the corpus rate are bad: their documents
are rejected too.  Only counts by host are shuffled; the host verdicts are joined back, sent to
every task where their number is at most ``BROADCAST_ROWS`` and by a shuffle beyond it.

Defined results: null and empty texts have no words and fail (too few words); a null host is a host
of its own; repeated rows count each; an empty table gives an empty result; one text may be as long
as a task's memory allows; other columns, whatever their names, are not looked at, and ``keep_good``
returns them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._store import bounded, stored
from opalgrid.llm._text import BLANK, chunks, count_by_row, exact_ids, rows_of, spans

MIN_WORDS, MAX_REPEAT_PERCENT, HOST_MARGIN, GRAM = 50, 50, 0.25, 3
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CHARACTER = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


def _runs(values: list[np.ndarray], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of rows of numbers, and where in it one equals its forerunner in the same text.

    Texts come in ascending order, so equal values of one text stay together."""
    order = np.argsort(values[0], kind="stable") if len(values) == 1 else np.lexsort(values[::-1])
    twin = np.ones(max(0, len(order) - 1), bool)
    for c in (*values, row):
        s = c[order]
        twin &= s[1:] == s[:-1]
    return order, twin


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of MEASURES for each row."""
    starts, ends, bounds = spans(data, offsets, BLANK)
    row, n_rows = rows_of(bounds), len(offsets) - 1
    word = ~BLANK[data]
    chars = count_by_row(CHARACTER[data] & word, offsets)
    symbols = count_by_row(SYMBOL[data], offsets)
    # lines end at \n and at the row's end
    newline = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1], newline + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.r_[line_starts[1:], len(data)]
    line_ends = line_ends - (data[line_ends - 1] == 10) if len(line_ends) else line_ends
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    # lines and words are numbered by their bytes, so what counts as equal is equal
    again = np.zeros(len(line_starts), bool)
    order, twin = _runs([exact_ids(data, line_starts, line_ends)[0]], line_row)
    again[order[1:]] = twin
    dup_lines = np.bincount(line_row[again], minlength=n_rows)
    # words inside windows found twice or more
    ids = exact_ids(data, starts, ends, word)[0]
    at = np.flatnonzero(row[: len(ids) - GRAM + 1] == row[GRAM - 1 :]) if len(ids) >= GRAM else np.empty(0, np.int64)
    grams = [ids[at + k] for k in range(GRAM)]
    if len(ids) and ids.max() < 1 << 63 // GRAM:
        grams = [sum(g << (63 // GRAM * k) for k, g in enumerate(grams))]
    order, twin = _runs(grams, row[at])
    many = np.zeros(len(ids) + GRAM, bool)
    many[at[order[1:][twin]]] = True
    many[at[order[:-1][twin]]] = True
    inside = many.copy()
    for k in range(1, GRAM):
        inside[k:] |= many[:-k]
    repeat = count_by_row(inside[: len(ids)], bounds)
    words = np.diff(bounds)
    failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
    return [words, chars, symbols, dup_lines, repeat, failed]


def _measure_task(keep: bool):
    def run(batches):
        for rows, data, offsets in chunks(batches):
            found = measure(data, offsets)
            columns = [pa.array(x, pa.bool_() if i == 5 else pa.int64()) for i, x in enumerate(found)]
            kept = rows if keep else rows.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, *(f"__q_{c}" for c in COLUMNS)])

    return run


def _measured(df: DataFrame, keep: bool) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if keep or f.name != "text")
    measures = ", ".join("__q_" + m.strip() for m in MEASURES.split(","))
    return df.mapInArrow(_measure_task(keep), f"{fields}, {measures}")


def prior(hosts: int, docs: int, failed: int, squares: float) -> tuple[float, float]:
    """Mean and strength (in documents) of the beta prior; squares: sum of failed**2 / docs by host.

    The mean is the corpus failure rate; the strength follows from the variance of the hosts' rates
    less what sampling alone gives (method of moments), at least 1 and at most 1000 documents."""
    if not docs:
        return 0.5, 1.0
    mean = failed / docs
    between = max(1e-9, max(0.0, squares / docs - mean * mean) - mean * (1 - mean) * hosts / docs)
    return mean, min(1000.0, max(1.0, mean * (1 - mean) / between - 1))


def _verdicts(measured: DataFrame, margin: float) -> DataFrame:
    """(host, host_docs, host_rate, host_bad) from rows of (host, __q_base_failed)."""
    counts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("__q_base_failed").cast("long")).alias("failed"))
    counts = stored(counts, "hosts")
    squares = F.coalesce(F.sum(F.col("failed") * F.col("failed") / F.col("host_docs")), F.lit(0.0))
    mean, strength = prior(*counts.agg(F.count("*"), F.coalesce(F.sum("host_docs"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0)), squares).first())
    rate = (F.col("failed") + F.lit(strength * mean)) / (F.col("host_docs") + F.lit(strength))
    return counts.select("host", "host_docs", rate.alias("host_rate"), (rate >= F.lit(mean + margin)).alias("host_bad"))


def host_verdicts(documents: DataFrame, host: str = "source", margin: float = HOST_MARGIN) -> DataFrame:
    """(host, host_docs, host_rate, host_bad): one row per host, null included."""
    texts = documents.select(F.col(f"`{host}`").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return _verdicts(_measured(texts, False), margin)


def judge(documents: DataFrame, host: str = "source", margin: float = HOST_MARGIN) -> DataFrame:
    """doc_id, the measures, base_failed, kept and host_rate of each row of documents."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    rows = stored(_measured(texts, False), "measures")
    verdicts = bounded(_verdicts(rows, margin).withColumnRenamed("host", "__q_host"))
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("__q_host")), "left")
    kept = ~F.col("__q_base_failed") & ~F.coalesce("host_bad", F.lit(False))
    return joined.select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in COLUMNS], kept.alias("kept"), "host_rate")


def keep_good(documents: DataFrame, host: str = "source", margin: float = HOST_MARGIN) -> DataFrame:
    """The rows of documents that no rule rejects, with all their columns."""
    failed = F.col("__q_base_failed")
    measured = _measured(documents.withColumn("text", F.col("text").cast("string")), True)
    # a row that fails leaves its host only
    rows = stored(measured.select(*[F.when(~failed, F.col(f"`{c}`")).alias(f"__q_{i}") for i, c in enumerate(documents.columns)], F.col(f"`{host}`").cast("string").alias("host"), failed), "measured")
    bad = bounded(_verdicts(rows, margin).where("host_bad").select(F.col("host").alias("__q_bad")))
    good = rows.where(~failed).join(bad, F.col("host").eqNullSafe(F.col("__q_bad")), "left_anti")
    return good.select(*[F.col(f"__q_{i}").alias(c) for i, c in enumerate(documents.columns)])
