"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of ``WINDOW`` consecutive words.  A window is contained in a
document only if all its shingles are (containment 1), so by the prefix-filter principle it is
enough to look one up: windows are indexed by their rarest shingle, counted over all documents.
A match at word p of a shingle at place q of a window fixes the only possible start p - q; the
start must lie in the document (position bound) and the window must end in it (length bound).
What is left is verified word by word over the item-sized window.

The benchmark is a stated query set.  It is handled in blocks of at most ``BLOCK_BYTES`` of text, one
at a time: the driver and each task hold one block only.  One block, as benchmarks of a few
thousand items make, is sent to the tasks that read the documents, and nothing is shuffled.  With
more blocks each is searched in a pass of its own; what a pass finds is written, and meets the
documents' rows in a join.

Defined results: null or empty texts have no words and are clean; items without words or without
an id are ignored; repeated items count once; an item of fewer words than a window is one window;
repeated document rows each get a row; empty tables give no rows, or clean ones without items; a
text may be as long as a task's memory allows; other columns of either table, whatever their names,
are not looked at, and ``decontaminate`` returns them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._store import stored
from opalgrid.llm._text import LOWER, NOT_ALNUM, chunks, count_by_row, cover, gram_hashes, rows_of, spans, word_hashes

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 8 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items string"


class Block:
    """Windows of one block of items, looked up by one shingle each."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        column = pa.array([text for _, text in items], pa.string())
        self.window_words: list[list[bytes]] = []
        self.owners: list[list[str]] = []
        hashes, seen = [], {}
        for rows, data, offsets in chunks([pa.record_batch({"text": column, "id": pa.array([i for i, _ in items], pa.string())})]):
            data = LOWER[data]
            starts, ends, bounds = spans(data, offsets, NOT_ALNUM)
            codes, raw, ids = word_hashes(data, starts, ends), data.tobytes(), rows.column("id").to_pylist()
            for r, item in enumerate(ids):
                lo, hi = bounds[r], bounds[r + 1]
                for a in range(lo, max(lo + 1, hi - window + 1) if hi > lo else lo):
                    b = min(a + window, hi)
                    words = [raw[starts[i] : ends[i]] for i in range(a, b)]
                    k = seen.setdefault(tuple(words), len(self.owners))
                    if k == len(self.owners):
                        self.window_words.append(words)
                        self.owners.append([])
                        hashes.append(codes[a:b])
                    if not self.owners[k] or self.owners[k][-1] != item:
                        self.owners[k].append(item)
        # A window's shingles: all runs of `shingle` words, or of all its words if it has fewer.
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.hashes = hashes
        self.grams = [(min(shingle, len(h)), gram_hashes(h, min(shingle, len(h)))) for h in hashes]
        self.vocabulary = {n: np.unique(np.concatenate([g for m, g in self.grams if m == n])) for n in {m for m, _ in self.grams}}
        self.filters = {n: _bits(v) for n, v in self.vocabulary.items()}

    def occurrences(self, codes: np.ndarray):
        """(shingle size, places in codes, numbers in the vocabulary) of all known shingles."""
        for n, known in self.vocabulary.items():
            grams = gram_hashes(codes, n)
            at = np.flatnonzero(self.filters[n][(grams & np.uint64(0xFFFFF)).astype(np.int64)])
            k = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
            same = known[k] == grams[at]
            yield n, at[same], k[same]

    def index(self, counts: dict[int, np.ndarray]) -> None:
        """Files each window under its rarest shingle (leftmost on ties)."""
        lists: dict[int, dict[int, list[tuple[int, int]]]] = {n: defaultdict(list) for n in self.vocabulary}
        for w, (n, grams) in enumerate(self.grams):
            k = np.searchsorted(self.vocabulary[n], grams)
            q = int(np.argmin(counts[n][k]))
            lists[n][int(k[q])].append((w, q))
        self.prefixes = {}
        for n, of in lists.items():
            starts = np.zeros(len(self.vocabulary[n]) + 1, np.int64)
            for k, v in of.items():
                starts[k + 1] = len(v)
            pairs = np.array([p for k in sorted(of) for p in of[k]], np.int64).reshape(-1, 2)
            self.prefixes[n] = np.cumsum(starts), pairs
            used = np.array([self.vocabulary[n][k] for k in of], np.uint64)
            self.filters[n] = _bits(used)
        self.flat_hashes = np.concatenate(self.hashes)
        self.flat_starts = np.cumsum(self.sizes) - self.sizes


def _bits(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return out


def _hits(block: Block, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, codes: np.ndarray):
    """Verified (start word, window) pairs of a chunk."""
    row, raw = rows_of(bounds), None
    for n, at, k in block.occurrences(codes):
        first, pairs = block.prefixes[n]
        n_of = first[k + 1] - first[k]
        at, k, n_of = at[n_of > 0], k[n_of > 0], n_of[n_of > 0]
        if not len(at):
            continue
        rep = np.repeat(np.arange(len(at)), n_of)
        entry = pairs[first[k][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n_of) - n_of, n_of)]
        window, start, place = entry[:, 0], at[rep] - entry[:, 1], at[rep]
        # the window begins and ends in the document that holds the shingle
        here = row[place]
        ok = (start >= bounds[here]) & (start + block.sizes[window] <= bounds[here + 1])
        window, start = window[ok], start[ok]
        for i in range(int(block.sizes[window].max(initial=0))):
            inside = block.sizes[window] > i
            same = np.ones(len(window), bool)
            same[inside] = codes[start[inside] + i] == block.flat_hashes[block.flat_starts[window[inside]] + i]
            window, start = window[same], start[same]
        raw = data.tobytes() if raw is None and len(window) else raw
        for w, s in zip(window.tolist(), start.tolist()):
            if all(raw[starts[s + i] : ends[s + i]] == word for i, word in enumerate(block.window_words[w])):
                yield s, w


def _count_task(block: Block):
    def run(batches):
        totals = {n: np.zeros(len(v), np.int64) for n, v in block.vocabulary.items()}
        for _, data, offsets in chunks(batches):
            data = LOWER[data]
            starts, ends, bounds = spans(data, offsets, NOT_ALNUM)
            row = rows_of(bounds)
            for n, at, k in block.occurrences(word_hashes(data, starts, ends)):
                k = k[row[at] == row[at + n - 1]]
                totals[n] += np.bincount(k, minlength=len(totals[n]))
        for n, t in totals.items():
            k = np.flatnonzero(t)
            if len(k):
                yield pa.record_batch({"n": pa.array(np.full(len(k), n)), "k": pa.array(k), "count": pa.array(t[k])})

    return run


def _hit_chunks(block: Block, batches):
    """For each chunk: rows, word bounds, hit words, and each row's set of items."""
    for rows, data, offsets in chunks(batches):
        data = LOWER[data]
        starts, ends, bounds = spans(data, offsets, NOT_ALNUM)
        row = rows_of(bounds)
        items: dict[int, set[str]] = defaultdict(set)
        a, b = [], []
        for s, w in _hits(block, data, starts, ends, bounds, word_hashes(data, starts, ends)):
            a.append(s)
            b.append(s + int(block.sizes[w]))
            items[int(row[s])].update(block.owners[w])
        hit = cover(np.array(a, np.int64), np.array(b, np.int64), len(starts)) if a else np.zeros(len(starts), bool)
        yield rows, bounds, hit, items


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _result(ids, n_words, n_hit, items: list[list[str]]) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": ids,
            "n_words": pa.array(n_words, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(i) for i in items], pa.int64()),
            "items_sha256": pa.array([_digest(i) for i in items], pa.string()),
            "contaminated": pa.array([bool(h) for h in n_hit], pa.bool_()),
            "items": pa.array([",".join(sorted(i)) for i in items], pa.string()),
        }
    )


def _report_task(block: Block):
    def run(batches):
        for rows, bounds, hit, items in _hit_chunks(block, batches):
            yield _result(rows.column("doc_id"), np.diff(bounds), count_by_row(hit, bounds), [sorted(items[r]) if r in items else [] for r in range(rows.num_rows)])

    return run


def _keep_task(block: Block):
    def run(batches):
        for rows, bounds, hit, _ in _hit_chunks(block, batches):
            yield rows.filter(pa.array(count_by_row(hit, bounds) == 0))

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()


def blocks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Indexed blocks of the benchmark one after the other, rarity counted over all documents.

    A block holds at most about ``block_bytes`` of text; a single longer item makes it larger."""
    items = _items(benchmark)
    n = _block_count(items, block_bytes)
    for b in range(n):
        block = Block([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "text").collect()], window, shingle)
        if block.owners:
            counts = {m: np.zeros(len(v), np.int64) for m, v in block.vocabulary.items()}
            seen = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_task(block), "n long, k long, count long")
            for m, k, c in seen.groupBy("n", "k").agg(F.sum("count")).collect():
                counts[m][k] = c
            block.index(counts)
            yield block


def _block_count(items: DataFrame, block_bytes: int) -> int:
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    return max(1, -(-int(size) // block_bytes))


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows that agree in the text's two hashes and length have the same hits."""
    text = F.col("text").cast("string")
    return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hit_a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("hit_b"))


def _found_task(block: Block):
    """(hit_a, hit_b, starts and ends of hit words as packed int32, items) of texts with hits."""

    def run(batches):
        for rows, bounds, hit, items in _hit_chunks(block, batches):
            for r in sorted(items):
                own = hit[bounds[r] : bounds[r + 1]]
                edge = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0])).astype("<i4")
                yield pa.record_batch({"hit_a": rows.column("hit_a").slice(r, 1), "hit_b": rows.column("hit_b").slice(r, 1), "spans": pa.array([edge.tobytes()], pa.binary()), "items": pa.array([sorted(items[r])], pa.list_(pa.string()))})

    return run


def _many(documents: DataFrame, found: Iterator[Block]) -> DataFrame:
    """(hit_a, hit_b, spans, items): what all blocks find, one row per text."""
    texts, parts = _keyed(documents).drop("doc_id"), None
    for block in found:
        # a text's row is written once, however many documents share the text
        rows = stored(texts.mapInArrow(_found_task(block), "hit_a long, hit_b long, spans binary, items array<string>").dropDuplicates(["hit_a", "hit_b"]), "hits")
        parts = rows if parts is None else parts.union(rows)
    if parts is None:
        return documents.sparkSession.createDataFrame([], "hit_a long, hit_b long, spans array<binary>, items array<string>")
    return parts.groupBy("hit_a", "hit_b").agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _count_words_task(batches):
    for rows, data, offsets in chunks(batches):
        _, _, bounds = spans(LOWER[data], offsets, NOT_ALNUM)
        yield pa.record_batch([rows.column("doc_id"), rows.column("hit_a"), rows.column("hit_b"), pa.array(np.diff(bounds), pa.int64())], names=["doc_id", "hit_a", "hit_b", "n_words"])


def _sum_task(batches):
    for rows in batches:
        n_words, n_hit = rows.column("n_words").to_pylist(), []
        for n, lists in zip(n_words, rows.column("spans").to_pylist()):
            edges = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in lists or []] or [np.empty((0, 2), np.int32)]).astype(np.int64)
            n_hit.append(int(cover(edges[:, 0], edges[:, 1], n).sum()))
        yield _result(rows.column("doc_id"), n_words, n_hit, [x or [] for x in rows.column("items").to_pylist()])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: words, words hit, items found and their digest."""
    found = blocks(documents, benchmark, window, shingle, block_bytes)
    docs = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    if _block_count(_items(benchmark), block_bytes) == 1:
        block = next(found, None) or _empty(window, shingle)
        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_report_task(block), RESULT)
    counted = _keyed(docs).mapInArrow(_count_words_task, "doc_id long, hit_a long, hit_b long, n_words long")
    joined = counted.join(_many(docs, found), ["hit_a", "hit_b"], "left")
    return joined.select("doc_id", "n_words", "spans", "items").mapInArrow(_sum_task, RESULT)


def _empty(window: int, shingle: int) -> Block:
    block = Block([], window, shingle)
    block.prefixes = {}
    return block


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents in which no benchmark window occurs, with all their columns."""
    found = blocks(documents, benchmark, window, shingle, block_bytes)
    if _block_count(_items(benchmark), block_bytes) == 1:
        block = next(found, None)
        return documents if block is None else documents.withColumn("text", F.col("text").cast("string")).mapInArrow(_keep_task(block), documents.schema)
    text = F.col("text").cast("string")
    gone = _many(documents, found).select(F.col("hit_a").alias("__hit_a"), F.col("hit_b").alias("__hit_b"))
    # a null text has no hits
    same = (F.xxhash64(text) == F.col("__hit_a")) & (F.xxhash64(F.lit(1), text, F.length(text)) == F.col("__hit_b"))
    return documents.join(gone, same, "left_anti")
