"""Substring deduplication with prefix-partitioned, depth-limited suffix trees.

Only repeats of at least ``WINDOW`` words matter, so suffixes are cut to that depth and only those
at synchronising places are inserted: each window of ``WINDOW`` words picks the leftmost smallest
hash among its ``SEED``-word prefixes-to-be (its minimiser), so equal windows always meet at equal
seeds, at the same distance from their start.

1. Seeds of all texts are counted.  Seeds that occur once cannot lie in a repeat and go.
2. The suffixes at the remaining seeds are partitioned by prefixes of variable length.  The prefix
   is the seed where that gives a group of at most ``GROUP`` suffixes.  A heavier seed's windows are
   read from the seed on (its words, those to its right, then those to its left), and the prefix
   takes ``STEP`` more of these words until its group fits.  A prefix as long as the window is a
   node by itself: all its windows agree, and partial minima find the first of them.
3. Each group's suffixes (words right of the place, and left of it in reverse) are sorted; runs
   between drops of the longest-common-prefix array below k are the nodes of word depth k of its
   subtree.  A window of d words left and WINDOW - d right of its seed repeats exactly when
   another suffix shares both nodes; its first occurrence by (doc_id, start) stays.
4. Repeated windows return to their document, and the words they cover are removed.

Hashes only choose where suffixes meet.  The suffixes carry their words, and a repeat needs all of
them to agree byte by byte.

Defined results: null and empty texts have no words; a null doc_id sorts after all others, and such
texts among themselves by hash; rows that repeat both doc_id and text are one occurrence, and each
gets its row; texts that share a doc_id are ordered by their hash; empty tables give no rows; a
word or text may be as long as a task's memory allows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._store import bounded, stored
from opalgrid.llm._text import BLANK, WORD_BASE, chunks, count_by_row, cover, exact_ids, flat, gram_hashes, mix64, powers, rows_of, spans, strong_hashes

WINDOW, SEED, GROUP, STEP = 20, 9, 50_000, 4
BATCH = 1 << 14  # suffixes in one Arrow batch
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
# A text's place in the order: rows without a doc_id come last, by their hash.
ORDER = "noid boolean, key long, version long"
PLACE = ("noid", "key", "version")


def _seeds(codes: np.ndarray, bounds: np.ndarray, window: int, seed: int):
    """(windows' first words, their minimisers' first words), windows ascending."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = gram_hashes(codes, seed)
    best, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - seed + 1):
        less = grams[j : j + n] < best
        np.copyto(best, grams[j : j + n], where=less)
        at[less] = j
    row = rows_of(bounds)
    ok = row[:n] == row[window - 1 :]
    starts = np.flatnonzero(ok)
    return starts, starts + at[starts]


def _codes(data, offsets):
    starts, ends, bounds = spans(data, offsets, BLANK)
    return starts, ends, bounds, strong_hashes(data, starts, ends, ~BLANK[data])


def _taken(rows, names, at) -> dict:
    """Columns of rows, at the given rows."""
    return {c: rows.column(c).take(pa.array(at)) for c in names}


def _seed_task(window: int, seed: int):
    def run(batches):
        for rows, data, offsets in chunks(batches):
            _, _, bounds, codes = _codes(data, offsets)
            _, places = _seeds(codes, bounds, window, seed)
            places = np.unique(places)
            if len(places):
                row = rows_of(bounds)[places]
                yield pa.record_batch({"seed": pa.array(gram_hashes(codes, seed)[places].view(np.int64)), **_taken(rows, ("noid", "key"), row), "place": pa.array((places - bounds[row]).astype(np.int32))})

    return run


def _pick(rows, bounds: np.ndarray, column: str) -> np.ndarray:
    """Word numbers in the chunk that the rows' lists of places name."""
    lists = rows.column(column)
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + bounds[row]
    return places[places < bounds[row + 1]]


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Words first[i] .. last[i] - 1 of each i, with a blank after each but the last."""
    raw, a, b = data.tobytes(), starts.tolist(), ends.tolist()
    sizes = np.r_[0, np.cumsum(ends - starts)]
    close = ends[last - 1] - starts[first] == sizes[last] - sizes[first] + last - first - 1
    rows = zip(first.tolist(), last.tolist(), close.tolist())
    return pa.array([raw[a[i] : b[j - 1]] if c else b" ".join([raw[x:y] for x, y in zip(a[i:j], b[i:j])]) for i, j, c in rows], pa.binary())


def _wanted(rows, bounds, n: int, starts: np.ndarray, places: np.ndarray):
    """The windows whose seed is listed."""
    mark = np.zeros(n + 1, bool)
    mark[_pick(rows, bounds, "places")] = True
    ok = mark[places]
    return starts[ok], places[ok]


def _suffix_task(window: int, seed: int):
    """Suffixes at the listed places: the seed, where it lies, which windows it owns, and the words
    that these cover."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            a, b, bounds, codes = _codes(data, offsets)
            starts, places = _wanted(rows, bounds, len(codes), *_seeds(codes, bounds, window, seed))
            if not len(places):
                continue
            head = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
            place, last = places[head], starts[np.r_[head[1:], len(starts)] - 1]
            first, row = starts[head], rows_of(bounds)[place]
            seeds = gram_hashes(codes, seed)[place].view(np.int64)
            for lo in range(0, len(place), BATCH):
                k = slice(lo, lo + BATCH)
                yield pa.record_batch(
                    {
                        "seed": pa.array(seeds[k]),
                        **_taken(rows, PLACE, row[k]),
                        "place": pa.array((place[k] - bounds[row[k]]).astype(np.int32)),
                        "near": pa.array((place[k] - last[k]).astype(np.int32)),
                        "far": pa.array((place[k] - first[k]).astype(np.int32)),
                        "words": _slices(data, a, b, first[k], last[k] + window),
                    }
                )

    return run


def _node_ids(words: np.ndarray):
    """Sorts rows of words; returns the order, ranks' longest common prefixes with their forerunner."""
    order = np.lexsort(words.T[::-1])
    s = words[order]
    same = np.cumprod(s[1:] == s[:-1], axis=1, dtype=np.int8).sum(axis=1)
    return order, np.r_[-1, same] if len(words) else same


def _nodes_at(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """Number of the tree node of that word depth above each suffix."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def _later(node: np.ndarray, noid, key, version, start) -> np.ndarray:
    """Which members of a node another one comes before; repeated rows are one occurrence."""
    order = np.lexsort((version, start, key, noid, node))
    node = node[order]
    fresh = np.r_[True, node[1:] != node[:-1]]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(node)), 0))
    again = np.zeros(len(node), bool)
    for c in (noid, key, version, start):
        c = c[order]
        again |= c != c[first]
    return order[again]


def _matrix(column: pa.Array, far: np.ndarray, near: np.ndarray, window: int, seed: int):
    """Exact word numbers of suffixes: those of the seed, right of it, and left of it in reverse; 0
    where the suffix's own windows do not reach."""
    left = window - seed
    data, offsets = flat(column)
    starts, ends, bounds = spans(data, offsets, BLANK)
    ids = np.r_[exact_ids(data, starts, ends)[0] + 1, 0]
    at = (bounds[:-1] + far)[:, None]  # the seed's first word

    def words(steps, ok):
        return np.where(ok, ids[np.where(ok, at + steps, -1)], 0)

    right = np.arange(seed, window)
    back = -np.arange(1, left + 1)
    return words(np.arange(seed), True), words(right, right < window - near[:, None]), words(back, -back <= far[:, None])


def repeated_windows(seeds: np.ndarray, right: np.ndarray, left: np.ndarray, noid, key, version, place, near, far, window: int):
    """(row, start) of windows whose words also start earlier, within complete seed groups.

    seeds: the words of each seed; right and left: the words after it, and before it in reverse."""
    seed, reach = seeds.shape[1], left.shape[1]
    right_order, right_lcp = _node_ids(np.column_stack([seeds, right]))
    left_order, left_lcp = _node_ids(left)
    rows, starts = [], []
    for d in range(reach + 1):
        owner = np.flatnonzero((near <= d) & (d <= far))
        if len(owner) < 2:
            continue
        a = _nodes_at(right_order, right_lcp, window - d)[owner]
        b = _nodes_at(left_order, left_lcp, d)[owner] if d else np.zeros(len(owner), np.int64)
        start = place[owner] - d
        again = _later(a * (len(seeds) + 1) + b, noid[owner], key[owner], version[owner], start)
        rows.append(owner[again])
        starts.append(start[again])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(starts)


def _columns(table: pa.Table, names) -> list[np.ndarray]:
    return [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]


def _groups(batches, key: str, size: int):
    """Rows come sorted by ``key``; yields tables of whole groups, of about ``size`` rows."""
    held: list = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield table.slice(0, cut).combine_chunks()
                held = table.slice(cut).to_batches()
                n = len(keys) - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tree_task(window: int, seed: int, group: int):
    def run(batches):
        for table in _groups(batches, "seed", group):
            noid, key, version, place, near, far = _columns(table, (*PLACE, "place", "near", "far"))
            parts = _matrix(table.column("words").combine_chunks(), far, near, window, seed)
            rows, starts = repeated_windows(*parts, noid, key, version, place.astype(np.int64), near, far, window)
            yield from _packed(noid[rows], key[rows], version[rows], starts)

    return run


def _packed(noid, key, version, starts):
    """One row per document with its starts as packed int32."""
    if not len(key):
        return
    order = np.lexsort((starts, version, key, noid))
    noid, key, version, starts = noid[order], key[order], version[order], starts[order].astype("<i4")
    head = np.flatnonzero(np.r_[True, (noid[1:] != noid[:-1]) | (key[1:] != key[:-1]) | (version[1:] != version[:-1])])
    tail = np.r_[head[1:], len(key)]
    yield pa.record_batch({"noid": pa.array(noid[head].astype(bool)), "key": pa.array(key[head]), "version": pa.array(version[head]), "starts": pa.array([starts[a:b].tobytes() for a, b in zip(head, tail)], pa.binary())})


def _lengths(window: int, seed: int) -> list[int]:
    """Words of the prefixes after the seed, the window's length last."""
    return [*range(seed + STEP, window, STEP), window]


def _window_task(window: int, seed: int):
    """Windows that belong to the listed (heavy) seeds, read from the seed on, with a hash of each
    prefix."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            a, b, bounds, codes = _codes(data, offsets)
            all_starts, all_places = _wanted(rows, bounds, len(codes), *_seeds(codes, bounds, window, seed))
            first, last, raw, rows_ = a.tolist(), b.tolist(), data.tobytes(), rows_of(bounds)
            for lo in range(0, len(all_starts), BATCH):
                starts, places = all_starts[lo : lo + BATCH], all_places[lo : lo + BATCH]
                row, d, step = rows_[starts], places - starts, np.arange(window)
                # the seed and what follows, then what lies before it, nearest first
                at = places[:, None] + np.where(step < window - d[:, None], step, window - 1 - d[:, None] - step)
                read = pa.array([b" ".join([raw[first[w] : last[w]] for w in words]) for words in at.tolist()], pa.binary())
                found = {"left": pa.array(d.astype(np.int32)), "words": read, **_taken(rows, PLACE, row), "start": pa.array((starts - bounds[row]).astype(np.int32))}
                for n in _lengths(window, seed):
                    sums = (codes[at[:, :n]] * powers(WORD_BASE, n)).sum(axis=1, dtype=np.uint64)
                    found[f"p{n}"] = pa.array(mix64(sums + d.astype(np.uint64)).view(np.int64))
                yield pa.record_batch(found)

    return run


def _leaf_task(window: int, group: int):
    """Windows with equal hashes of a prefix, gathered: those whose words stand earlier too."""

    def run(batches):
        for table in _groups(batches, "prefix", group):
            noid, key, version, start, left = _columns(table, (*PLACE, "start", "left"))
            data, offsets = flat(table.column("words").combine_chunks())
            starts, ends, _ = spans(data, offsets, BLANK)
            words = exact_ids(data, starts, ends)[0].reshape(-1, window)
            order, lcp = _node_ids(np.column_stack([left, words]))
            again = _later(_nodes_at(order, lcp, window + 1), noid, key, version, start.astype(np.int64))
            yield from _packed(noid[again], key[again], version[again], start[again])

    return run


def _remove_task(window: int):
    def run(batches):
        for rows, data, offsets in chunks(batches):
            starts, ends, bounds = spans(data, offsets, BLANK)
            gone = np.zeros(len(starts), bool)
            for r, lists in enumerate(rows.column("repeats").to_pylist()):
                if lists:
                    s = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in lists])).astype(np.int64)
                    n = bounds[r + 1] - bounds[r]
                    gone[bounds[r] : bounds[r + 1]] = cover(s, np.minimum(s + window, n), n)
            # a kept word and one joining blank after it, except after a row's last kept word
            kept = np.flatnonzero(~gone)
            row = rows_of(bounds)[kept]
            raw, shas, texts = data.tobytes(), [], []
            cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
            a, b = starts[kept].tolist(), ends[kept].tolist()
            removed = count_by_row(gone, bounds)
            for r in range(rows.num_rows):
                text = b" ".join(raw[offsets[r] : offsets[r + 1]].split()) if not removed[r] else b" ".join([raw[x:y] for x, y in zip(a[cut[r] : cut[r + 1]], b[cut[r] : cut[r + 1]])])
                shas.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            yield pa.record_batch(
                {
                    "doc_id": rows.column("doc_id"),
                    "n_words": pa.array(np.diff(bounds), pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array(shas, pa.string()),
                    "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                }
            )

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    text, own = F.col("text").cast("string"), F.col("doc_id").cast("long")
    version = F.xxhash64(text)
    return documents.select(own.alias("doc_id"), text.alias("text"), own.isNull().alias("noid"), F.coalesce(own, version).alias("key"), version.alias("version"))


def _repeated_seeds(docs: DataFrame, window: int, seed: int, group: int) -> DataFrame:
    """(noid, key, light, heavy): places of seeds that occur again, in groups that fit a task or not."""
    seeds = docs.select("noid", "key", "text").mapInArrow(_seed_task(window, seed), "seed long, noid boolean, key long, place int")
    # stored, so that the join's sides are plain shuffles, which Spark splits where a seed is hot
    counted = stored(seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    light, heavy = F.when(F.col("n") <= group, F.col("place")), F.when(F.col("n") > group, F.col("place"))
    return seeds.join(counted, "seed").groupBy("noid", "key").agg(F.collect_set(light).alias("light"), F.collect_set(heavy).alias("heavy"))


def _light_repeats(docs: DataFrame, listed: DataFrame, window: int, seed: int, group: int) -> DataFrame:
    suffixes = docs.join(listed, ["noid", "key"]).mapInArrow(_suffix_task(window, seed), f"seed long, {ORDER}, place int, near int, far int, words binary")
    return suffixes.repartition("seed").sortWithinPartitions("seed").mapInArrow(_tree_task(window, seed, group), f"{ORDER}, starts binary")


def _heavy_repeats(docs: DataFrame, listed: DataFrame, window: int, seed: int, group: int) -> DataFrame:
    lengths = _lengths(window, seed)
    prefixes = ", ".join(f"p{n} long" for n in lengths)
    each = docs.join(listed, ["noid", "key"]).mapInArrow(_window_task(window, seed), f"left int, words binary, {ORDER}, start int, {prefixes}")
    left, found = stored(each, "windows"), None
    for n in lengths:
        own = F.col(f"p{n}")
        # at most one prefix in ``group`` windows
        heavy = bounded(stored(left.groupBy(own.alias("over")).agg(F.count("*").alias("n")).where(F.col("n") > group).select("over"), "heavy"))
        marked = left.join(heavy, own == F.col("over"), "left")
        fits = marked.where("over is null").select(own.alias("prefix"), "left", "words", *PLACE, "start")
        trees = fits.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_leaf_task(window, group), f"{ORDER}, starts binary")
        found = trees if found is None else found.union(trees)
        left = marked.where("over is not null").drop("over")
    # whole windows that still stand in more places than a group holds
    order = F.struct(*PLACE, "start")
    firsts = left.groupBy("left", "words").agg(F.min(order).alias("first"))
    again = left.join(firsts, ["left", "words"]).where(order != F.col("first"))
    return found.union(again.select(*PLACE, "start").mapInArrow(_pack_task, f"{ORDER}, starts binary"))


def repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(noid, key, version, starts): words at which repeated windows of a text start, packed as int32."""
    docs = _keyed(documents).drop("doc_id")
    # each step is written before the next, so that its shuffle files can go
    found = stored(_repeated_seeds(docs, window, seed, group), "seeds")
    light = _light_repeats(docs, found.where(F.size("light") > 0).select("noid", "key", F.col("light").alias("places")), window, seed, group)
    heavy = found.where(F.size("heavy") > 0).select("noid", "key", F.col("heavy").alias("places"))
    return stored(light if heavy.isEmpty() else light.union(_heavy_repeats(docs, heavy, window, seed, group)), "repeats")


def _pack_task(batches):
    for b in batches:
        yield from _packed(*(b.column(c).to_numpy(zero_copy_only=False) for c in (*PLACE, "start")))


def remove_repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of each row of documents."""
    found = repeats(documents, window, seed, group)
    lists = found.groupBy(*PLACE).agg(F.collect_list("starts").alias("repeats"))
    joined = _keyed(documents).join(lists, list(PLACE), "left").select("doc_id", "text", "repeats")
    return joined.mapInArrow(_remove_task(window), RESULT + ", kept_text string")
