"""SimHash near-duplicates by tiled exact comparison.

Each text gets a 64-bit fingerprint from its word shingles.  Distinct fingerprints are filed in
tiles by the population counts of their four 16-bit lanes.  Lane counts of fingerprints within a
radius differ by no more than the radius in all, so only tiles that close are compared; tile pairs
beyond are skipped.  A large tile is cut into blocks of ``MIN_BLOCK`` to ``MAX_BLOCK`` fingerprints, the
more the larger the table, so that less of it is sent around; each pair of blocks is one numpy exclusive-or and bit count, complete and exact.  A pair of blocks yields
a spanning forest of its links, never all pairs, and components are found on that.

``near_duplicates`` links fingerprints within a small radius.  ``keep_one`` can ask for a similarity
instead: then the radius is wide, tiles hold texts of one class of sizes (a similarity of s allows
sizes that differ by the factor s at most) and of neighbouring population counts.  An odd sketch (one
parity bit for each bin of shingles) bounds the similarity of the pairs within the radius from above:
what it rules out is surely too far apart.  Of the pairs left, every link of a pair of blocks' spanning
forest (most similar first) is verified by the Jaccard similarity of the two sets of shingles, and up
to ``TRIES`` more of each text where the sketch leaves a doubt.  Where that does not settle every pair,
because there are more or because a link fails that others were left out for, the two blocks are
compared again, knowing all components and failed links so far and with more tries, until each pair
within the radius was verified, was ruled out or lies in one component.  So the components are those of
all links, and a group of m texts has a few m links to verify, not all pairs.  A group that holds much
of a block is compared with its leader first.  The comparisons grow with the square of the number of
different texts of a size class, as the method has it.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of
fewer words than a shingle have one shingle of all words; rows that share a text share a
fingerprint; a null doc_id takes part, and its component is the smallest doc_id that is not null
(null if there is none); empty tables give no rows; a text may be as long as a task's memory allows;
other columns, whatever their names, are not looked at, and ``keep_one`` returns them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._store import drop, stored
from opalgrid.llm._text import chunks, mix64
from opalgrid.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
MIN_BLOCK, MAX_BLOCK = 2048, 1 << 16
# A stage for near-duplicates: words in a shingle, similarity, and the radius that finds them.  Texts
# of similarity 0.8 differ in 9.7 bits of 64 on average; NEAR_RADIUS is a trade between those missed
# and the pairs to verify.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_RADIUS = 5, 0.8, 14
# Bytes of a sketch if no other number is asked for, estimates from which on a link is taken for granted
# until verified (above the similarity), tries in the first round, nodes from which on a group has a leader.
SKETCH, SLACK, TRIES, DENSE = 128, 0.1, 4, 512
BLOCK_BYTES = 16 << 20
LANES, LANE_BITS = 4, 5


def shingle_hashes(texts: list[bytes], shingle: int, seed: int) -> list[list[int]]:
    """XXH64 of the shingles of UTF-8 texts, repeats included."""
    digest, out = xxhash.xxh64_intdigest, []
    for text in texts:
        words = text.lower().split()  # on bytes: A-Z only, and blanks 0x20, 0x09-0x0D
        n = len(words)
        line = b" ".join(words)
        if n <= shingle:
            out.append([digest(line, seed)] if n else [])
            continue
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: n - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(line)]
        out.append([digest(line[a:b], seed) for a, b in zip(starts, ends)])
    return out


def fingerprints_of(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts."""
    return majority(shingle_hashes(texts, shingle, seed))


def majority(lists: list[list[int]]) -> np.ndarray:
    """A bit is 1 if it is set in over half of a list's hashes."""
    counts = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(lists), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
        heads = np.cumsum(counts[full]) - counts[full]
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), heads)
            out[full[2 * ones > counts[full]]] |= np.uint64(1 << bit)
    return out


def sketch_bytes(n: int) -> int:
    """A power of two with a bit for each of n shingles, 32 at least."""
    return max(32, 1 << max(0, n - 1).bit_length() >> 3)


def sketch(hashes: np.ndarray, size: int = SKETCH) -> bytes:
    """Odd sketch of a set: the parity of the number of its hashes in each of 8 * size bins.

    Hashes that two sets share cancel out, so no more bits of their sketches differ than hashes do."""
    bins = (hashes % np.uint64(8 * size)).astype(np.int64)
    return np.packbits(np.bincount(bins, minlength=8 * size).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of one size, which divides theirs."""
    out = np.empty((len(sketches), size), np.uint8)
    for k, x in enumerate(sketches):
        out[k] = np.frombuffer(x, np.uint8) if len(x) == size else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)
    return out


def estimate(a: np.ndarray, b: np.ndarray, total: np.ndarray, similarity: float, step: int = 1 << 16) -> np.ndarray:
    """Estimated similarity of pairs of sets, from rows of sketches and the sum of their sizes; -1 where
    the bits that differ rule ``similarity`` out."""
    out, bits = np.zeros(len(a)), 8 * a.shape[1]
    for lo in range(0, len(a), step):
        x, y = (np.ascontiguousarray(c[lo : lo + step]).view(np.uint64) for c in (a, b))
        off, n = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), total[lo : lo + step]
        apart = np.minimum(n, -bits / 2 * np.log1p(-np.minimum(2 * off / bits, 1 - 1e-9)))
        # sets of n elements in all reach the similarity with (1 - s) / (1 + s) * n unshared ones at most
        out[lo : lo + step] = np.where(off * (1 + similarity) <= n * (1 - similarity) + 1e-6, (n - apart) / np.maximum(1, n + apart), -1.0)
    return out


def _fingerprint_task(shingle: int, seed: int, sets: bool = False):
    """Fingerprints of texts; with ``sets`` also the size and two hashes of the set of shingles."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            lists = shingle_hashes([raw[a:b] for a, b in zip(at, at[1:])], shingle, seed)
            found = {c: rows.column(c) for c in rows.schema.names if c != "text"}
            found["print"] = pa.array(majority(lists).view(np.int64))
            if sets:
                each = [np.unique(np.array(x, np.uint64)) for x in lists]
                found["n"] = pa.array([len(x) for x in each], pa.int64())
                for k, name in enumerate(("set_a", "set_b")):
                    found[name] = pa.array(np.array([mix64(x + np.uint64(k)).sum(dtype=np.uint64) for x in each], np.uint64).view(np.int64))
                found["sketch"] = pa.array([sketch(x, sketch_bytes(len(x))) for x in each], pa.binary())
            yield pa.record_batch(found)

    return run


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprint_task(shingle, seed), "doc_id long, print long")


def _lane_steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of lane counts within the radius, one of each opposite pair."""
    found = [()]
    for _ in range(LANES):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if f >= tuple(-x for x in f)]


def _roots(i: np.ndarray, j: np.ndarray, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component; ``root`` is what is known already."""
    root = np.arange(n) if root is None else root
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, step: int = 1 << 21):
    """Links of a spanning forest over two arrays of fingerprints."""
    nodes = a if same else np.concatenate([a, b])
    left, right = [], []
    rows = max(1, step // max(1, len(b)))
    for lo in range(0, len(a), rows):
        near = np.bitwise_count(a[lo : lo + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += lo
        ok = i < j if same else np.ones(len(i), bool)
        left.append(i[ok])
        right.append(j[ok] + (0 if same else len(a)))
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return nodes[:0], nodes[:0]
    root = _roots(i, j, len(nodes))
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _lists(column) -> tuple[np.ndarray, list[int]]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), [0, *np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()]


def _compare_task(radius: int):
    def run(batches):
        for batch in batches:
            (left, p), (right, q), same = _lists(batch.column("a")), _lists(batch.column("b")), batch.column("same").to_pylist()
            found = []
            for r, own in enumerate(same):
                a = left[p[r] : p[r + 1]]
                b = a if own else right[q[r] : q[r + 1]]
                if own and len(a) == 1 or len(a) * len(b) < 1 << 16 and not (np.bitwise_count(a[:, None] ^ b) <= radius).sum() > own * len(a):
                    continue
                found.append(_forest(a, b, radius, own))
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                yield pa.record_batch({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return run


def _block(rows: DataFrame, block: int | None) -> int:
    """Fingerprints in a block: the square of their number decides the bytes that are sent around."""
    return block or min(MAX_BLOCK, max(MIN_BLOCK, rows.count() // 1024))


def links(prints: DataFrame, radius: int = RADIUS, block: int | None = None) -> DataFrame:
    """(u, v): a spanning set of the links between distinct fingerprints (column print)."""
    block = _block(prints, block)
    lanes = [F.bit_count(F.shiftrightunsigned("print", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(LANES)]
    tile = sum((F.shiftleft(lane.cast("long"), LANE_BITS * k) for k, lane in enumerate(lanes)), F.lit(0).cast("long"))
    filed = prints.select("print", tile.alias("tile"))
    # at most 17**4 tiles whatever the input: small enough to send to every task
    cuts = filed.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("cuts"))
    blocks = filed.join(F.broadcast(cuts), "tile").withColumn("cut", F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int"))
    blocks = stored(blocks.groupBy("tile", "cut").agg(F.collect_list("print").alias("prints")), "tiles")
    cuts = blocks.groupBy("tile").agg((F.max("cut") + 1).alias("cuts"))

    def lane(k: int):
        return F.shiftright("tile", LANE_BITS * k).bitwiseAND(F.lit((1 << LANE_BITS) - 1))

    # lane counts stay within 0..16 where the tile exists, so a sum of lane steps names one tile only
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(s)]) for s in _lane_steps(radius)])
    near = blocks.select("tile", "cut", F.explode(steps).alias("s"))
    fits = [lane(k) + F.col(f"s.d{k}") for k in range(LANES)]
    inside = F.lit(True)
    for f in fits:
        inside = inside & f.between(0, 16)
    other = sum((F.shiftleft(f.cast("long"), LANE_BITS * k) for k, f in enumerate(fits)), F.lit(0).cast("long"))
    pairs = near.where(inside).select("tile", "cut", other.alias("tile2"))
    pairs = pairs.join(F.broadcast(cuts.toDF("tile2", "cuts")), "tile2").select("tile", "cut", "tile2", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut2")).where("tile <> tile2 or cut <= cut2")
    first = blocks.select("tile", "cut", F.col("prints").alias("a"))
    second = blocks.select(F.col("tile").alias("tile2"), F.col("cut").alias("cut2"), F.col("prints").alias("b"))
    same = F.expr("tile = tile2 and cut = cut2")
    both = pairs.join(first, ["tile", "cut"]).join(second, ["tile2", "cut2"]).select(same.alias("same"), "a", F.when(~same, F.col("b")).otherwise(F.array().cast("array<bigint>")).alias("b"))
    return stored(both.mapInArrow(_compare_task(radius), "u long, v long"), "links")


def _filed(prints: DataFrame, order: Column, radius: int, block: int | None) -> DataFrame:
    """(print, least, root) of each distinct fingerprint: the least of its rows in an order, and its
    component."""
    distinct = stored(prints.groupBy("print").agg(F.min(order).alias("least")), "distinct")
    roots = components(links(distinct.select("print"), radius, block))
    return distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, block: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of documents."""
    prints = stored(fingerprints(documents, shingle, seed), "prints")
    filed = _filed(prints, F.col("doc_id"), radius, block)
    ids = filed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = filed.join(ids, "root").select("print", "component_id")
    digits = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return prints.join(named, "print").select("doc_id", digits, "component_id")


def spanning_forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which links (i, j) among n nodes make up a minimum spanning forest, by Boruvka's rounds."""
    order = np.lexsort((j, i, weight))
    i, j, root = i[order], j[order], np.arange(n)
    left, taken = np.arange(len(i)), []
    while True:
        a, b = root[i[left]], root[j[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return order[np.concatenate(taken)] if taken else left
        _, first = np.unique(np.column_stack([a, b]).ravel(), return_index=True)
        chosen = np.unique(first // 2)
        taken.append(left[chosen])
        root = _roots(a[chosen], b[chosen], n, root)


def _near(p, m, x, i, j, radius: int, similarity: float, same: bool, step: int = 1 << 21):
    """Pairs (and their estimates) of nodes i and nodes j that may be similar; same: each pair once."""
    found, few = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 1 << 17
    rows = max(1, step // max(1, len(j)))
    for lo in range(0, len(i), rows):
        u, v = np.nonzero(np.bitwise_count(p[i[lo : lo + rows], None] ^ p[None, j]) <= radius)
        u, v = i[u + lo], j[v]
        ok = (np.minimum(m[u], m[v]) >= similarity * np.maximum(m[u], m[v])) & ((u < v) if same else True)
        u, v = u[ok], v[ok]
        alike = np.concatenate([np.empty(0), *(estimate(x[u[k : k + few]], x[v[k : k + few]], m[u[k : k + few]] + m[v[k : k + few]], similarity) for k in range(0, len(u), few))])
        ok = alike >= 0
        found.append((u[ok], v[ok], alike[ok]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _large_group(p, m, x, radius: int, similarity: float):
    """(links to its leader, members) of a group of near copies with an eighth of the nodes, if one shows
    up among some nodes tried; its members need not be compared with each other."""
    n = len(p)
    if n < DENSE:
        return None
    tried = np.unique(np.linspace(0, n - 1, 32).astype(np.int64))
    reach = [(np.bitwise_count(p ^ p[t]) <= radius).sum() for t in tried]
    leader = tried[int(np.argmax(reach))]
    if max(reach) < n // 8:
        return None
    u, v, alike = _near(p, m, x, np.array([leader]), np.arange(n), radius, similarity, False)
    ok = (alike >= similarity + SLACK) & (u != v)
    return None if ok.sum() < n // 8 else (u[ok], v[ok], alike[ok])


def near_step(p, m, x, cut: int | None, radius: int, similarity: float, known=None, failed=None, tries: int = TRIES):
    """(i, j, must): links to verify over nodes with prints, sizes and sketches: between those before the
    cut and those after it, or all of them without a cut.

    ``known`` is the component of each node by links verified so far, ``failed`` two arrays of links that
    were not similar.  If all links of ``must`` hold, every pair not returned is too far apart, failed or
    within a component; if one does not, another step is due."""
    n = len(p)
    first, second = (np.arange(n),) * 2 if cut is None else (np.arange(cut), np.arange(cut, n))
    inside, parts = np.zeros(n, bool), []
    if known is None:
        own, star = np.arange(n), _large_group(p, m, x, radius, similarity)
        if star is not None:
            parts.append(star)
            inside[star[0][0]] = inside[star[1]] = True
    else:
        _, own, size = np.unique(known, return_inverse=True, return_counts=True)
        inside = own == np.argmax(size) if n >= DENSE and size.max() >= n // 8 else inside
    if inside.any():
        rest = second[~inside[second]]
        parts.append(_near(p, m, x, first[inside[first]], rest, radius, similarity, False))
        others = first[~inside[first]]
        parts.append(_near(p, m, x, others, rest if cut is None else second, radius, similarity, cut is None))
    else:
        parts.append(_near(p, m, x, first, second, radius, similarity, cut is None))
    i, j, alike = (np.concatenate(c) for c in zip(*parts))
    if known is not None:
        low, high = (np.minimum(i, j) * n + np.maximum(i, j), np.minimum(*failed) * n + np.maximum(*failed))
        ok = (own[i] != own[j]) & ~np.isin(low, high)
        i, j, alike = i[ok], j[ok], alike[ok]
    a, b = own[i], own[j]
    kept = spanning_forest(a, b, -alike, n)
    # where the estimate leaves a doubt, the next best links of each component are verified too
    sure = alike >= similarity + SLACK
    root = _roots(a[sure], b[sure], n)
    open_ = np.flatnonzero(root[a] != root[b])
    granted = kept[sure[kept]]
    for end in (a, b):
        order = open_[np.lexsort((-alike[open_], end[open_]))]
        place = end[order]
        kept = np.concatenate([kept, order[np.arange(len(place)) - np.searchsorted(place, place) < tries]])
    kept = np.unique(kept)
    must = np.ones(len(kept), bool) if len(np.setdiff1d(open_, kept)) else np.isin(kept, granted)
    return i[kept], j[kept], must


def near_links(p, m, x, cut: int | None, radius: int, similarity: float):
    """The links of a first ``near_step``: they hold a spanning forest of all that may be similar."""
    return near_step(p, m, x, cut, radius, similarity)[:2]


def _near_task(radius: int, similarity: float, tries: int, again: bool):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                numbers = lambda *names: [row.column(c).flatten().to_numpy(zero_copy_only=False) for c in names]  # noqa: B023, E731
                p, m, nodes, q, n, others = numbers("prints", "sizes", "nodes", "prints2", "sizes2", "nodes2")
                raw, cut = row.column("sketches")[0].as_py(), None
                if not row.column("same")[0].as_py():
                    cut = len(p)
                    p, m, nodes = (np.concatenate(c) for c in ((p, q), (m, n), (nodes, others)))
                    raw = raw + row.column("sketches2")[0].as_py()
                x, known, failed = folded(raw, min(map(len, raw))), None, None
                if again:
                    known, more, u, v = numbers("roots", "roots2", "failed_u", "failed_v")
                    known, order = known if cut is None else np.concatenate([known, more]), np.argsort(nodes)
                    failed = tuple(order[np.searchsorted(nodes, e, sorter=order)] for e in (u, v))
                # bits of signed numbers are counted otherwise
                i, j, must = near_step(p.view(np.uint64), m, x, cut, radius, similarity, known, failed, tries)
                if len(i):
                    u, v = nodes[i], nodes[j]
                    pair = np.full(len(i), row.column("pair")[0].as_py(), np.int64)
                    yield pa.record_batch({"pair": pa.array(pair), "u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v)), "must": pa.array(must)})

    return run


def _set_task(shingle: int, seed: int):
    def run(batches):
        for rows, data, offsets in chunks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            lists = shingle_hashes([raw[a:b] for a, b in zip(at, at[1:])], shingle, seed)
            yield pa.record_batch({"node": rows.column("node"), "shingles": pa.array([np.unique(np.array(x, np.uint64)).tobytes() for x in lists], pa.binary())})

    return run


def _verify_task(similarity: float):
    """Whether each link's two sets reach the similarity."""

    def run(batches):
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (a, b))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                kept.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column("u"), batch.column("v"), pa.array(kept, pa.bool_())], names=["u", "v", "holds"])

    return run


def _near_blocks(nodes: DataFrame, radius: int, similarity: float, block: int | None) -> tuple[DataFrame, DataFrame]:
    """Blocks of nodes (node, print, n, sketch), and the numbered pairs of blocks to compare."""
    block = _block(nodes, block)
    # sizes of one class and the next, counts of one bucket and the next: no closer pair lies elsewhere
    kind = F.when(F.col("n") > 0, F.floor(F.log("n") / F.lit(-np.log(similarity)) + F.lit(1e-9))).otherwise(-9).cast("int")
    filed = nodes.select("*", kind.alias("kind"), (F.bit_count("print") / F.lit(radius + 1)).cast("int").alias("pop"))
    size = F.greatest(F.count("*") / F.lit(block), F.sum(F.octet_length("sketch")) / F.lit(BLOCK_BYTES))
    cuts = filed.groupBy("kind", "pop").agg(F.ceil(size).cast("int").alias("cuts"))
    blocks = filed.join(F.broadcast(cuts), ["kind", "pop"]).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    blocks = blocks.groupBy("kind", "pop", "cut").agg(F.collect_list(F.struct("print", "n", "node", "sketch")).alias("rows"))
    blocks = stored(blocks.select("kind", "pop", "cut", F.col("rows.print").alias("prints"), F.col("rows.n").alias("sizes"), F.col("rows.node").alias("nodes"), F.col("rows.sketch").alias("sketches")), "tiles")
    names = blocks.select("kind", "pop", "cut")
    # a few classes of sizes by at most 65 counts, cut into blocks; each has few neighbours
    other = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    pairs = names.select("*", other.alias("o")).select("kind", "pop", "cut", (F.col("kind") + F.col("o.k")).alias("kind2"), (F.col("pop") + F.col("o.p")).alias("pop2"))
    counts = cuts.toDF("kind2", "pop2", "cuts")
    pairs = pairs.join(F.broadcast(counts), ["kind2", "pop2"]).select("kind", "pop", "cut", "kind2", "pop2", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut2"))
    pairs = pairs.where("kind <> kind2 or pop <> pop2 or cut <= cut2")
    return blocks, stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "block_pairs")


def _compared(blocks: DataFrame, pairs: DataFrame, radius: int, similarity: float, tries: int, roots: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """(pair, u, v, must): links to verify of the pairs of blocks, knowing components and failed links."""
    key, again = ["kind", "pop", "cut"], roots is not None
    second = ["kind2", "pop2", "cut2", "prints2", "sizes2", "nodes2", "sketches2"]
    if again:
        places = blocks.select(*key, F.posexplode("nodes").alias("place", "node")).join(roots, "node", "left")
        places = places.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("root", "node").alias("root")))).alias("r"))
        blocks, second = blocks.join(places.select(*key, F.col("r.root").alias("roots")), key), [*second, "roots2"]
        lists = failed.groupBy("pair").agg(F.collect_list(F.struct("u", "v")).alias("f"))
        pairs = pairs.join(lists.select("pair", F.col("f.u").alias("failed_u"), F.col("f.v").alias("failed_v")), "pair")
    both = pairs.join(blocks, key).join(blocks.toDF(*second), second[:3])
    same = F.expr("kind = kind2 and pop = pop2 and cut = cut2").alias("same")
    columns = ["prints", "sizes", "nodes", "sketches", *second[3:], *(["roots", "failed_u", "failed_v"] if again else [])]
    return stored(both.select("pair", same, *columns).mapInArrow(_near_task(radius, similarity, tries, again), "pair long, u long, v long, must boolean"), "near")


def _similar(keyed: DataFrame, prints: DataFrame, key, order: Column, shingle: int, radius: int, similarity: float, seed: int, block: int | None) -> DataFrame:
    """(print, n, set_a, set_b, least, root) of each distinct set of shingles."""
    alike = ["print", "n", "set_a", "set_b"]
    nodes = prints.groupBy(*alike).agg(F.min(order).alias("least"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    blocks, pairs = _near_blocks(nodes.select("node", "print", "n", "sketch"), radius, similarity, block)

    def verified(pairs: DataFrame) -> DataFrame:
        """(u, v, holds) of the links."""
        ends = pairs.select("u").union(pairs.select("v")).distinct().toDF("node")
        wanted = nodes.join(ends, "node").select("node", *[F.col(f"least.{k}").alias(f"own_{k}") for k in key])
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"own_{k}"))
        # a text that stands for its node; rows that repeat it give the same set
        texts = keyed.join(wanted, same).select("node", "text")
        sets = stored(texts.mapInArrow(_set_task(shingle, seed), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
        first, second = (sets.toDF(x, y) for x, y in (("u", "a"), ("v", "b")))
        links = pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b").mapInArrow(_verify_task(similarity), "u long, v long, holds boolean")
        links = stored(links, "verified")
        drop(sets)
        return links

    links, failed, roots, tries = None, None, None, TRIES
    while True:
        found = _compared(blocks, pairs, radius, similarity, tries, roots, failed)
        judged = verified(stored(found.select("u", "v").distinct(), "pairs"))
        held, lost = judged.where("holds").select("u", "v"), found.join(judged.where("not holds"), ["u", "v"])
        lost = stored(lost.select("pair", "u", "v", "must"), "failed")
        links = held if links is None else links.union(held)
        failed = lost if failed is None else failed.union(lost)
        roots = components(links)
        again = lost.where("must").select("pair").distinct()
        if again.isEmpty():
            break
        pairs, tries = stored(pairs.join(again, "pair"), "block_pairs"), 8 * tries
    drop(blocks)
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, block: int | None = None, similarity: float | None = None) -> DataFrame:
    """One row of each component of near-duplicates: the one with the smallest doc_id (null last),
    among rows of one doc_id the one with the smallest hash of its text, and any one of the rows
    that agree in both.  All columns are kept.  With a similarity, links within the radius count if
    the shingles' Jaccard similarity reaches it."""
    text = F.col("text").cast("string")
    key = {"near_id": F.col("doc_id").cast("long"), "near_a": F.xxhash64(text), "near_b": F.xxhash64(F.lit(1), text, F.length(text))}
    # rows of one key have one text, so one fingerprint: what is decided for a key holds for its rows
    keyed = documents.select(*[c.alias(k) for k, c in key.items()], text.alias("text"))
    alike = ["print"] if similarity is None else ["print", "n", "set_a", "set_b"]
    fields = "near_id long, near_a long, near_b long, " + ", ".join(f"{c} long" for c in alike) + (", sketch binary" if similarity is not None else "")
    prints = stored(keyed.mapInArrow(_fingerprint_task(shingle, seed, similarity is not None), fields), "prints")
    order = F.struct(F.col("near_id").isNull().alias("without_id"), *key)
    filed = _filed(prints, order, radius, block) if similarity is None else _similar(keyed, prints, key, order, shingle, radius, similarity, seed, block)
    first = filed.groupBy("root").agg(F.min("least").alias("first"))
    named = filed.join(first, "root").select(*alike, "first")
    found = stored(prints.join(named, alike).select(*key, order.eqNullSafe(F.col("first")).alias("stays")), "components")
    gone = found.where("not stays").select(*[F.col(k).alias(f"__gone_{k}") for k in key]).distinct()
    marked = documents.select("*", *[c.alias(f"__{k}") for k, c in key.items()])
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"__{k}").eqNullSafe(F.col(f"__gone_{k}"))
    kept = marked.join(gone, same, "left_anti")
    repeated = found.where("stays").groupBy(*key).count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([f"__{k}" for k in key])
    return kept.drop(*[f"__{k}" for k in key])
