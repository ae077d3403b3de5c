"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's words and their beginnings, hashed to ``BUCKETS``.  The machine scores
w0 + sum w_i + sum over pairs <v_i, v_j> of the terms present, so a pair such as an insult and a
group mention can weigh more, or less, than its parts.  Terms take part if a chi-square test on the
labelled rows says so: on all of them, or on those that hold a term chosen so; the second test keeps
terms that matter only beside another.  The whole text of every document is scored.

Training uses at most ``MAX_LABELLED`` labelled texts, those with the lowest hashes of doc_id, out of
the rows that are not held out: crc32(doc_id as text) mod 3 is 1 for those.  They are written once.
Nothing but the text enters a score.

Defined results: null and empty texts are scored (by w0 alone); a null doc_id is hashed as null and
counts as not held out, but is never trained on; a doc_id with several labels is trained on each
distinct one; repeated rows are scored each; without labels of both classes every score is 0.5;
empty tables give no rows; a text may be as long as a task's memory allows; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._store import stored
from opalgrid.llm._text import BASE, BASE_INV, BYTE_CODE, LOWER, NOT_ALNUM, SpanHasher, chunks, rows_of, spans

BUCKETS, FACTORS, MAX_LABELLED, THRESHOLD = 1 << 20, 8, 20_000, 0.7
STARTS = (4, 5, 6)
MIN_CHI2, MIN_DOCS = 20.0, 3
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def term_pairs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct (row * BUCKETS + term) of a chunk."""
    data = LOWER[data]
    starts, ends, bounds = spans(data, offsets, NOT_ALNUM)
    base = rows_of(bounds) * BUCKETS
    hasher = SpanHasher(BYTE_CODE[data], BASE, BASE_INV)
    mask = np.uint64(BUCKETS - 1)
    found = [base + (hasher(starts, ends) & mask).astype(np.int64)]
    for n in STARTS:
        ok = ends - starts > n
        found.append(base[ok] + ((hasher(starts[ok], starts[ok] + n) ^ np.uint64(n)) & mask).astype(np.int64))
    return np.concatenate(found)


def _count_task(beside: np.ndarray | None = None):
    """Labelled texts that hold each term; with ``beside``, of those that hold one of its terms."""

    def run(batches):
        totals = {0: np.zeros(BUCKETS, np.int32), 1: np.zeros(BUCKETS, np.int32)}
        for rows, data, offsets in chunks(batches):
            pairs = np.unique(term_pairs(data, offsets))
            toxic = rows.column("toxic").to_numpy(zero_copy_only=False)
            if beside is not None:
                holds = np.zeros(rows.num_rows, bool)
                holds[(pairs // BUCKETS)[beside[pairs % BUCKETS]]] = True
                toxic = np.where(holds, toxic, -1)
            for label, total in totals.items():
                total += np.bincount(pairs[toxic[pairs // BUCKETS] == label] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        at = np.flatnonzero(totals[0] + totals[1])
        for lo in range(0, len(at), 1 << 16):
            k = at[lo : lo + (1 << 16)]
            yield pa.record_batch({"term": pa.array(k), "clean": pa.array(totals[0][k].astype(np.int64)), "toxic": pa.array(totals[1][k].astype(np.int64))})

    return run


def _terms_task(index: np.ndarray):
    def run(batches):
        for rows, data, offsets in chunks(batches):
            pairs = term_pairs(data, offsets)
            known = index[pairs % BUCKETS]
            pairs = np.unique((pairs // BUCKETS)[known >= 0] * BUCKETS + known[known >= 0])
            cut = np.searchsorted(pairs, np.arange(rows.num_rows + 1) * BUCKETS)
            terms = (pairs % BUCKETS).astype("<i4")
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), pa.array([terms[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["toxic", "terms"])

    return run


class Machine:
    """A second-order factorization machine on sets of terms."""

    def __init__(self, terms: int, factors: int = FACTORS, seed: int = 7):
        random = np.random.default_rng(seed)
        self.bias, self.weights, self.factors = 0.0, np.zeros(terms), random.normal(0, 0.02, (terms, factors))

    def raw(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic function of n rows; (rows, terms) lists what is present."""
        out = self.bias + np.bincount(rows, self.weights[terms], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[terms, f]
            out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return out

    def score(self, rows, terms, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, terms, n), -30, 30)))

    def fit(self, rows, terms, labels, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> Machine:
        n, size = len(labels), len(self.weights)
        share = labels.mean()
        self.bias = float(np.log(share / (1 - share)))
        cost = np.where(labels == 1, np.sqrt((1 - share) / share), 1.0)
        cost /= cost.sum()
        state = [np.zeros(1), np.zeros(size), np.zeros_like(self.factors)]
        mean = [np.zeros(1), np.zeros(size), np.zeros_like(self.factors)]
        for t in range(1, steps + 1):
            error = cost * (self.score(rows, terms, n) - labels)
            e = error[rows]
            slopes = [np.array([error.sum()]), np.bincount(terms, e, size) + decay * self.weights, decay * self.factors]
            for f in range(self.factors.shape[1]):
                v = self.factors[terms, f]
                total = np.bincount(rows, v, n)
                slopes[2][:, f] += np.bincount(terms, e * (total[rows] - v), size)
            moves = []
            for i, g in enumerate(slopes):  # Adam
                mean[i] = 0.9 * mean[i] + 0.1 * g
                state[i] = 0.999 * state[i] + 0.001 * g * g
                moves.append(rate * (mean[i] / (1 - 0.9**t)) / (np.sqrt(state[i] / (1 - 0.999**t)) + 1e-8))
            self.bias -= float(moves[0][0])
            self.weights -= moves[1]
            self.factors -= moves[2]
        return self


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _telling(texts: DataFrame, n0: int, n1: int, beside: np.ndarray | None = None) -> np.ndarray:
    """Terms that a chi-square test finds, out of BUCKETS at most; n0 clean and n1 toxic texts."""
    if not n0 or not n1:
        return np.empty(0, np.int64)
    counts = texts.mapInArrow(_count_task(beside), "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n = float(n0 + n1)
    df, off = F.col("c") + F.col("t"), F.col("t") * F.lit(float(n0)) - F.col("c") * F.lit(float(n1))
    chi2 = n * off * off / (F.lit(float(n0)) * F.lit(float(n1)) * df * (F.lit(n) - df))
    found = counts.where((df >= MIN_DOCS) & (df < n) & (chi2 >= MIN_CHI2)).select("term").collect()
    return np.array(sorted(r.term for r in found), np.int64)


def _labels_task(beside: np.ndarray):
    """The labels of texts that hold one of the terms."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            pairs = term_pairs(data, offsets)
            holds = np.unique((pairs // BUCKETS)[beside[pairs % BUCKETS]])
            yield pa.record_batch([rows.column("toxic").take(pa.array(holds))], names=["toxic"])

    return run


def _classes(rows: DataFrame) -> tuple[int, int]:
    total = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    return total.get(0, 0), total.get(1, 0)


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, factors: int = FACTORS) -> tuple[np.ndarray, Machine] | None:
    """(bucket -> term number or -1, machine), or None without both classes."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    order = (F.xxhash64("doc_id"), "doc_id", "toxic")
    rows = stored(rows.where(~held_out(F.col("doc_id"))).distinct().orderBy(*order).limit(max_labelled), "labelled")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most max_labelled rows of two numbers; rows that agree are trained on once
    texts = texts.join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id", "toxic", "text"])
    texts = stored(texts, "texts")
    if texts.count() > max_labelled:  # unlike texts under one doc_id
        texts = stored(texts.orderBy(*order, F.xxhash64("text")).limit(max_labelled), "texts")
    n0, n1 = _classes(texts)
    if not n0 or not n1:
        return None
    chosen = np.zeros(BUCKETS, bool)
    chosen[_telling(texts, n0, n1)] = True
    if chosen.any():
        chosen[_telling(texts, *_classes(texts.mapInArrow(_labels_task(chosen), "toxic int")), chosen)] = True
    index = np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)
    sets = texts.mapInArrow(_terms_task(index), "toxic int, terms binary").collect()
    labels_ = np.array([r.toxic for r in sets])
    terms = [np.frombuffer(r.terms, "<i4") for r in sets]
    order = sorted(range(len(sets)), key=lambda i: (labels_[i], bytes(sets[i].terms)))  # rows come in any order
    rows_ = np.repeat(np.arange(len(sets)), [len(terms[i]) for i in order])
    flat = np.concatenate([terms[i] for i in order]).astype(np.int64)
    return index, Machine(int(chosen.sum()), factors).fit(rows_, flat, labels_[order])


def _score_task(model):
    def run(batches):
        index, bias, weights, factors = model.value
        machine = Machine(0)
        machine.bias, machine.weights, machine.factors = bias, weights, factors
        for rows, data, offsets in chunks(batches):
            pairs = term_pairs(data, offsets)
            known = index[pairs % BUCKETS]
            ok = known >= 0
            pairs = np.unique((pairs // BUCKETS)[ok] * BUCKETS + known[ok])
            score = machine.score(pairs // BUCKETS, pairs % BUCKETS, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def toxicity(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD, factors: int = FACTORS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of documents; without factors the machine is
    a linear model."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = train(documents, labels, max_labelled, factors)
    if model is None:
        scored = docs.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        index, machine = model
        shared = documents.sparkSession.sparkContext.broadcast((index, machine.bias, machine.weights, machine.factors))
        scored = docs.mapInArrow(_score_task(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
