"""Toxicity by non-negative positive-unlabelled learning.

Texts are seen as sets of hashed five-byte windows (A-Z lower-cased, white
space as one kind).  Windows that confirmed toxic texts hold more often than
the rest become features; "the rest" is the unlabelled distribution less its
share of toxic texts.  A linear classifier is trained in numpy with the
class-prior-corrected risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

where P are confirmed toxic texts and U unlabelled ones.  Only the labels
``toxic = 1`` of the training fold act as examples; the prior is the share of
toxic rows among that fold's labels.

Fitting reads a bounded sample: at most ``MAX_POSITIVE`` and
``MAX_UNLABELLED`` ids of the training fold, those first in hash order, with one
text each (the smallest, where an id repeats).  Every whole text is scored.

Defined cases: null and empty texts have no feature and get the score of the
bias; without a confirmed example every score is the prior (0.0 without
labels); labels that repeat a doc_id count once, as toxic if any row says so;
null labels and null ids teach nothing, and a null doc_id is not held out;
repeated documents are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm import text as T
from churnscope.session import checkpoint_dir

MAX_POSITIVE, MAX_UNLABELLED = 6_000, 18_000
FEATURES, BITS, WINDOW = 1_024, 20, 5
#: a feature's least log odds against chance (there are a million windows), and its least ratio of shares
GAIN, RATIO = 3, 3
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def windows(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash bucket, row) of every five-byte window that lies in one text, edges padded by a space."""
    flat, offsets = T.raw(part)
    n = len(offsets) - 1
    # one space before each text and WINDOW - 1 after: short texts have windows too
    length = np.diff(offsets) + WINDOW
    at = np.concatenate([[0], np.cumsum(length)])
    padded = np.full(at[-1], 0x20, dtype=np.uint8)
    row = np.repeat(np.arange(n), length)
    inside = np.arange(len(flat)) + np.repeat(np.arange(n) * WINDOW + 1, np.diff(offsets))
    padded[inside] = np.where(T.SEPARATOR, 0x20, T.LOWER)[flat]
    if len(padded) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    wide = padded.astype(np.uint64)
    value = np.zeros(len(wide) - WINDOW + 1, dtype=np.uint64)
    for j in range(WINDOW):
        value |= wide[j:len(value) + j] << np.uint64(8 * j)
    bucket = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    keep = row[:len(value)] == row[WINDOW - 1:]
    return bucket[keep].astype(np.int64), row[:len(value)][keep]


def present(part: pa.Array, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the texts; ``slot`` maps buckets to features, -1 to none."""
    bucket, row = windows(part)
    feature = slot[bucket]
    hit = np.flatnonzero(feature >= 0)
    pairs = np.unique(row[hit].astype(np.int64) * len(slot) + feature[hit])
    return pairs // len(slot), pairs % len(slot)


class Model:
    """A linear score over window features; small enough for a closure (about 2 MB)."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def slots(self) -> np.ndarray:
        slot = np.full(1 << BITS, -1, dtype=np.int16)
        slot[self.buckets] = np.arange(len(self.buckets))
        return slot

    def scores(self, column: pa.Array) -> np.ndarray:
        out, slot = np.empty(len(column)), self.slots()
        for at, part in T.slices(T.as_strings(column), T.SCORED):
            row, feature = present(part, slot)
            out[at:at + len(part)] = self.bias + np.bincount(row, self.weights[feature], len(part))
        return sigmoid(out)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -50, 50)))


def nn_pu(row: np.ndarray, feature: np.ndarray, positive: np.ndarray, prior: float, width: int,
          steps: int = 500, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over sparse 0/1 rows, by Adam."""
    n = len(positive)
    in_p, in_u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        f = theta[-1] + np.bincount(row, theta[feature], n)
        p = sigmoid(f)
        soft = np.logaddexp(0, f)  # loss of label 0; its slope is p, and p - 1 that of label 1
        negative = (in_u * soft).sum() - prior * (in_p * soft).sum()
        slope = in_u * p - prior * in_p * p
        g = prior * in_p * (p - 1) + slope if negative >= 0 else -slope
        gradient = np.append(np.bincount(feature, g[row], width), g.sum())
        gradient[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """The bounded sample (doc_id, text, positive) of the training fold, and the prior."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    in_hash_order = F.xxhash64(F.lit("toxicity"), "doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    positives = known.filter("toxic = 1").select("doc_id").orderBy(in_hash_order, "doc_id").limit(MAX_POSITIVE)
    # the unlabelled sample stands for all documents, so confirmed ones are not taken out of it
    unlabelled = ids.distinct().orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id"), "doc_id").limit(MAX_UNLABELLED)
    picked = positives.withColumn("positive", F.lit(True)).union(unlabelled.withColumn("positive", F.lit(False)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most MAX_POSITIVE + MAX_UNLABELLED ids, and one text of each
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select(
        "doc_id", "text", "positive"), prior


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample, prior = examples(docs, labels)
    checkpoint_dir(docs.sparkSession)
    sample = sample.checkpoint(eager=True)
    nothing = Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(max(prior, 1e-9) / (1 - min(prior, 1 - 1e-9)))))
    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return nothing
    prior = min(max(prior, 1e-4), 0.9)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            positive = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, part in T.slices(T.as_strings(b.column(0))):
                bucket, row = windows(part)
                pairs = np.unique((row.astype(np.int64) << BITS) | bucket)
                kind = positive[at:at + len(part)][pairs >> BITS]
                for k in (0, 1):
                    total[k] += np.bincount(pairs[kind == k] & ((1 << BITS) - 1), minlength=1 << BITS)
        used = np.flatnonzero(total.any(axis=0))
        for at in range(0, len(used), 50_000):
            u = used[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(total[1, u]), pa.array(total[0, u])],
                                             ["bucket", "p", "u"])

    # the unlabelled share of a window is prior * share + (1 - prior) * rest
    share = (F.col("p") + 0.5) / (n[True] + 1)
    rest = F.greatest((F.col("u") / n[False] - prior * F.col("p") / n[True]) / (1 - prior), F.lit(0.0)) + 1.0 / n[False]
    by_chance = n[True] * (F.col("u") + 1) / n[False]
    gain = F.col("p") * F.log(F.col("p") / by_chance) - (F.col("p") - by_chance)  # log odds against chance
    chosen = (sample.select("text", "positive").mapInArrow(T.tidy(count), "bucket long, p long, u long")
              .groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
              .filter((F.col("p") > by_chance) & (share > RATIO * rest)).withColumn("gain", gain).filter(F.col("gain") > GAIN)
              .orderBy(F.desc("gain"), "bucket").limit(FEATURES).collect())
    if not chosen:
        return nothing
    buckets = np.array([r["bucket"] for r in chosen], dtype=np.int64)
    model = Model(buckets, np.zeros(len(buckets)), 0.0)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = model.slots()
        for b in batches:
            for at, part in T.slices(T.as_strings(b.column(0))):
                row, feature = present(part, slot)
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int64()))],
                    ["positive", "features"])

    rows = sample.select("text", "positive").mapInArrow(T.tidy(sparse), "positive boolean, features array<long>").collect()
    feature = np.concatenate([np.asarray(r["features"], dtype=np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["features"]) for r in rows])
    weights, bias = nn_pu(row, feature, np.array([r["positive"] for r in rows]), prior, len(buckets))
    return Model(buckets, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every document with the column score (other columns kept)."""
    return docs.withColumn("score", T.scorer(model.scores)(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
