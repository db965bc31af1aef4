"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (``NAMES``) are computed in numpy from its bytes.
The trees are grown in numpy on histograms of quantile bins with the logistic
loss, all to the same depth, and flattened into arrays (feature, threshold and
leaf value by tree and node), so that scoring walks all rows down all trees
one level at a time.

Fitting reads a bounded sample: at most ``MAX_TRAIN`` labelled ids of the
training fold, those first in hash order, with one text each (the smallest,
where an id repeats).  Every whole text is scored.

Defined cases: null and empty texts have all statistics 0; without labels
every score is 0.5, with one class only that class's share, smoothed; labels
that repeat a doc_id count once, as good if any row says so; null labels and
null ids teach nothing, and a null doc_id is not held out; repeated documents
are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import text as T
from churnscope.llm.toxicity import held_out, sigmoid

MAX_TRAIN = 20_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
TREES, DEPTH, RATE, BINS, L2, MIN_ROWS = 80, 4, 0.2, 64, 1.0, 5

NAMES = ("bytes", "words", "lines", "word_length", "long_words", "upper", "digits", "punctuation", "symbols", "beyond_ascii",
         "space", "distinct_words", "top_word", "distinct_shingles", "distinct_lines", "line_words", "upper_words",
         "symbol_words", "exclaimed_words")

_CLASS = {name: np.isin(np.arange(256), values) for name, values in {
    "upper": range(65, 91), "digits": range(48, 58), "punctuation": list(b".,;:!?'\"()-"),
    "symbols": list(b"#$%&*|@^~=+<>[]{}\\/_`"), "beyond_ascii": range(128, 256), "letters": [*range(65, 91), *range(97, 123)],
    "line": [10]}.items()}


def _distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct keys, and the count of its commonest key."""
    n = len(counts)
    row = np.repeat(np.arange(n, dtype=np.uint64), counts)
    both = np.sort((row << np.uint64(40)) | (keys >> np.uint64(24)))
    if not len(both):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    run = np.diff(np.append(first, len(both)))
    of = (both[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, run)
    return np.bincount(of, minlength=n).astype(float), most


def statistics(part: pa.Array) -> np.ndarray:
    """Rows of ``NAMES`` for a slice of non-null texts."""
    flat, offsets = T.raw(part)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, counts = T.word_spans(flat, offsets)
    total = {name: np.concatenate([[0], np.cumsum(mask[flat], dtype=np.int64)]) for name, mask in _CLASS.items()}
    of = {name: np.diff(c[offsets]).astype(float) for name, c in total.items()}
    inside = {name: total[name][ends] - total[name][starts] for name in ("upper", "symbols", "letters")}
    last = np.concatenate([[0], np.cumsum(counts)])
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[last]).astype(float)
    length = ends - starts
    words = T.word_hashes(flat, starts, ends)
    shingles, many = T.shingle_hashes(words, counts)
    different, top = _distinct(words, counts)
    # lines: hash of the line's words, one per line with words
    line = total["line"][starts]
    text_of = np.repeat(np.arange(n), counts)
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (text_of[1:] != text_of[:-1])]) if len(line) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    order = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words)))) if len(words) else np.zeros(0, int)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(words + order.astype(np.uint64)), dtype=np.uint64)])
    line_hash = T.mix(np.diff(sums[np.append(begin, len(words))])) if len(words) else np.zeros(0, np.uint64)
    lines = np.bincount(text_of[begin], minlength=n)
    d = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
    return np.column_stack([
        np.log1p(size), np.log1p(counts), np.log1p(lines), d(per_text(length), counts), d(per_text(length > 20), counts),
        d(of["upper"], of["letters"]), d(of["digits"], size), d(of["punctuation"], size), d(of["symbols"], size),
        d(of["beyond_ascii"], size), 1 - d(per_text(length), size) - (size == 0), d(different, counts), d(top, counts),
        d(_distinct(shingles, many)[0], many), d(_distinct(line_hash, lines)[0], lines), d(counts, lines),
        d(per_text((inside["upper"] == inside["letters"]) & (inside["letters"] > 1)), counts),
        d(per_text(inside["symbols"] > 0), counts),
        d(per_text(flat[ends - 1] == 33) if len(ends) else np.zeros(n), counts)])


class Trees:
    """Boosted trees of one depth as arrays; values beyond the last level are leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for at, part in T.slices(T.as_strings(column), T.SCORED):
            out[at:at + len(part)] = sigmoid(self.margin(statistics(part)))
        return out


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Histogram gradient boosting with the logistic loss on rows x, labels y (0/1)."""
    n, width = x.shape if len(x) else (0, len(NAMES))
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    none = Trees(np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), base)
    if n < 2 * MIN_ROWS or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    key = binned + np.arange(width) * BINS
    f, rows = np.full(n, base), np.arange(n)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = sigmoid(f)
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        bin_at = np.full(2**DEPTH - 1, BINS)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            low, many = 2**level - 1, 2**level
            cell = ((node - low)[:, None] * (width * BINS) + key).ravel()
            size = many * width * BINS
            hist = [np.bincount(cell, np.repeat(w, width), size).reshape(many, width, BINS) for w in (g, h, np.ones(n))]
            left = [np.cumsum(s, axis=2) for s in hist]
            whole = [s[:, :, -1:] for s in left]
            gain = (left[0]**2 / (left[1] + L2) + (whole[0] - left[0])**2 / (whole[1] - left[1] + L2)
                    - whole[0]**2 / (whole[1] + L2))
            gain[(left[2] < MIN_ROWS) | (whole[2] - left[2] < MIN_ROWS)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[low + k], threshold[low + k], bin_at[low + k] = j, cuts[j][b], b
            node = 2 * node + 1 + (binned[rows, feature[node]] > bin_at[node])
        at = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + L2)
        f = f + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    ).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    picked = known.join(here, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(MAX_TRAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in T.slices(T.as_strings(b.column(0))):
                x = statistics(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(at, len(part)), pa.ListArray.from_arrays(
                        pa.array(np.arange(len(part) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["y", "x"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(picked), "doc_id")  # at most MAX_TRAIN ids, and one text of each
            .groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality").mapInArrow(T.tidy(run), "y int, x array<double>").collect())
    if not rows:
        return grow(np.zeros((0, len(NAMES))), np.zeros(0))
    # the order of rows must not matter: sums differ in their last digits
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] == 1 for r in rows], dtype=float)
    order = np.lexsort(np.column_stack([x, y]).T)
    return grow(x[order], y[order])


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """Every document with the column score (other columns kept)."""
    return docs.withColumn("score", T.scorer(trees.scores)(F.col("text").cast("string")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    trees = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, trees).select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
