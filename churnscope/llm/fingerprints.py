"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word
shingles, ascending; fewer than k means that it holds the whole set.  It
travels as base64 text of little-endian integers.  Sketches of parts merge
into the sketch of the whole, and two sketches estimate resemblance,
containment and the number of distinct shingles.

Defined cases: a null text counts as empty and an empty or all-blank text has
the empty sketch ``""``; two empty sketches resemble each other fully (1.0),
an empty and a non-empty one not at all; equal texts have equal sketches.
Rows are never merged: repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm import text as T

K = 128


# --- sketches as arrays -------------------------------------------------

def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    n = len(hashes)
    if n > 8 * k:  # a threshold that keeps about 3k spares sorting the rest
        low = hashes[hashes < np.uint64(int(2.0**64 * min(1.0, 3 * k / n)))]
        found = np.unique(low)
        if len(found) >= k:
            return found[:k]
    return np.unique(hashes)[:k]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode("ascii")


def decode(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), dtype="<u8")


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """(hashes of both, hashes) among the k smallest of the union."""
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    keep = np.concatenate([[True], ~twice])
    if keep.sum() > k:
        last = both[np.flatnonzero(keep)[k - 1]]
        return int((twice & (both[1:] <= last)).sum()), k
    return int(twice.sum()), int(keep.sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A or B|; exact when both sets fit into k."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, of = _common(a, b, k)
    return both / of


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) * 2.0**64 / (float(sketch[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A| (1.0 for an empty A)."""
    if not len(a):
        return 1.0
    if not len(b):
        return 0.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def sketches_of(texts: list[str], k: int = K) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, hashes, many in T.shingles_of(pa.array(texts, pa.large_string())):
        ends = np.cumsum(many)
        out += [bottom_k(hashes[e - n:e], k) for e, n in zip(ends, many, strict=True)]
    return out


# --- DataFrame operators ------------------------------------------------

def fingerprint(column: Column, k: int = K) -> Column:
    """The fingerprint of a text column."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(s) for s in sketches_of(texts.fillna("").tolist(), k)], dtype=object)
    return run(column.cast("string"))


def _pairwise(estimate):
    def column(a: Column, b: Column, k: int = K) -> Column:
        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([estimate(decode(p), decode(q), k) for p, q in zip(x, y, strict=True)], dtype=float)
        return run(a, b)
    column.__doc__ = f"{estimate.__name__} of two fingerprint columns."
    return column


resemblance_of = _pairwise(resemblance)
containment_of = _pairwise(containment)


def distinct_of(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles of a fingerprint column."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([distinct(decode(p), k) for p in x], dtype=float)
    return run(a)


def merge_fingerprints(df: DataFrame, key: str, fp: str, k: int = K, held: int = 4096) -> DataFrame:
    """One merged fingerprint per key: (key, fingerprint); a null key is a key.

    Each task first merges what it reads, holding at most ``held`` keys, so a
    hot key shuffles a few sketches per task; then sorted partitions are
    merged in a stream with one sketch in memory.
    """
    kind = df.schema[key].dataType
    schema = df.select(F.col(key).alias("key"), F.lit("").alias("fp")).schema
    arrow = {"key": None}

    def rows(keys, fps):
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow["key"]), pa.array(fps, pa.string())], ["key", "fp"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for b in batches:
            arrow["key"] = b.schema.field(0).type
            for x, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x not in own and len(own) >= held:
                    yield rows(list(own), [encode(s) for s in own.values()])
                    own = {}
                own[x] = merged(own[x], decode(f), k) if x in own else decode(f)
        if own:
            yield rows(list(own), [encode(s) for s in own.values()])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, sketch = None, None
        for b in batches:
            arrow["key"] = b.schema.field(0).type
            keys, fps = [], []
            for x, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if sketch is not None and x == key_now:
                    sketch = merged(sketch, decode(f), k)
                else:
                    if sketch is not None:
                        keys.append(key_now)
                        fps.append(encode(sketch))
                    key_now, sketch = x, decode(f)
            if keys:
                yield rows(keys, fps)
        if sketch is not None:
            yield rows([key_now], [encode(sketch)])

    parts = df.select(F.col(key).cast(kind).alias("key"), F.col(fp).alias("fp")).mapInArrow(partial, schema)
    out = parts.repartition("key").sortWithinPartitions("key").mapInArrow(final, schema)
    return out.select(F.col("key").alias(key), F.col("fp").alias("fingerprint"))


# --- fingerprints of texts and of their edited forms -----------------------

EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, distinct_shingles double")


def with_neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to ``parts`` ranges of descending doc_id, each range followed by its next row.

    Range bounds are ids that occur (quantiles), so the first row of the range
    below a bound is known by its id; such rows are also sent, as guests, to
    the range above.  The highest row is the guest of the lowest range.  Texts
    are shuffled once.  Null ids come last in the order.
    """
    probabilities = [i / parts for i in range(1, parts)] + [1.0]
    found = docs.agg(F.percentile_approx("doc_id", probabilities, 10 * parts + 1000).alias("q"),
                     F.max("doc_id").alias("top")).first()
    top = found["top"]
    bounds = np.array(sorted({*(found["q"] or []), *([] if top is None else [top])}), dtype=np.int64)

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy().astype(np.int64)
        own = np.where(known, np.searchsorted(bounds, values), 0)
        head = known & (bounds[np.minimum(own, len(bounds) - 1)] == values) if len(bounds) else known & False
        above = (own + 1) % max(1, len(bounds))
        return pd.Series([[o, a] if h else [o] for o, a, h in zip(own, above, head, strict=True)])

    return (docs.select("doc_id", "text", F.posexplode(ranges("doc_id")).alias("guest", "range"))
            .repartitionById(max(1, len(bounds)), F.col("range"))
            .sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()))


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form (``EDITED``).

    The edited form replaces the last floor(n/2) code points by the first as
    many (or all) of the next document in descending ``doc_id`` (after the
    last: the first; equal ids in order of text).  A single document is its
    own next.  Columns other than doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def results(ids, texts, prints, edited_next, next_prints):
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, edited_next, strict=True)]
        changed = sketches_of(edited, k)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([encode(p) for p in prints], pa.string()),
            pa.array([encode(p) for p in changed], pa.string()),
            pa.array([resemblance(p, c, k) for p, c in zip(prints, changed, strict=True)], pa.float64()),
            pa.array([resemblance(p, q, k) for p, q in zip(prints, next_prints, strict=True)], pa.float64()),
            pa.array([distinct(p, k) for p in prints], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            "near_edited", "near_next", "distinct_shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # the row that waits for its next one
        done = False
        for b in batches:
            if done:
                continue
            column = T.as_strings(b.column(1))
            for at, part in T.slices(column):
                if done:
                    break
                ids = b.column(0).slice(at, len(part)).to_pylist()
                guests = b.column(2).slice(at, len(part)).to_pylist()
                own = sum(g == 0 for g in guests)
                use = min(len(part), own + 1)  # of the guests only the first is a next row
                done = own < len(part)
                texts = part.slice(0, use).to_pylist()
                prints = sketches_of(texts, k)
                ids = ids[:use]
                if first is None and own:
                    first = (ids[0], texts[0], prints[0])
                if last is not None:
                    ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
                if len(ids) > 1:
                    yield results(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                last = None if done else (ids[-1], texts[-1], prints[-1])
        if last is not None:  # no guest came: no id is known, and one range holds all
            yield results([last[0]], [last[1]], [last[2]], [first[1]], [first[2]])

    return with_neighbours(docs, parts).select("doc_id", "text", "guest").mapInArrow(run, EDITED)
