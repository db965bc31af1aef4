"""Vectorised byte kernels over Arrow string columns.

The kernels work on the UTF-8 bytes of a column slice at once: words are runs
of bytes outside ``\\x20 \\x09-\\x0D``, A-Z is lower-cased, and a word's 64-bit
hash is a polynomial in its bytes modulo 2^64, finished with a mixer.  Null
texts count as empty.  A single text longer than the slice limit is processed
whole, so memory is bounded by the longest text plus ``CHUNK`` bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Bytes that a scorer looks at together; its arrays take a hundred times as many.
SCORED = 1 << 18
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.array([(0xD6E8FEB86659FD93 * (2 * j + 1) ** 5 | 1) % (1 << 64) for j in range(64)], dtype=_U)

_SHORT = np.arange(64, dtype=_U) * _U(0x8CB92BA72F3D8DD7)

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving what it freed back to the system at its end.

    Python workers live on between tasks and stages, and their C library and
    Arrow's pool keep freed memory, which then adds to that of later stages.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:  # also where no more rows are asked for
            release()

    return task


def scorer(scores: Callable[[pa.Array], np.ndarray]) -> Callable:
    """``scores`` (of an Arrow array of texts) as a function of a text column, ``tidy`` too.

    Batches stay in Arrow's buffers: as Python strings each would be held two more times.
    """
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda own: (pa.array(scores(b)) for b in own))(batches)

    return run


def release() -> None:
    for kind, have in _powers.items():
        _powers[kind] = have[:CHUNK].copy() if len(have) > CHUNK else have
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so equal inputs and only those stay equal."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A number for each byte, and the same with A-Z lower-cased.
BYTES = mix(np.arange(1, 257, dtype=_U) * _BASE)
_BYTE = BYTES[LOWER]

_powers = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}


def power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2^64."""
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else _BASE_INV
        have = np.full(max(n, CHUNK), base, dtype=_U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def as_strings(column: pa.Array) -> pa.Array:
    """The column as non-null large strings starting at offset 0 of its own buffers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a non-null large-string array; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets) or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return flat, offsets - offsets[0]


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Row ranges of about ``limit`` bytes, as (first row, slice)."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def word_spans(flat: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text); words are runs of bytes that are no ``separator``."""
    n = len(flat)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, dtype=np.int64)
    word = ~separator[flat]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    total = np.zeros(len(flat) + 1, dtype=_U)
    np.cumsum(_BYTE[flat] * power("up", len(flat)), out=total[1:])
    h = (total[ends] - total[starts]) * power("down", len(flat))[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shingles per text) of all ``width``-word shingles in text order.

    A text of fewer words gives its whole sequence as one shingle, and none
    when it has no words.
    """
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    base = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(base[-1], dtype=_U)
    if len(words) >= width:
        rolling = np.zeros(len(words) - width + 1, dtype=_U)
        for j in range(width):
            rolling += words[j:len(words) - width + 1 + j] * _STEP[j]
        long = counts >= width
        mask = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(mask, first[long], 1)
        np.add.at(mask, (first + many)[long], -1)
        keep = np.cumsum(mask)[:len(rolling)] > 0
        place = np.zeros(base[-1] + 1, dtype=np.int64)
        np.add.at(place, base[:-1][long], 1)
        np.add.at(place, base[1:][long], -1)
        out[np.cumsum(place)[:-1] > 0] = rolling[keep]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[i]:first[i] + counts[i]]
        out[base[i]:base[i] + 1] = (own * _STEP[:len(own)]).sum(dtype=_U, keepdims=True) + _SHORT[len(own)]
    return mix(out), many


def shingles_of(column: pa.Array, width: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of the column: (first row, shingle hashes, shingles per text)."""
    for at, part in slices(as_strings(column)):
        flat, offsets = raw(part)
        starts, ends, counts = word_spans(flat, offsets)
        hashes, many = shingle_hashes(word_hashes(flat, starts, ends), counts, width)
        yield at, hashes, many


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(key) >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)
