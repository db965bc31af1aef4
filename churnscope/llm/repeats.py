"""Suffix-array dedup: bytes covered by strings of ``WIDTH`` bytes that start elsewhere too.

The search is a run-length index in the manner of the r-index: the
Burrows-Wheeler transform of a piece of the corpus is kept as its runs, with
the suffix-array samples of the run ends and, at each border of two runs, the
length of the match between the two suffixes that meet there.  Of a suffix
inside a run the match with its neighbour is one byte shorter than that of the
text position before it, so the matching statistics of the whole piece against
the rest of itself stream from the samples alone: the match from position p
reaches as far as the furthest one that a sample at or before p reaches.
Where that is ``WIDTH`` bytes or more, the string at p is a repeat.

Such an index serves a bounded piece, so equal strings must first be brought
together, and no two pieces need then be compared.  The minimum of the hashes
of all ``LEVELS[0]``-byte grams in a window of ``WIDTH`` bytes depends only on
the window's bytes.  Each text is cut into runs of window starts with the same
minimum, and a run with its last window's bytes is a segment; equal windows lie
in segments of the same minimum.  Minima found once are dropped.  Equal
segments count together before anything gathers them, and the bytes of each are
fetched once, from one of the texts that have it; the index holds a segment
that occurs more than once as two copies.  Segments are dealt by minimum to
indexes of about ``CHUNK`` bytes.  Where the segments of one minimum have more
than ``MOST`` bytes, as around a passage in countless documents, each is first
laid against one of them: the gram that has the minimum aligns the two, and
windows within the bytes that they share around it are repeats.  Windows beyond
those bytes equal none that was found so, so only the ends that stick out go on;
they are cut in the same way again by longer grams, up to the window itself,
where all that share a minimum are equal.

Everything is keyed by content, as two 64-bit hashes of a text, and marks of a
segment come back to all its places by a join, so exact copies are never
gathered.  A text is one row; memory grows with the longest text, and
otherwise with ``CHUNK`` and ``MOST``.

Defined cases: a null text is empty; texts under ``WIDTH`` bytes keep all;
rows of an equal doc_id, also equal rows, count each as a document; null ids
stay; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc  # a worker need not have it loaded otherwise
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.frames import kept, with_ids
from churnscope.llm.text import BYTES, mix, power, raw, slices, tidy

WIDTH = 400
#: Bytes of the grams whose minimum deals out the segments: the first, and those for what is too large.
LEVELS = (32, 200, 392, WIDTH)
#: Bytes of an index, and the most that the segments of one minimum bring to it.
CHUNK, MOST = 1 << 19, 1 << 20
#: Symbols that the first sort takes at once: 7 of 9 bits.
FIRST = 7

_U = np.uint64
RANGES = "array<struct<lo:int,hi:int>>"
SEGMENTS = ("a long, b long, n long, keys array<long>, prints array<long>, own array<boolean>, "
            "places array<array<struct<start:int,many:int>>>")


class RunIndex:
    """Run-length index of a sequence of symbols 0 to 256, in which 0 parts the strings."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self._ranks: list[tuple[int, np.ndarray]] = []
        order = self._sorted()
        bwt = np.full(len(order), 257, dtype=np.int16)
        bwt[order > 0] = symbols[order[order > 0] - 1]
        border = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        #: the transform: each run's symbol and length
        self.heads = bwt[np.concatenate([[0], border])] if len(bwt) else bwt
        self.lengths = np.diff(np.concatenate([[0], border, [len(bwt)]]))
        #: suffix-array samples: where runs begin, where the runs before them end, and the match of the two
        self.begins, self.ends = order[border], order[border - 1]
        self.matches = self._match(self.begins, self.ends)
        self._ranks = []

    def _sorted(self) -> np.ndarray:
        """The suffix array, by doubling; each round sorts only what is not yet told apart."""
        n = len(self.symbols)
        key = np.zeros(n, dtype=np.int64)
        padded = np.concatenate([self.symbols.astype(np.int64) + 1, np.zeros(FIRST, dtype=np.int64)])  # the end sorts first
        for j in range(FIRST):
            key = (key << 9) | padded[j:j + n]
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[:n]
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, dtype=np.int32)
        rank[order] = place
        width = FIRST
        while True:
            self._ranks.append((width, rank))
            single = np.concatenate([new[1:], [True]])[:n] & new
            if single.all():
                return order
            rows = order[~single]  # in order of rank
            after = rows + width
            then = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0).astype(np.int64)
            key = rank[rows].astype(np.int64) << 32 | then
            by = np.argsort(key)
            rows, key = rows[by], key[by]
            group = key >> 32
            at = np.arange(len(rows))
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), at, 0))
            rank = rank.copy()
            rank[rows] = group + np.maximum.accumulate(np.where(fresh, at, 0)) - begin
            order[~single] = rows
            new[~single] = fresh
            width *= 2

    def _match(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at x and y have in common, by the ranks of each round."""
        n, length = len(self.symbols), np.zeros(len(x), dtype=np.int64)
        for width, rank in reversed(self._ranks):
            i, j = x + length, y + length
            inside = (i < n) & (j < n)
            length += width * (inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]))
        for _ in range(FIRST):
            i, j = x + length, y + length
            inside = (i < n) & (j < n)
            length += inside & (self.symbols[np.minimum(i, n - 1)] == self.symbols[np.minimum(j, n - 1)])
        return length

    def statistics(self) -> np.ndarray:
        """For every position the length of the longest match that begins there and anywhere else."""
        reach = np.zeros(len(self.symbols), dtype=np.int64)
        np.maximum.at(reach, self.begins, self.begins + self.matches)
        np.maximum.at(reach, self.ends, self.ends + self.matches)
        at = np.arange(len(reach))
        return np.maximum(np.maximum.accumulate(reach), at) - at


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row, from running minima of blocks."""
    n = len(values)
    if width == 1 or n < width:
        return values[:max(0, n - width + 1)]
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    full[:n] = values
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def segments(flat: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """(minimum, print, start, window starts, has its minimum twice, segments per text) of the texts' segments.

    Starts count from the text's begin.  The print hashes the segment's bytes.
    """
    n, width = len(flat), WIDTH - gram + 1
    none = np.zeros(0, dtype=np.int64)
    first, last = offsets[:-1], offsets[1:] - WIDTH  # window starts of each text
    if n < WIDTH or not (last >= first).any():
        return none, none, none, none, none.astype(bool), np.zeros(len(first), dtype=np.int64)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(BYTES[flat] * power("up", n), out=total[1:])
    back = power("down", n)
    h = mix((total[gram:] - total[:n - gram + 1]) * back[:n - gram + 1])
    low = _least(h, width)
    edge = np.zeros(n + 1, dtype=np.int32)
    some = last >= first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some] + 1, -1)
    valid = np.cumsum(edge)[:len(low)] > 0
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    new[first[some]] = True
    start = np.flatnonzero(new)
    text = np.searchsorted(offsets, start, "right") - 1
    until = np.minimum(np.append(start[1:], n), last[text] + 1)
    many, key = until - start, low[start]
    # grams that are the minimum of a window: those below all windows around them
    most = ~_least(np.concatenate([np.full(width - 1, ~_U(0)), ~np.where(valid, low, _U(0)), np.full(len(h) - len(low), ~_U(0))]), width)
    least = np.flatnonzero(most == h)
    one, end = np.searchsorted(least, start), np.searchsorted(least, until + width - 1)
    times, value = np.zeros(len(start), dtype=np.int64), h[least]
    open_ = np.flatnonzero(many <= width)
    for step in range(int((end - one)[open_].max(initial=0))):
        open_ = open_[one[open_] + step < end[open_]]
        times[open_] += value[one[open_] + step] == key[open_]
    final = start + (WIDTH if gram == WIDTH else WIDTH - 1 + many)
    prints = mix((total[final] - total[start]) * back[start] + (final - start).astype(_U) * _U(0xA24BAED4963EE407))
    return (key.view(np.int64), prints.view(np.int64), start - first[text], many, (many > width) | (times > 1),
            np.bincount(text, minlength=len(first)))


def _cut(gram: int):
    """Segments of texts (a, b, n, body), as arrays a text; equal texts of a batch are one, and so are
    equal segments of a text, which have all their places (start, window starts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            order = np.lexsort((b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[:len(order)]
            first = order[new]
            many = np.bincount(np.cumsum(new) - 1, n[order], minlength=len(first)).astype(np.int64)
            batch = pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(many), batch.column(3).take(pa.array(first))],
                                               ["a", "b", "n", "body"])
            for at, part in slices(batch.column(3).cast(pa.large_binary())):
                keys, prints, start, many, own, each = segments(*raw(part), gram)
                text = np.repeat(np.arange(len(part)), each)
                order = np.lexsort((start, prints, keys, text))
                keys, prints, start, many, own, text = (x[order] for x in (keys, prints, start, many, own, text))
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
                first = np.flatnonzero(new)
                place = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32))], ["start", "many"])
                inner = pa.array(np.append(first, len(keys)).astype(np.int32))
                bounds = pa.array(np.searchsorted(text[first], np.arange(len(part) + 1)).astype(np.int32))
                rows = [pa.ListArray.from_arrays(bounds, x) for x in (
                    pa.array(keys[first]), pa.array(prints[first]), pa.array(own[first]), pa.ListArray.from_arrays(inner, place))]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, len(part)) for i in range(3)] + rows,
                                                 ["a", "b", "n", "keys", "prints", "own", "places"])

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print, copies, body) of the wanted segments of each text (body, wanted)."""
    for batch in batches:
        for at, part in slices(batch.column(0).cast(pa.large_binary())):
            flat, offsets = raw(part)
            lists = batch.column(1).slice(at, len(part))
            wanted = lists.flatten()
            begin = np.repeat(offsets[:-1], pc.list_value_length(lists).to_numpy()) + wanted.field("start").to_numpy()
            size = wanted.field("size").to_numpy().astype(np.int64)
            for i in range(0, len(size), 4096):
                b, s = begin[i:i + 4096], size[i:i + 4096]
                ends = np.cumsum(s)
                data = flat[np.repeat(b - (ends - s), s) + np.arange(ends[-1])]
                body = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)])
                rows = wanted.slice(i, 4096)
                yield pa.RecordBatch.from_arrays(
                    [rows.field("key"), rows.field("print"), rows.field("copies"), body.cast(pa.binary())], ["key", "print", "copies", "body"])


def _marks(rows: pa.Table) -> pa.RecordBatch:
    """(key, print, ranges): the window starts of each segment whose string is found elsewhere among them."""
    flat, offsets = raw(rows.column("body").combine_chunks().cast(pa.large_binary()))
    size = np.diff(offsets)
    twice = rows.column("copies").to_numpy() > 1
    of = np.repeat(np.arange(len(size)), 1 + twice)  # the segment of each string
    length = size[of] + 1
    until = np.cumsum(length)
    begin = until - length
    symbols = np.zeros(until[-1], dtype=np.int16)
    place = np.arange(until[-1]) - np.repeat(begin, length)
    inside = place < np.repeat(size[of], length)
    symbols[inside] = flat[(np.repeat(offsets[:-1][of], length) + place)[inside]].astype(np.int16) + 1
    found = RunIndex(symbols).statistics() >= WIDTH
    found &= np.repeat(size[of], length) - place >= WIDTH
    found &= ~np.repeat(np.concatenate([[False], of[1:] == of[:-1]]), length)  # the first copy speaks for both
    step = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    string = np.searchsorted(until, lo, "right")
    ranges = pa.StructArray.from_arrays([pa.array((x - begin[string]).astype(np.int32)) for x in (lo, hi)], ["lo", "hi"])
    segment, each = np.unique(of[string], return_counts=True)
    at = pa.array(segment)
    return pa.RecordBatch.from_arrays(
        [rows.column("key").combine_chunks().take(at), rows.column("print").combine_chunks().take(at),
         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), ranges)], ["key", "print", "ranges"])


def _indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from rows (key, print, copies, body) sorted by key, in indexes of whole keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at, keys, sizes = 0, batch.column(0).to_numpy(), pc.binary_length(batch.column(3)).to_numpy()
        for i in range(batch.num_rows):
            if size >= CHUNK and keys[i] != (keys[i - 1] if i else held[-1].column(0)[-1].as_py()):
                held.append(batch.slice(at, i - at))
                yield _marks(pa.Table.from_batches(held))
                held, size, at = [], 0, i
            size += int(sizes[i])
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if size:
        yield _marks(pa.Table.from_batches(held))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _against(gram: int):
    """Segments (key, print, n, own, body) laid against their minimum's first one (ref_print, ref).

    Gives (key, print, part, off, n, body, lo, hi, ref_print, ref_lo, ref_hi):
    the windows [lo, hi) that equal those at [ref_lo, ref_hi) there, as part -1,
    and what goes on, as parts 0 and 1 at offset off.
    """
    def place(key: int, body: np.ndarray) -> int:
        total = np.zeros(len(body) + 1, dtype=_U)
        np.cumsum(BYTES[body] * power("up", len(body)), out=total[1:])
        count = len(body) - gram + 1
        h = mix((total[gram:] - total[:count]) * power("down", len(body))[:count])
        return int(np.flatnonzero(h == np.int64(key).view(_U))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            out = []
            for key, mark, n, own, body, ref_mark, ref in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own or n > 1 or ref is None or mark == ref_mark:
                    out.append((key, mark, 0, 0, n, body, None, None, None, None, None))
                    continue
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = place(key, np.frombuffer(ref, np.uint8))
                at, own_at = known[key], body.find(ref[known[key]:known[key] + gram])
                x, y = np.frombuffer(body, np.uint8), np.frombuffer(ref, np.uint8)
                left = _shared(x[:own_at][::-1], y[:at][::-1]) if own_at >= 0 else 0
                right = _shared(x[own_at:], y[at:]) if own_at >= 0 else 0
                many = len(body) - WIDTH + 1
                if left + right < WIDTH:
                    out.append((key, mark, 0, 0, n, body, None, None, None, None, None))
                    continue
                lo, hi = own_at - left, own_at + right - WIDTH + 1
                out.append((key, mark, -1, 0, n, None, lo, hi, ref_mark, at - left, at + right - WIDTH + 1))
                if lo:
                    out.append((key, mark, 0, 0, n, body[:lo + WIDTH - 1], None, None, None, None, None))
                if hi < many:
                    out.append((key, mark, 1, hi, n, body[hi:], None, None, None, None, None))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            names = ["key", "print", "part", "off", "n", "body", "lo", "hi", "ref_print", "ref_lo", "ref_hi"]
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i:i + 4096], strict=True), types, strict=True)], names)

    return tidy(run)


def _large(bodies: DataFrame, level: int) -> DataFrame:
    """(key, print, ranges) of the segments (key, print, n, own, body) of minima with more than ``MOST`` bytes."""
    bodies = kept(bodies)
    ref = bodies.filter(~F.col("own")).groupBy("key").agg(F.min(F.struct("print", "body")).alias("r")).select(
        "key", F.col("r.print").alias("ref_print"), F.col("r.body").alias("ref"))
    laid = kept(bodies.join(ref, "key", "left").select("key", "print", "n", "own", "body", "ref_print", "ref").mapInArrow(
        _against(LEVELS[level]), "key long, print long, part int, off int, n long, body binary, lo int, hi int, "
        "ref_print long, ref_lo int, ref_hi int"))
    both = laid.filter("part = -1")
    one = lambda lo, hi: F.array(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"))).alias("ranges")
    shared = both.select("key", "print", one("lo", "hi")).union(both.select("key", "ref_print", one("ref_lo", "ref_hi")).distinct())
    part = F.xxhash64("print", "part")
    left = laid.filter("part >= 0").withColumn("b", part)
    inner = repeated_windows(left.select(F.col("key").alias("a"), "b", "n", "body"), level + 1)
    back = left.select(F.col("key").alias("a"), "b", "print", "off").join(inner, ["a", "b"]).select(
        F.col("a").alias("key"), "print", F.transform("ranges", lambda r: F.struct(
            (r.lo + F.col("off")).alias("lo"), (r.hi + F.col("off")).alias("hi"))).alias("ranges"))
    return _merged(shared.union(back).toDF("a", "b", "ranges")).toDF("key", "print", "ranges")


def repeated_windows(texts: DataFrame, level: int = 0) -> DataFrame:
    """(a, b, ranges): starts [lo, hi) of the windows of each text that start elsewhere too.

    ``texts`` has (a, b, n, body): two hashes that name the content, how many
    there are of it, and its bytes; a content may come in several rows.
    """
    gram, final = LEVELS[level], LEVELS[level] == WIDTH
    cut = kept(texts.select("a", "b", "n", "body").mapInArrow(tidy(_cut(gram)), SEGMENTS))
    rows = cut.select("a", "b", "n", F.explode(F.arrays_zip("keys", "prints", "own", "places")).alias("s")).select(
        "a", "b", "n", F.col("s.keys").alias("key"), F.col("s.prints").alias("print"), F.col("s.own").alias("own"),
        F.col("s.places").alias("places"))
    start, many = F.col("places")[0]["start"], F.col("places")[0]["many"]
    size = F.lit(WIDTH) if final else many + (WIDTH - 1)
    # at last a segment is a run of equal windows
    copies = F.col("n") * (F.aggregate("places", F.lit(0), lambda n, p: n + p["many"]) if final else F.size("places"))
    each = kept(rows.groupBy("key", "print").agg(F.sum(copies).alias("copies"), F.max("own").alias("own"),
                                                 F.min(F.struct("a", "b", start.alias("start"), size.alias("size"))).alias("from")))
    strings = F.least("copies", F.lit(2))
    again = each.groupBy("key").agg(F.sum(strings * F.col("from.size")).alias("bytes"),
                                    F.sum(strings + F.col("own").cast("int")).alias("total")).filter("total > 1").drop("total")
    wanted = kept(each.join(again, "key").select("key", "print", strings.cast("int").alias("copies"), "from", "own", "bytes"))
    lists = kept(wanted.groupBy(F.col("from.a").alias("a"), F.col("from.b").alias("b")).agg(F.collect_list(F.struct(
        F.col("from.start").alias("start"), F.col("from.size").alias("size"), "key", "print", "copies")).alias("wanted")))
    owners = with_ids(texts.select("a", "b", "body"), lists.select("a", "b"), ["a", "b"])
    owners = owners.groupBy("a", "b").agg(F.first("body").alias("body"))
    bodies = owners.join(lists, ["a", "b"]).select("body", "wanted").mapInArrow(tidy(_bodies), "key long, print long, copies int, body binary")
    marks = None
    if not final:
        large = wanted.filter(F.col("bytes") > MOST)
        if not large.isEmpty():
            bodies = kept(bodies)
            over = kept(large.select("key").distinct())
            marks = _large(with_ids(bodies, over, "key").join(large.select("key", "print", "own"), ["key", "print"]).select(
                "key", "print", F.col("copies").cast("long").alias("n"), "own", "body"), level)
            bodies = with_ids(bodies, over, "key", "left_anti")
    found = bodies.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_indexes), f"key long, print long, ranges {RANGES}")
    found = kept(found if marks is None else found.unionByName(marks))
    if final:
        shifted = F.transform("places", lambda p: F.struct(p["start"].alias("lo"), (p["start"] + p["many"]).alias("hi")))
    else:
        shifted = F.flatten(F.transform("places", lambda p: F.transform("ranges", lambda r: F.struct(
            (r.lo + p["start"]).alias("lo"), (r.hi + p["start"]).alias("hi")))))
    return kept(_merged(rows.join(found, ["key", "print"]).select("a", "b", shifted.alias("ranges"))))


def _merged(rows: DataFrame) -> DataFrame:
    """(a, b, ranges) with the ranges of all rows of a text together, in order and apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _union(b.column(2), ("lo", "hi"), 0)], ["a", "b", "ranges"])

    return rows.groupBy("a", "b").agg(F.flatten(F.collect_set("ranges")).alias("ranges")).mapInArrow(
        run, f"a long, b long, ranges {RANGES}")


def _union(ranges: pa.Array, names: tuple[str, str], longer: int) -> pa.Array:
    """The ranges [lo, hi) of each list, ``longer`` at their ends, merged where they overlap or touch, in order."""
    rows = pc.list_parent_indices(ranges).to_numpy()
    lo, hi = (ranges.flatten().field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
    by = np.lexsort((lo, rows))
    rows, lo, hi = rows[by], lo[by], hi[by] + longer
    line = rows * (1 << 40)  # one number line with room between the texts
    reach = np.maximum.accumulate(hi + line)
    new = np.concatenate([[True], (lo + line)[1:] > reach[:-1]])[:len(lo)]
    start = np.flatnonzero(new)
    stop = reach[np.append(start[1:], len(lo)) - 1] - line[start] if len(start) else lo[:0]
    spans = pa.StructArray.from_arrays([pa.array(lo[start].astype(np.int32)), pa.array(stop.astype(np.int32))], list(names))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows[start], minlength=len(ranges)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), spans)


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of bytes that the windows cover."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _union(b.column(2), ("from", "to"), WIDTH - 1)], ["a", "b", "spans"])


def contents(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, n, body) of each row: two hashes of its text and the text's bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
                       F.lit(1).cast("long").alias("n"), text.cast("binary").alias("body"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(a, b, spans): the runs of bytes [from, to) to remove from each text that has any."""
    return kept(repeated_windows(contents(docs)).mapInArrow(_bytes, "a long, b long, spans array<struct<from:int,to:int>>"))


def kept_bytes(body: Column, spans: Column) -> Column:
    """The bytes outside the spans, in order."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["to"]))
    stops = F.concat(F.transform(spans, lambda s: s["from"]), F.array(F.octet_length(body)))
    pieces = F.zip_with(starts, stops, lambda x, y: F.hex(F.substring(body, x + 1, y - x)))
    return F.unhex(F.array_join(pieces, ""))


def cleaned(docs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(a, b, spans, kept): what remains of each text with repeats, once for each content."""
    spans = repeated_spans(docs) if spans is None else spans
    texts = with_ids(contents(docs).select("a", "b", "body"), spans.select("a", "b"), ["a", "b"])
    return texts.groupBy("a", "b").agg(F.first("body").alias("body")).join(spans, ["a", "b"]).select(
        "a", "b", "spans", kept_bytes(F.col("body"), F.col("spans")).alias("kept"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    cut = cleaned(docs).select("a", "b", removed.alias("gone"), F.size("spans").cast("long").alias("runs"), F.sha2("kept", 256).alias("sha"))
    rows = contents(docs).select("doc_id", "a", "b", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    return rows.join(cut, ["a", "b"], "left").select(
        "doc_id", "n_bytes", F.coalesce("gone", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("runs", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
