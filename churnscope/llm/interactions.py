"""Filter interaction audit: what five text filters remove in each of their 120 orders.

Filters A to E fail a text that has under 100 words (A), too few distinct
words (B), too many capitals (C), a symbol of ``SYMBOLS`` (D), or a text that
a smaller doc_id has too (E).  A row's failures are one mask of five bits, and
all that the audit tells of any order follows from the number of rows per
(part, mask): counts are additive, so a part is never gathered.

Duplicates (E) go through a counting Bloom prepass.  Every text gives a 64-bit
hash, which names a segment and one counter in each of the segment's two
tables.  Each task sends the counters that its own rows touch, the tables of a
segment are merged by addition, and a text whose two counters do not both reach
two is unique for certain.  Segments are added in proportion to the rows
(``ROWS`` each), so the share of false alarms is the same at every size, and
none of the sketch is broadcast.  Only possible repeats are then grouped by
their full text, after a partial minimum in each task, for the smallest doc_id.

Defined cases: a null text counts as empty and a null lang is the part '';
rows of equal doc_id count each and are not smaller than one another; a null
doc_id is never smaller, and its own row never fails E; a document is good
(toxic) if any of its label rows says so, and labels of null or unknown ids
count for nothing; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.frames import kept, with_ids

FILTERS = "ABCDE"
SYMBOLS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
#: Texts that a segment of the sketch holds, and counters in each of its two tables.
ROWS, CELLS = 8192, 1 << 16
#: Hashes that a task gathers before it sends their counters.
BLOCK = 1 << 20


def failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D that a non-null text fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [F.size(words) < 100, F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
              capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10, text.rlike(SYMBOLS)]
    return sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(failed)), F.lit(0))


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment that the task's rows touch: the counter pairs, and how often (once, or twice for more)."""
    def send(marks: list[np.ndarray]) -> pa.RecordBatch:
        mark, often = np.unique(np.concatenate(marks), return_counts=True)
        segment = mark >> 32
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        at = np.append(first, len(mark)).astype(np.int32)
        cells, times = (mark & 0xFFFFFFFF).astype(np.uint32), np.minimum(often, 2).astype(np.uint8)
        binary = lambda values, width: pa.Array.from_buffers(
            pa.binary(), len(first), [None, pa.py_buffer(at * np.int32(width)), pa.py_buffer(values)])
        return pa.RecordBatch.from_arrays([pa.array(segment[first]), binary(cells, 4), binary(times, 1)], ["segment", "cells", "times"])

    held: list[np.ndarray] = []
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False))
        if sum(map(len, held)) >= BLOCK:
            yield send(held)
            held = []
    if sum(map(len, held)):
        yield send(held)


def _merged(sketches: pa.Table) -> pa.Table:
    """The marks of a segment whose two counters both reach two when all tasks' tables are added."""
    cells = np.frombuffer(b"".join(sketches.column("cells").to_pylist()), dtype=np.uint32)
    times = np.frombuffer(b"".join(sketches.column("times").to_pylist()), dtype=np.uint8)
    high, low = cells >> 16, cells & 0xFFFF
    first = np.bincount(high, times, CELLS)
    second = np.bincount(low, times, CELLS)
    again = np.unique(cells[(first[high] >= 2) & (second[low] >= 2)]).astype(np.int64)
    segment = sketches.column("segment")[0].as_py() if sketches.num_rows else 0
    return pa.table({"mark": pa.array((segment << 32) | again)})


def possible_repeats(marks: DataFrame) -> DataFrame:
    """The distinct values of ``mark`` that the merged sketch does not clear as unique."""
    sketches = marks.select("mark").mapInArrow(_counters, "segment long, cells binary, times binary")
    return sketches.groupBy("segment").applyInArrow(_merged, "mark long")


def _mark(text: Column, segments: int) -> Column:
    """Segment and counter pair of a text as one number."""
    h = F.xxhash64(text)
    return F.shiftleft(F.pmod(h, F.lit(segments)), 32).bitwiseOR(F.shiftrightunsigned(h, 32))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): the filters that each row of ``docs`` fails, in no order of filters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    segments = max(1, -(-rows.count() // ROWS))
    rows = rows.withColumn("mark", _mark(F.col("text"), segments))
    digest = F.unhex(F.sha2("text", 256))
    base = kept(rows.select("doc_id", "part", failures(F.col("text")).alias("mask"), "mark", digest.alias("digest")))
    again = kept(possible_repeats(base))
    # full texts meet here only; the digest then leads each row to its group
    firsts = with_ids(rows.select("doc_id", "text", "mark"), again, "mark").groupBy("text").agg(
        F.min("doc_id").alias("low"), F.count("*").alias("n")).filter("n > 1").select(digest.alias("digest"), "low")
    found = base.join(kept(firsts), "digest", "left")
    return found.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("low"), 16).otherwise(0)).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows that fail just the filters of ``mask``, and those labelled good or toxic."""
    marked = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(marked("quality"), marked("toxic"))
    return masks(docs).join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant and lost (see the module)."""
    counts = kept(mask_counts(docs, labels))
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn(
        "before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))
    mask, own, before = F.col("mask"), F.col("own"), F.col("before")
    fails, early = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    add = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    # of the orders, 120 / (failed filters) have a given one of the failed filters first
    first_in = F.when(fails, F.col("n") * F.lit(120) / F.greatest(F.bit_count(mask), F.lit(1))).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        add(~fails & ~early).alias("kept"), add(fails & ~early).alias("removed"), add(fails & early).alias("redundant"),
        add(mask == own).alias("unique_fails"), add(fails & ~early, "good").alias("good_lost"),
        add(fails & ~early, "toxic").alias("toxic_lost"), F.sum(F.round(first_in).cast("long")).cast("long").alias("shapley"))


SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (
  select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         min(doc_id) over (partition by text) as low from d),
m as (
  select w.doc_id, part,
    (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * (w.doc_id > low)::int as mask,
    coalesce(l.quality, 0) as good, coalesce(l.toxic, 0) as toxic
  from w left join labels l on l.doc_id = w.doc_id),
c as (select part, mask, count(*) as n, sum((good = 1)::int) as good, sum((toxic = 1)::int) as toxic from m group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (
  select filter_order, i::int as step, bits[i] as own, coalesce(list_sum(bits[1:i - 1]), 0)::int as before
  from o, range(1, 6) r(i)),
x as (
  select part, filter_order, step, own,
    sum(n) filter (mask & own = 0 and mask & before = 0) as kept,
    sum(n) filter (mask & own <> 0 and mask & before = 0) as removed,
    sum(n) filter (mask & own <> 0 and mask & before <> 0) as redundant,
    sum(n) filter (mask = own) as unique_fails,
    sum(good) filter (mask & own <> 0 and mask & before = 0) as good_lost,
    sum(toxic) filter (mask & own <> 0 and mask & before = 0) as toxic_lost
  from c, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, own), 0)::bigint as shapley
from x
"""
