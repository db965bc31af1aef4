"""Source divergence audit: how the sources of a language differ in their term shares.

Terms are maximal runs of ASCII letters and of characters beyond ASCII, with
A-Z lower-cased.  A language keeps the terms that occur in at least
``THRESHOLD`` of its documents.  They are found by iceberg prefix refinement:
level by level, from ``FIRST`` bytes and doubling, each document gives the
distinct byte prefixes of its terms once, prefixes found in fewer documents are
discarded with all terms that begin with them, and the others are extended until
every kept prefix is a complete term.

The texts are read twice.  The first pass cuts them into terms and sums the
documents of each prefix in the task, by hashes of language and bytes, beside
the hash of the prefix half as long.  These sums are checkpointed, and the levels
refine them: a level adds up its sums over the tasks only where the shorter prefix
was kept, so a rare term goes no further than its first rare prefix.  The hashes
of kept complete terms go to the second pass as a bit table of at most
``1 << MOST_BITS`` bits, which may let a discarded term through but never loses a
kept one.  The second pass counts the surviving terms by their very bytes, in
each task by the sources of a language, and the threshold is applied again to the
sums, so the result is exact.

Shares are p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in exact decimals.  The
distances between sources are summed over blocks of terms and tiles of sources:
a block holds a dense matrix of at most ``TERMS`` terms by two tiles of ``TILE``
sources, and terms that neither tile has are added in closed form.

Defined cases: null text, lang and source count as ''; each row is a document,
also where a doc_id repeats; a group without kept terms has N = 0, and one
whose language keeps none is at distance 0 from the others; a language's only
source has no pairs; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc  # a worker need not have it loaded otherwise
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.frames import kept, with_ids
from churnscope.llm.text import as_strings, mix, raw, slices, tidy, word_hashes, word_spans

THRESHOLD = 30
TOP = 50
#: Bytes of the first level's prefixes, each level doubles them; and of no level: terms are complete at once.
FIRST, WHOLE = 4, 1 << 40
#: Bits of a key, of a prefix or a complete term.
KEY = 43
#: The bit table of kept terms has 16 bits for each, and 32 MB at most.
LEAST_BITS, MOST_BITS = 16, 28
#: Text bytes that are cut into terms at a time, few enough for a core's cache.
SLICE = 1 << 18
#: Text bytes whose terms are counted together, sums that a task holds before it sends them, and sums of a batch.
PART, HELD, SENT = 1 << 22, 1 << 20, 100_000
#: Terms of a block and sources of a tile.
TERMS, TILE = 512, 128

_U = np.uint64
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class BitTable:
    """A set of keys as one bit for each key's upper bits: may hold more keys, never fewer."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = KEY - (len(words) * 64 - 1).bit_length()

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> self.shift
        return (self.words[place >> 6] >> (place & 63).astype(_U)) & _U(1) != 0


def bit_table(keys: DataFrame) -> BitTable:
    """The table of ``keys`` (column key), built by the tasks: the driver gets at most 2^22 words of it."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    place = F.shiftright("key", KEY - bits)
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(key, {KEY - bits}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=_U)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(_U)
    return BitTable(table)


def term_keys(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Keys of the terms, or of their prefixes, in their languages."""
    return (mix(word_hashes(flat, starts, ends) + lang) >> _U(64 - KEY)).view(np.int64)


def _first(values: np.ndarray) -> np.ndarray:
    """Marks where a run of equal values begins."""
    return np.concatenate([[True], values[1:] != values[:-1]])[:len(values)]


class _Sums:
    """Sums by key, and by the ``own`` columns after it, of one or more columns, merged now and then.

    Rows whose keys alone agree may stay apart from others of their own columns.
    """

    def __init__(self, own: int = 0):
        self.own = own
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *n: np.ndarray) -> None:
        self.parts.append((keys, *n))
        self.size += len(keys)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys = np.concatenate([p[0] for p in self.parts])
            by = np.argsort(keys)
            keys = keys[by]
            columns = list(zip(*self.parts, strict=True))[1:]
            own = [np.concatenate(c)[by] for c in columns[:self.own]]
            first = np.flatnonzero(np.logical_or.reduce([_first(c) for c in (keys, *own)]))
            sums = [np.add.reduceat(np.concatenate(c)[by], first) for c in columns[self.own:]]
            self.parts, self.size = [(keys[first], *(c[first] for c in own), *sums)], len(first)

    def taken(self) -> tuple[np.ndarray, ...]:
        self.merge()
        (found,) = self.parts
        self.parts, self.size = [], 0
        return found


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text of each term) of a slice."""
    flat, offsets = raw(texts)
    starts, ends, counts = word_spans(flat, offsets, ~LETTER)
    return flat, starts, ends, np.repeat(np.arange(len(counts)), counts)


def _documents_per_key(keys: np.ndarray, parent: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their parents, and how many of the documents have each; ``doc`` ascends.

    A slice has fewer than 2^20 terms' texts.  Where prefixes of several parents
    share a key, each keeps its parent, and its documents may count again.
    """
    doc = np.cumsum(_first(doc)) - 1  # numbers of the texts that have terms
    pairs = (keys << 20) | doc
    by = np.argsort(pairs)
    pairs, parent = pairs[by], parent[by]
    new = _first(pairs) | _first(parent)
    keys, parent = pairs[new] >> 20, parent[new]
    first = np.flatnonzero(_first(keys) | _first(parent))
    return keys[first], parent[first], np.diff(np.append(first, len(keys)))


def _levels(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, doc: np.ndarray,
            first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, keys, parents, documents of each) of a slice's prefixes, of ``first`` bytes and doubling.

    A place is twice the level, and one more for terms that the level completes:
    those with fewer bytes.  A parent is the key of the prefix half as long.
    """
    size, at, length = ends - starts, [np.arange(len(starts))], [first]
    while len(more := at[-1][size[at[-1]] >= length[-1]]):
        at.append(more)
        length.append(2 * length[-1])
    of, many = np.concatenate(at), [len(x) for x in at]
    keys = term_keys(flat, starts[of], np.minimum(ends[of], starts[of] + np.repeat(length, many)), lang[of])
    parent = np.zeros(len(starts), dtype=np.int64)
    for level, (x, key) in enumerate(zip(at, np.split(keys, np.cumsum(many)[:-1]), strict=True)):
        whole = size[x] < length[level]
        for place, own in ((2 * level, ~whole), (2 * level + 1, whole)):
            if own.any():
                yield place, *_documents_per_key(key[own], parent[x[own]], doc[x[own]])
        parent[x] = key


def _found(batches: Iterator[pa.RecordBatch], first: int = WHOLE) -> Iterator[pa.RecordBatch]:
    """Documents per prefix of the terms, summed in the task; its key lies below the bits of its place."""
    sums = _Sums(own=1)

    def send() -> pa.RecordBatch:
        key, parent, n = sums.taken()
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(parent)], ["key", "n", "parent"])

    for b in batches:
        langs = b.column(0).to_numpy(zero_copy_only=False).view(_U)
        for at, part in slices(as_strings(b.column(1)), SLICE):
            flat, starts, ends, doc = _terms(part)
            for place, key, parent, n in _levels(flat, starts, ends, langs[at:at + len(part)][doc], doc, first):
                sums.add(place << KEY | key, parent, n)
        if sums.size > HELD:
            sums.merge()
            if sums.size > HELD:
                yield send()
    if sums.size:
        yield send()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, whole, key, n, parent): the prefixes that ``_found`` finds, as lists of at most ``SENT``."""
    for b in _found(batches, FIRST):
        key, n, parent = (c.to_numpy() for c in b.columns)
        place = key >> KEY  # ascends, as the keys do
        bounds = np.union1d(np.flatnonzero(_first(place)), np.arange(0, len(key), SENT))
        for at, to in pairwise([*bounds.tolist(), len(key)]):
            own = (key[at:to] & (1 << KEY) - 1, n[at:to].astype(np.int32), parent[at:to])
            yield pa.RecordBatch.from_arrays(
                [pa.array([place[at] >> 1], pa.int32()), pa.array([bool(place[at] & 1)]),
                 *(pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), pa.array(c)) for c in own)],
                ["level", "whole", "key", "n", "parent"])


class _Counted:
    """Documents and occurrences of terms by group, with dictionaries of both."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.words = pa.array([], pa.large_binary())
        self.sums = _Sums()

    def codes(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        codes = found.fill_null(0).to_numpy().astype(np.int64)
        codes[new] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, words.take(pa.array(new))])
        return codes

    def add(self, group: np.ndarray, doc: np.ndarray, words: pa.Array) -> None:
        """Terms in order of their documents, and each document's group."""
        words = words.dictionary_encode()
        term = self.codes(words.dictionary)[words.indices.to_numpy()]
        pair, n = np.unique(group[doc] << 32 | term, return_counts=True)
        new = _first(doc)
        seen = np.sort(term << 22 | np.cumsum(new) - 1)
        seen = seen[_first(seen)]
        own = group[doc[new]]  # of the documents that have terms
        once, docs = np.unique(own[seen & 0x3FFFFF] << 32 | seen >> 22, return_counts=True)
        self.sums.add(pair, docs, n)  # both are the pairs of a group and a term that occur, in order

    def taken(self) -> Iterator[pa.RecordBatch]:
        if not self.sums.size:
            return
        pair, docs, n = self.sums.taken()
        lang, source = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        group, word = pair >> 32, pair & 0xFFFFFFFF
        names, at = np.unique(lang.to_numpy(zero_copy_only=False), return_inverse=True)
        term = at[group] << 32 | word  # of its language
        by = np.argsort(term)
        for x in (by[i:i + SENT] for i in range(0, len(by), SENT)):
            first = np.flatnonzero(_first(term[x]))
            own = pa.StructArray.from_arrays([source.take(pa.array(group[x])), pa.array(docs[x]), pa.array(n[x])], ["source", "docs", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at[group[x[first]]]], pa.string()), self.words.take(pa.array(word[x[first]])).cast(pa.binary()).cast(pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), own)], ["lang", "term", "own"])
        self.__init__()


def _lowered(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The terms' bytes in lower case, one after the other."""
    edge = np.zeros(len(flat) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return LOWER[flat[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]]


def _kept_terms(texts: pa.Array, lang: np.ndarray, table: BitTable) -> tuple[np.ndarray, pa.Array]:
    """(text, bytes) of each of the terms whose key is in the table."""
    docs, sizes, data = [], [np.zeros(1, dtype=np.int64)], []
    for at, part in slices(texts, SLICE):
        flat, starts, ends, doc = _terms(part)
        stay = table.has(term_keys(flat, starts, ends, lang[at:at + len(part)][doc]))
        starts, ends = starts[stay], ends[stay]
        docs.append(at + doc[stay])
        sizes.append(ends - starts)
        data.append(_lowered(flat, starts, ends))
    bounds, data = np.cumsum(np.concatenate(sizes)), np.concatenate(data)
    return np.concatenate(docs), pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def _counts(whole: Callable[[], BitTable]) -> Callable:
    """(lang, term, own) of the terms whose key is in the table: documents and occurrences by source, summed in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counted()
        for b in batches:
            hashed, texts = b.column(0).to_numpy(zero_copy_only=False).view(_U), as_strings(b.column(1))
            names = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            for at, part in slices(texts, PART):
                doc, words = _kept_terms(part, hashed[at:at + len(part)], whole())
                if not len(doc):
                    continue
                group = np.array([held.groups.setdefault(g, len(held.groups)) for g in names[at:at + len(part)]], dtype=np.int64)
                held.add(group, doc, words)
                if held.sums.size > HELD:
                    held.sums.merge()
                    if held.sums.size > HELD:
                        yield from held.taken()
        yield from held.taken()

    return tidy(run)


def _documents(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).select(F.xxhash64("lang").alias("hash"), "text", "lang", "source")


def prefix_sums(docs: DataFrame) -> DataFrame:
    """(level, whole, key, n, parent): documents per prefix and task, in lists, of the terms of ``docs``."""
    return _documents(docs).select("hash", "text").mapInArrow(
        tidy(_prefixes), "level int, whole boolean, key array<long>, n array<int>, parent array<long>")


def extended(sums: DataFrame, level: int, before: DataFrame | None) -> DataFrame:
    """(whole, key, n): a level's prefixes and the terms it completes, where the prefix half as long is in ``before`` (parent)."""
    rows = sums.filter(F.col("level") == level).select("whole", F.inline(F.arrays_zip("key", "n", "parent")))
    return rows if before is None else with_ids(rows, before, "parent")


def kept_prefixes(sums: DataFrame, threshold: int) -> Iterator[DataFrame]:
    """For each level (whole, key): the prefixes, and the complete terms, that at least ``threshold`` documents hold."""
    level, before = 0, None
    while True:
        found = extended(sums, level, before).groupBy("whole", "key").agg(F.sum("n").alias("n"))
        found = kept(found.filter(F.col("n") >= threshold).select("whole", "key"))
        yield found
        before, level = found.filter("not whole").select(F.col("key").alias("parent")), level + 1
        if before.isEmpty():
            return


def kept_terms(docs: DataFrame, threshold: int = THRESHOLD) -> BitTable:
    """The keys of all complete terms that at least ``threshold`` documents of their language hold."""
    levels = kept_prefixes(kept(prefix_sums(docs)), threshold)
    whole = reduce(lambda a, b: a.union(b), (found.filter("whole").select("key") for found in levels))
    return bit_table(kept(whole))  # by now nothing refers to the sums, which go


def _shared(spark, table: BitTable) -> Callable[[], BitTable]:
    sent = spark.sparkContext.broadcast(table)
    return lambda: sent.value


def term_counts(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, source, term, n, total): occurrences of each kept term in a group that has it, and in its language."""
    whole = _shared(docs.sparkSession, kept_terms(docs, threshold))
    rows = _documents(docs).mapInArrow(_counts(whole), "lang string, term string, own array<struct<source:string,docs:long,n:long>>")
    # a term's rows meet once: the sums by source and those over them need no further shuffle
    sums = rows.repartition("lang", "term").select("lang", "term", F.inline("own")).groupBy("lang", "source", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    return sums.withColumn("in", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term)).filter(
        F.col("in") >= threshold).select("lang", "source", "term", "n", "total")


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (size + 5 terms)), exact for any counts; null where no terms are."""
    exact = lambda c: c.cast("decimal(19,0)")
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * exact(n + 5)
    below = F.when(terms > 0, exact(size + 5 * terms))
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _distances(rows: pa.Table) -> pa.Table:
    """Sums of abs(p - q) of a block's terms for each two sources of two tiles, and how many terms that were."""
    base = rows.filter(pc.is_null(rows.column("term")))
    rows = rows.filter(pc.is_valid(rows.column("term")))
    source, p0 = base.column("at").to_numpy(), base.column("p").to_numpy()
    source, first = np.unique(source, return_index=True)
    p0 = p0[first]
    words = rows.column("term").combine_chunks().dictionary_encode()
    p = np.repeat(p0[:, None], len(words.dictionary), axis=1)
    p[np.searchsorted(source, rows.column("at").to_numpy()), words.indices.to_numpy()] = rows.column("p").to_numpy()
    a, b = base.column("a")[0].as_py(), base.column("b")[0].as_py()
    tile = (source - 1) // TILE
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(tile == a):
        j = np.flatnonzero((tile == b) & (source > source[i]))
        out.append((np.full(len(j), source[i]), source[j], np.abs(p[j] - p[i]).sum(axis=1)))
    one, two, part = (np.concatenate(x) for x in zip(*out, strict=True))
    lang = pa.array([base.column("lang")[0].as_py()] * len(one), pa.string())
    return pa.table({"lang": lang, "one": pa.array(one.astype(np.int32)), "two": pa.array(two.astype(np.int32)),
                     "part": pa.array(part.astype(np.int64)), "seen": pa.array(np.full(len(one), p.shape[1], dtype=np.int64))})


def source_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, one, two, part, seen) for ``one`` < ``two``, sums over the terms that a block of both tiles saw."""
    tiles = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = lambda df: df.withColumn("tile", F.floor((F.col("at") - 1) / TILE).cast("int")).withColumn("other", tiles).select(
        "lang", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "at", "term", "p")
    own = counts.join(groups, ["lang", "source"]).select(
        "lang", "at", "tiles", "term", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"),
        F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / TERMS)).cast("int").alias("block"))
    none = groups.filter("terms > 0").select(
        "lang", "at", "tiles", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"),
        F.explode(F.sequence(F.lit(0), (F.ceil(F.col("terms") / TERMS) - 1).cast("int"))).alias("block"))
    return pairs(own).unionByName(pairs(none)).groupBy("lang", "a", "b", "block").applyInArrow(
        _distances, "lang string, one int, two int, part long, seen long").groupBy("lang", "one", "two").agg(
        F.sum("part").alias("part"), F.sum("seen").alias("seen"))


def audit(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms a source is fond of."""
    counts = kept(term_counts(docs, threshold))
    terms = counts.groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    found = _documents(docs).select("lang", "source").distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    in_lang = Window.partitionBy("lang")
    groups = found.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("terms", F.lit(0)).alias("terms"),
        F.coalesce("all", F.lit(0)).alias("all"), F.row_number().over(in_lang.orderBy("source")).alias("at"),
        F.ceil(F.count("*").over(in_lang) / TILE).cast("int").alias("tiles"))
    groups = kept(groups.withColumn("p0", share(F.lit(0), F.col("size"), F.col("terms"))))
    apart = source_distances(counts, groups)
    a, b = groups.alias("a"), groups.select("lang", "source", "at", "p0").alias("b")
    pair = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.at") != F.col("b.at"))).select(
        "a.lang", "a.source", F.col("b.source").alias("item"), "a.terms", F.abs(F.col("a.p0") - F.col("b.p0")).alias("far"),
        F.least("a.at", "b.at").alias("one"), F.greatest("a.at", "b.at").alias("two"))
    unseen = F.col("terms") - F.coalesce("seen", F.lit(0))
    pair = pair.join(apart, ["lang", "one", "two"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.coalesce("part", F.lit(0)) + F.when(unseen > 0, unseen * F.col("far")).otherwise(0)).cast("long").alias("value"))
    fond = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (share(F.col("n"), F.col("size"), F.col("terms")) - share(F.col("total"), F.col("all"), F.col("terms"))).alias("value")
    ).filter("value > 0")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pair).unionByName(ranked(fond).filter(F.col("rank") <= top))


SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (
  select row_number() over () as row, lang, source,
         regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from d),
u as (select row, lang, source, unnest(terms) as term from t),
k as (select lang, term, count(*) as total from u group by all having count(distinct row) >= 30),
v as (select lang, count(*) as terms, sum(total) as total from k group by lang),
c as (select u.lang, u.source, u.term, count(*) as n from u join k using (lang, term) group by all),
g as (
  select o.lang, o.source, coalesce(terms, 0) as terms, coalesce(v.total, 0) as all_n, coalesce(sum(n), 0) as size
  from (select distinct lang, source from d) o left join v using (lang) left join c using (lang, source) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (size + 5 * terms)::hugeint as p,
    1 + (1000000000::hugeint * (total + 5)) // (all_n + 5 * terms)::hugeint as q
  from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q),
z as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from r)
select * from z where part = 'pair' or rank <= 50
"""
