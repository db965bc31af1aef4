"""N-gram Jaccard join by a partition of the shingle universe.

Two sets R, S of similarity 0.75 or more differ in at most
H = (|R| + |S|) / 7 shingles.  Sizes fall into bands [2^b, 2^(b+1)); a pair
meets in the band of its smaller set, so a set appears in its own band and, if
it may have smaller partners there, in the band below.  Per band the universe
is hashed into segments; a set's shingles in one segment are its subset there.
More than H segments cannot all differ, which gives three tiers.  Every tier
finds each pair of which one side is *covered*; the sets it leaves uncovered
enter the next one.

1. Subsets (allocation 1).  Widely shared shingles are left out of the
   universe: any fixed choice is correct, since leaving shingles out only
   lowers differences.  With m segments, a set with more than H non-empty
   subsets is covered: at most H of its subsets differ from the partner's.  It
   is enough to index the first H + 1 subsets in one global order, and large
   subsets, which few sets share, come first in it.
2. Subsets plus one-deletion neighbourhoods (allocation 2).  For sets made
   mostly of widely shared shingles small subsets would match everywhere, so
   the cost model gives them fewer, larger segments: a segment of two or more
   shingles also finds partners that differ by one there, and counts twice
   towards H + 1.
3. Single shingles.  What is left (tiny sets, unlucky hashes) indexes the first
   n - ceil(0.75 n) + 1 shingles of each set in one global order.

Equal sets are one class beforehand.  Sets that share an index entry form a
group.  Small groups give all pairs, large ones the pairs with their smallest
member; pairs are screened by parity sketches, which never reject a true pair,
and verified exactly on the texts.  Groups that the links found so far do not
hold together are completed in two rounds: pairs across components are screened
in blocks; a spanning few are verified and join components; then all that are
left between different components.  So no link between components is
lost, and a large group of near copies never gives all its pairs.

Defined cases: null, empty and all-blank texts have no shingles and link with
nothing; a null doc_id gives a row with a null component and links nothing;
rows that repeat a doc_id are one document with the links of all its texts,
one result row each; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.sequence import prefix_sum
from churnscope.llm import text as T
from churnscope.llm.frames import components, kept, with_ids

#: segments per shingle of the largest set of a band: tier 1, tier 2
SHARE = (0.42, 0.2)
#: sample of documents from which widely shared shingles are taken, the least count there, and their number
SAMPLE, SHARED_AT, MAX_SHARED = 20_000, 4, 200_000
#: groups up to this size give all pairs at once
SMALL = 8
#: groups of a node that tell whether a pair was named in an earlier group
FEW = 8
#: index entries per bucket, and members per block of a large group
BUCKET, BLOCK = 400_000, 1_024
#: bytes of sketches that are compared at a time
SCREEN = 1 << 25

_U = np.uint64


def similar(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def bound(a: int, b: int) -> int:
    """The most shingles in which similar sets of these sizes differ."""
    return (a + b) // 7


# --- signatures -----------------------------------------------------------

def _new(values: np.ndarray) -> np.ndarray:
    """Whether each of some values differs from the one before it."""
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def _segments(tokens: np.ndarray, m: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens' values in segment order, segment starts, subset sizes (non-empty segments only)."""
    h = T.mix(tokens ^ _U(salt))
    seg = ((h >> _U(40)) * _U(m)) >> _U(24)
    order = np.argsort(seg.astype(np.uint16) if m <= 1 << 16 else seg, kind="stable")  # short ones sort faster
    seg = seg[order]
    first = np.flatnonzero(_new(seg))
    size = np.empty(len(first), dtype=np.int64)
    np.subtract(first[1:], first[:-1], out=size[:-1])
    size[-1] = len(seg) - first[-1]
    return T.mix(h + _U(0x632BE59BD9B4E019))[order], first, size


def _salt(tier: int, band: int) -> int:
    return (0x9FB21C651E98DF25 * (tier * 64 + band + 1)) & 0xFFFFFFFFFFFFFFFF


def _meetings(n: int) -> list[tuple[int, int, int]]:
    """(band, largest size in band, H) where a set of n shingles may meet a partner."""
    band = n.bit_length() - 1
    found = [(band, 2 ** (band + 1) - 1, bound(n, 4 * n // 3))]
    if 3 * n <= 4 * (2**band - 1):
        found.append((band - 1, 2**band - 1, bound(n, 2**band - 1)))
    return found


def subsets(tokens: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
    """Tier 1: index entries and whether the set is covered. ``tokens``: those of the n shingles that are not widely shared."""
    out, covered = [], True
    for band, top, h in _meetings(n):
        m = int(SHARE[0] * top) + 2
        if not len(tokens):
            return np.zeros(0, dtype=_U), False
        values, first, size = _segments(tokens, m, _salt(1, band))
        total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(values, dtype=_U)])
        entry = T.mix((total[first + size] - total[first]) ^ _U(_salt(11, band)))
        covered &= len(entry) > h
        if len(entry) > h + 1:
            entry = entry[np.lexsort((entry, -np.minimum(size, 15)))[:h + 1]]
        out.append(entry)
    return np.concatenate(out), covered


def neighbourhoods(tokens: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
    """Tier 2: subsets and their one-deletion neighbours over all shingles, and whether the set is covered."""
    out, covered = [], True
    for band, top, h in _meetings(n):
        m = int(SHARE[1] * top) + 2
        values, first, size = _segments(tokens, m, _salt(2, band))
        total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(values, dtype=_U)])
        whole = total[first + size] - total[first]
        less = (np.repeat(whole, size) - values)[np.repeat(size, size) > 1]
        covered &= int(np.minimum(size, 2).sum()) > h
        out.append(T.mix(np.concatenate([whole, less]) ^ _U(_salt(12, band))))
    return np.unique(np.concatenate(out)), covered


def prefix(tokens: np.ndarray, n: int) -> np.ndarray:
    """Tier 3: the first shingles in hash order."""
    return T.mix(np.sort(T.mix(tokens ^ _U(_salt(3, 0))))[:n - -(-3 * n // 4) + 1])


def entries(tokens: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """All index entries of one set of distinct shingles. ``shared``: sorted widely shared shingles."""
    n = len(tokens)
    if n < 3:  # only equal sets are similar
        return np.zeros(0, dtype=_U)
    rare = tokens if not len(shared) else tokens[shared[np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)] != tokens]
    found, covered = subsets(rare, n)
    if not covered:
        # cost model: a document of widely shared shingles would match everywhere on small subsets
        more, covered = neighbourhoods(tokens, n)
        found = np.concatenate([found, more])
        if not covered:
            found = np.concatenate([found, prefix(tokens, n)])
    return found


def parity(tokens: np.ndarray) -> np.ndarray:
    """Parity sketch: bit h mod B counts its shingles modulo 2; B, a power of two, is at least twice the set."""
    bits = min(1 << 16, max(64, 1 << int(2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def may_be_similar(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """False only if the sets differ in more than H shingles: differing parities are differing shingles."""
    if 4 * min(n_a, n_b) < 3 * max(n_a, n_b):
        return False
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):  # bit i and i + B/2 of the longer one share a bit of the shorter
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum()) <= bound(n_a, n_b)


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    for _, hashes, many in T.shingles_of(column):
        ends = np.cumsum(many)
        for e, k in zip(ends, many, strict=True):
            own = np.sort(hashes[e - k:e])  # sorting so few is several times faster than unique()
            yield own[_new(own)]


# --- steps ------------------------------------------------------------------

def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sketch) of every document: set size, digest of the set, parity sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sketch = [], [], []
            for s in sets_of(b.column(1)):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketch.append(parity(s).tobytes() if len(s) > 2 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(sketch, pa.binary())], ["doc_id", "n", "key", "sketch"])
    return docs.mapInArrow(T.tidy(run), "doc_id long, n long, key binary, sketch binary")


def _shared(docs: DataFrame, reps: DataFrame) -> np.ndarray:
    """Widely shared shingles, from a bounded sample of documents; at most MAX_SHARED."""
    picked = reps.select("doc_id").orderBy(F.xxhash64(F.lit("shared"), "doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            value, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, _U), np.zeros(0, int))
            held.clear()
            for at in range(0, len(value), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(value[at:at + 100_000].view(np.int64)),
                                                  pa.array(count[at:at + 100_000])], ["token", "c"])
        size = 0
        for b in batches:
            for s in sets_of(b.column(0)):
                held.append(s)
                size += len(s)
                if size > 2_000_000:
                    yield from out()
                    size = 0
        yield from out()

    found = (with_broadcast(docs, picked).select("text").mapInArrow(T.tidy(run), "token long, c long").groupBy("token")
             .agg(F.sum("c").alias("c")).filter(F.col("c") >= SHARED_AT).orderBy(F.desc("c"), "token").limit(MAX_SHARED)
             .select("token").toPandas())
    return np.sort(found["token"].to_numpy().astype(np.int64).view(_U))


def with_broadcast(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the at most SAMPLE ids."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")


def _index(docs: DataFrame, reps: DataFrame, shared: np.ndarray, buckets: int) -> DataFrame:
    """Packed index entries: rows of (bucket, entries, owners, nodes).

    ``entries`` are 32 bits of each entry, ``owners`` places in ``nodes``.
    Entries that agree by chance only add pairs to verify.  A task indexes
    equal sets once; rows are built from at most about two million entries.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        nodes: list[int] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not size:
                return
            entry = np.concatenate(held)
            owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), [len(x) for x in held])
            bucket = (entry % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            entry, owner, ids = (entry >> _U(32)).astype(np.uint32)[order], owner[order], np.array(nodes, dtype=np.int64)
            rows = []
            for k in np.flatnonzero(np.diff(cut)):
                used, place = np.unique(owner[cut[k]:cut[k + 1]], return_inverse=True)
                rows.append((int(k), entry[cut[k]:cut[k + 1]].tobytes(), place.astype(np.uint32).tobytes(), ids[used].tobytes()))
                if len(rows) == 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

        names = ["bucket", "entries", "owners", "nodes"]
        for b in batches:
            for node, tokens in zip(b.column(0).to_pylist(), sets_of(b.column(1)), strict=True):
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if node is None or len(tokens) < 3 or digest in seen:
                    continue
                seen.add(digest)
                held.append(entries(tokens, shared))
                nodes.append(node)
                size += len(held[-1])
                if size > 2_000_000:
                    yield from out()
                    held, nodes, size = [], [], 0
        yield from out()

    return docs.mapInArrow(T.tidy(run), "bucket long, entries binary, owners binary, nodes binary")


def _groups(index: DataFrame, parts: int) -> DataFrame:
    """Distinct groups (members) of two or more documents that share an index entry."""
    def groups_of(rows: list[tuple]) -> Iterator[list[int]]:
        entry = np.concatenate([np.frombuffer(r[0], np.uint32) for r in rows])
        node = np.concatenate([np.frombuffer(r[2], np.int64)[np.frombuffer(r[1], np.uint32)] for r in rows])
        order = np.lexsort((node, entry))
        entry, node = entry[order], node[order]
        keep = np.concatenate([[True], (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])])
        entry, node = entry[keep], node[keep]
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        size = np.diff(np.append(first, len(entry)))
        seen: set = set()
        for f, s in zip(first[size > 1], size[size > 1], strict=True):
            members = node[f:f + s]
            key = members.tobytes() if s < 16 else hashlib.blake2b(members.tobytes(), digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                yield members.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            found = []
            for g in groups_of(rows) if rows else ():
                found.append(g)
                if len(found) == 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["members"])
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["members"])

        for b in batches:
            for bucket, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if bucket != now:
                    yield from out()
                    now, rows = bucket, []
                rows.append(row)
        yield from out()

    return (index.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket")
            .mapInArrow(T.tidy(run), "members array<long>").distinct())


def _screened(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs (a, b) that their parity sketches allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_a, s_a, n_b, s_b = (b.column(i).to_pylist() for i in range(2, 6))
            ok = [may_be_similar(np.frombuffer(x, np.uint8), k, np.frombuffer(y, np.uint8), m)
                  for x, k, y, m in zip(s_a, n_a, s_b, n_b, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    side = lambda x: described.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("key").alias(f"k_{x}"),
                                      F.col("sketch").alias(f"s_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter("k_a <> k_b and 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")  # equal sets are one class already
            .select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(T.tidy(run), "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, from their whole texts."""
    nodes = kept(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    # a smallest member may have very many partners: its text goes to chunks of them
    rows = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(64)))
    texts = with_ids(docs, nodes, "doc_id")
    left = rows.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text")), "b").select("a", "chunk", "b", "text")
    right = rows.select("a", "chunk").distinct().join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text")), "a").select(
        "a", "chunk", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs = None, []
        for batch in batches:
            a, chunk, b = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for k, tokens in enumerate(sets_of(batch.column(3))):
                if (a[k], chunk[k]) != now:
                    now, hubs = (a[k], chunk[k]), []
                if b[k] is None:  # nulls come first: the texts of a, of which there may be several by repeated ids
                    hubs.append(tokens)
                elif any(similar(len(np.intersect1d(h, tokens, assume_unique=True)), len(h), len(tokens)) for h in hubs):
                    found.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return (left.union(right).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
            .mapInArrow(T.tidy(run), "a long, b long").distinct())


class _Block:
    """Rows of one block of a large group, in order of their ids, and their sketches folded to the shortest one's length."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        number = lambda c: rows.column(c).to_numpy()
        order = np.argsort(number("node"), kind="stable")
        self.own, self.node, self.n, self.label = (number(c)[order].astype(np.int64) for c in ("own", "node", "n", "label"))
        flat, ends = T.raw(rows.column("sketch").chunk(0).cast(pa.large_binary()))
        self._flat, self._from, self._length = flat, ends[:-1][order], np.diff(ends)[order]
        self.least = int(self._length.min())
        self.folded = np.empty((len(order), self.least), dtype=np.uint8)
        for length in np.unique(self._length).tolist():
            at = np.flatnonzero(self._length == length)
            for part in np.array_split(at, -(-len(at) * length // SCREEN)):
                wide = flat[self._from[part, None] + np.arange(length)]
                self.folded[part] = np.bitwise_xor.reduce(wide.reshape(len(part), -1, self.least), axis=1)
        self._lists = {c: (rows.column(c).chunk(0).fill_null([]), order) for c in ("vain", "before")}

    def sketch(self, i: int) -> np.ndarray:
        return self._flat[self._from[i]:self._from[i] + self._length[i]]

    def members(self, column: str, i: int) -> frozenset[int]:
        values, order = self._lists[column]
        return frozenset(values[int(order[i])].as_py())

    def pairs(self, within: bool, limit: int) -> list[tuple[int, int]]:
        """Pairs that may be similar and lie in two components; see ``_across``."""
        own, node, n, label = self.own, self.node, self.n, self.label.copy()
        found, named, lists = [], {}, {}

        def known(column: str, i: int) -> frozenset[int]:
            if (column, i) not in lists:
                lists[column, i] = self.members(column, i)
            return lists[column, i]

        step = max(1, min(64, SCREEN // (len(node) * self.least)))  # rows of the matrix of pairs at a time
        for low in range(0, len(node), step):
            x = slice(low, low + step)
            ok = ((label[x, None] != label) & (node[x, None] < node) & (within | (own[x, None] != own))
                  & (4 * np.minimum(n[x, None], n) >= 3 * np.maximum(n[x, None], n)))
            i, k = np.nonzero(ok)
            i += low
            close = np.bitwise_count(self.folded[i] ^ self.folded[k]).sum(axis=1) <= (n[i] + n[k]) // 7
            for i, k in zip(i[close].tolist(), k[close].tolist(), strict=True):
                a, b = sorted((int(label[i]), int(label[k])))
                if a == b or int(node[k]) in known("vain", i) or not known("before", i).isdisjoint(known("before", k)):
                    continue
                if not may_be_similar(self.sketch(i), int(n[i]), self.sketch(k), int(n[k])):
                    continue
                found.append((int(node[i]), int(node[k])))
                named[a, b] = named.get((a, b), 0) + 1
                if named[a, b] == limit:
                    label[label == b] = a
        return found


def _across(groups: DataFrame, labels: DataFrame, described: DataFrame, failed: DataFrame, limit: int,
            only: DataFrame | None = None) -> DataFrame:
    """Screened pairs (a, b, g) that may join components inside large groups g that span several of them.

    With a ``limit`` a block names so many pairs for two components and then
    takes them as one, members in order of id: groups of the same documents
    mostly name the same pairs, and a block about as many as it has members.
    With 0 it names all.  Pairs that were verified in vain (``failed``) are not
    named again.  A pair that shares several of these groups is named in the
    smallest of them, and again in a later one only if neither of their FEW
    smallest groups is common to both; the caller drops such repeats.

    ``only`` names the groups that gave a pair before.  The others give none
    later either: components only grow, and the screen of a pair is the same
    in every group, so what it held back there it would hold back again.
    """
    member = groups.select(F.xxhash64("members").alias("g"), "members")
    if only is not None:
        member = with_ids(member, only, "g")
    member = member.select("g", F.explode("members").alias("node"))
    member = member.join(labels, "node", "left").select("g", "node", F.coalesce("component", "node").alias("label"))
    spans = kept(member.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
                 .filter("low <> high").select("g", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    # a pair that shares several groups is named in the smallest: each row carries its node's FEW smallest groups before it
    placed = member.join(spans, "g").groupBy("node", "label").agg(
        F.sort_array(F.collect_set(F.struct("g", "blocks"))).alias("of")).select(
        "node", "label", "of", F.slice("of.g", 1, FEW).alias("few")).select(
        "node", "label", "few", F.posexplode("of").alias("at", "group")).select(
        "node", "label", "group.g", "group.blocks", F.when(F.col("at") < FEW, F.slice("few", F.lit(1), F.col("at"))).otherwise(
            F.col("few")).alias("before"))
    own = F.pmod(F.xxhash64("node", "g"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    known = failed.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("vain"))
    rows = placed.join(known, "node", "left").withColumn("own", own).withColumn("other", other).join(
        described.select(F.col("doc_id").alias("node"), "n", "sketch"), "node").select(
        "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "sketch",
        "vain", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) < 2:
                return
            g, i, j = (held[0].column(c)[0].as_py() for c in range(3))
            found = _Block(pa.Table.from_batches(held)).pairs(i == j, limit)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                     pa.array([g] * len(found), pa.int64())], ["a", "b", "g"])

        for b in batches:
            block = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1, [b.num_rows]]).tolist()
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if held and to > at and tuple(block[:, at]) != tuple(held[-1].column(c)[0].as_py() for c in range(3)):
                    yield from out()
                    held = []
                if to > at:
                    held.append(b.slice(at, to - at))
        yield from out()

    return (rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(T.tidy(run), "a long, b long, g long").distinct())


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = kept(_described(docs))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # equal sets: one class, whose smallest id stands for it
    classes = kept(described.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")))
    total = described.agg(F.sum("n")).first()[0] or 0
    shared = _shared(docs, classes.select(F.col("rep").alias("doc_id")))
    buckets = max(parts, total // 2 // BUCKET)
    groups = kept(_groups(_index(docs, classes, shared, buckets), parts))
    # an index entry names one document of its class per task: make it the class's representative
    small = groups.filter(F.size("members") <= SMALL)
    position = F.posexplode("members").alias("i", "a")
    pairs = small.select(position, "members").select("a", F.explode(F.expr("slice(members, i + 2, size(members))")).alias("b"))
    large = groups.filter(F.size("members") > SMALL)
    pairs = pairs.union(large.select(F.element_at("members", 1).alias("a"), F.explode("members").alias("b"))).filter(
        "a <> b").distinct()
    one = described.filter("sketch is not null and doc_id is not null").dropDuplicates(["doc_id", "key"])
    links = kept(_verified(kept(_screened(pairs, one).distinct()), docs))
    # documents of one class, and texts of one id, belong together
    same = described.filter("doc_id is not null").join(classes, "key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = kept(links.union(same).filter("a <> b"))
    labels = components(edges)
    failed, only = links.limit(0), None
    for limit in (1, 0):  # a spanning pair of each two components first; then all pairs of those that did not join
        named = kept(_across(large, labels, one, failed, limit, only))
        if named.isEmpty():
            break
        only = kept(named.select("g").distinct())
        late = kept(named.select("a", "b").distinct())
        found = kept(_verified(late, docs))
        failed = late.join(found, ["a", "b"], "left_anti").select("a", "b")
        edges = kept(edges.union(found))
        labels = components(edges)
    return described.select("doc_id", F.col("n").alias("n_shingles")).join(
        labels.select(F.col("node").alias("doc_id"), F.col("component")), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each group of linked texts: that of the smallest doc_id.

    Rows of a repeated doc_id are decided one by one, by their own texts: only
    texts that are equal or linked make a group, so an id keeps a row for each
    of its texts that links to nothing, and null, empty or blank texts, which
    link to nothing, never stand for another.  Of several rows of a group's
    smallest doc_id one is picked by a hash of the row.  Rows without an id
    link nothing and stay.
    """
    names = docs.columns
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = kept(jaccard_components(docs).filter("doc_id <> component_id").select("doc_id"))
        return with_ids(docs, gone, "doc_id", "left_anti").select(*names)
    # each row becomes a document of its own, numbered in order of the ids
    rows = docs.filter("doc_id is not null").select(F.struct(*names).alias("row")).select(
        "row", F.col("row.doc_id").alias("id"), F.xxhash64("row").alias("hash"), F.lit(1).alias("one"))
    rows = kept(prefix_sum(rows, ["id", "hash"], "one", "node"))
    found = jaccard_components(rows.select(F.col("node").alias("doc_id"), "row.text"))
    gone = kept(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("node")))
    return with_ids(rows, gone, "node", "left_anti").select("row.*").union(docs.filter("doc_id is null").select(*names))
