"""Exact top-k inner-product search by ball trees, one per shard.

Vectors become integers, floor(256 * x) per component.  Candidates are dealt
to shards by hash; each shard builds a ball tree (centre, radius and index
range per node; median cuts along the widest component).  A query descends the
child of the higher upper bound  q.c + |q| r  first and skips nodes whose bound
lies below its current k-th score.  Queries first search one shard each; the
k-th scores found there are shared with all other shards as their start.

Queries come in groups and candidates in shards, both of bounded size; every
(shard, group) is one task's work.  Bounds have a margin above rounding, and
scores are exact integers, so results equal those of a full comparison.

Defined cases: null vectors, vectors with null or non-finite components and
rows with a null id take no part; shorter vectors count as padded with zeros;
rows with the query's own id are not its candidates; a repeated id is as many
candidates, and as many queries, as it has rows; ties go to the smaller id;
scores of any size are compared exactly, and those beyond a long are given as
the nearest long, in the order of their true values; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.frames import kept

LEAF, SCALE = 48, 256
#: vectors per shard and queries per group at most, on average
SHARD, GROUP = 32_768, 16_384
#: digits of the largest score that finite vectors can have, and some more for the sum
DIGITS = 640
LONG = 1 << 63


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): valid vectors times ``SCALE``; their floors are taken where they are used, since doubles hold all."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(SCALE)))
    valid = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & valid).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers, which have no bound."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def beyond(score: int) -> str:
    """What a score beyond a long adds to it: digits whose descending order is that of the scores; else empty."""
    if -LONG <= score < LONG:
        return ""
    digits = str(abs(score)).zfill(DIGITS)
    return digits if score > 0 else digits.translate(str.maketrans("0123456789", "9876543210"))


class BallTree:
    """A ball tree over the rows of x; scores are exact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.centre, self.radius, self.range, self.child = [], [], [], []
        order = np.lexsort((ids,))
        self.order = order
        self.x = x
        self._build(0, len(ids))
        self.ids, self.x = ids[self.order], x[self.order]
        top = float(np.abs(x).max(initial=0))
        self.top = top

    def _build(self, low: int, high: int) -> int:
        rows = self.x[self.order[low:high]].astype(np.float64)
        centre = rows.mean(axis=0)
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())))
        self.range.append((low, high))
        self.child.append(None)
        spread = rows.max(axis=0) - rows.min(axis=0)
        if high - low > LEAF and spread.max(initial=0) > 0:
            cut = int(spread.argmax())
            half = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argsort(rows[:, cut], kind="stable")]
            left = self._build(low, low + half)
            self.child[node] = (left, self._build(low + half, high))
        return node

    def search(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of each query's best k with a score of at least ``floor``; missing ones have the id -1."""
        most = float(np.abs(q).max(initial=0)) * self.top * max(1, q.shape[1])
        # products and sums below 2^53 are exact as doubles, those below 2^62 as longs
        kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
        qs, xs = (_integers(q), _integers(self.x)) if kind is object else (q.astype(kind), self.x.astype(kind))
        qf = q.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            scale = max(1.0, float(np.abs(q).max(initial=0)))
            norm = scale * np.sqrt(((qf / scale) ** 2).sum(axis=1))
            margin = 1e-9 * (norm * (self.top * np.sqrt(max(1, q.shape[1])) + 1)) + 1e-6
        none = -(1 << 63) if kind is not object else -(10 ** DIGITS)
        held = object if kind is object else np.int64
        best = np.full((len(q), k), none, dtype=held)
        who = np.full((len(q), k), np.iinfo(np.int64).max, dtype=np.int64)
        # bounds are compared as doubles, a little below the true k-th score
        kth = np.nextafter(floor, -np.inf)

        def upper(node: int, of: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore", invalid="ignore"):
                bound = qf[of] @ self.centre[node] + norm[of] * self.radius[node] + margin[of]
            return np.where(np.isnan(bound), np.inf, bound)

        def visit(node: int, of: np.ndarray, bound: np.ndarray) -> None:
            of = of[bound >= kth[of]]
            if not len(of):
                return
            if self.child[node] is None:
                low, high = self.range[node]
                score = (qs[of] @ xs[low:high].T).astype(held)
                score[ids[of][:, None] == self.ids[None, low:high]] = none
                hit = _doubles(score.max(axis=1)) >= kth[of]
                of, score = of[hit], score[hit]
                if not len(of):
                    return
                all_scores = np.concatenate([best[of], score], axis=1)
                all_ids = np.concatenate([who[of], np.broadcast_to(self.ids[low:high], score.shape)], axis=1)
                all_ids = np.where(all_scores == none, np.iinfo(np.int64).max, all_ids)
                if held is object:
                    first = np.array([sorted(range(len(s)), key=lambda j, s=s, i=i: (-s[j], i[j]))[:k]
                                      for s, i in zip(all_scores, all_ids, strict=True)])
                else:
                    first = np.lexsort((all_ids, -np.maximum(all_scores, none + 1)), axis=-1)[:, :k]
                best[of] = np.take_along_axis(all_scores, first, 1)
                who[of] = np.take_along_axis(all_ids, first, 1)
                last = best[of][:, -1]
                kth[of] = np.maximum(kth[of], np.where(last == none, -np.inf, np.nextafter(_doubles(last), -np.inf)))
                return
            left, right = self.child[node]
            u, v = upper(left, of), upper(right, of)
            for first, second, part, a, b in ((left, right, u >= v, u, v), (right, left, u < v, v, u)):
                if part.any():
                    visit(first, of[part], a[part])
                    visit(second, of[part], b[part])

        every = np.arange(len(q))
        if len(self.ids):
            visit(0, every, upper(0, every))
        who[best == none] = -1
        return best, who


def _doubles(scores: np.ndarray) -> np.ndarray:
    """The scores as doubles, infinite beyond all doubles."""
    if scores.dtype != object:
        return scores.astype(np.float64)
    most = int(np.finfo(np.float64).max)
    return np.array([float(v) if abs(v) <= most else np.inf if v > 0 else -np.inf for v in scores.tolist()])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(values), width))
    place = np.arange(width)[None, :] < length[:, None]
    out[place] = np.floor(values.flatten().to_numpy())
    return out


def top_k(vectors: DataFrame, id_col: str, vector_col: str, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = kept(quantised(vectors, id_col, vector_col))
    queries = kept(rows.filter(F.col("id") % every == 0).select(
        F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), F.col("v").alias("query")))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    many = queries.count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(1, -(-n // SHARD), min(parts, n // 1024))
    groups = max(1, -(-many // GROUP))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")
    candidates = rows.select("id", "v", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = queries.select("q", "query_id", "query", F.pmod(F.xxhash64("q", F.lit(1)), F.lit(shards)).cast("int").alias("home"),
                           group.alias("group"))
    out = "q long, query_id long, vec_id long, score long, beyond string"

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        q, ids = left["q"].to_numpy(), left["query_id"].to_numpy()
        scores = who = np.zeros((0, k), dtype=np.int64)
        if left.num_rows and right.num_rows:
            tree = BallTree(right["id"].to_numpy(), _matrix(right["v"], width))
            floor = left["floor"].to_numpy()
            found = [tree.search(ids[i:i + 2048], _matrix(left["query"].slice(i, 2048), width), floor[i:i + 2048], k)
                     for i in range(0, len(q), 2048)]
            scores, who = (np.concatenate([f[j] for f in found]) for j in (0, 1))
        hit = who >= 0 if len(who) else np.zeros((0, k), bool)
        row = np.nonzero(hit)[0]
        found = scores[hit]
        more = [beyond(v) for v in found.tolist()] if found.dtype == object else [""] * len(found)
        found = np.array([min(max(v, -LONG), LONG - 1) for v in found.tolist()], dtype=np.int64) if found.dtype == object else found
        return pa.table({"q": q[row], "query_id": ids[row], "vec_id": who[hit], "score": found, "beyond": more}, schema=pa.schema(
            [(c, pa.int64()) for c in ("q", "query_id", "vec_id", "score")] + [("beyond", pa.string())]))

    def searched(at: DataFrame) -> DataFrame:
        return at.groupBy("shard", "group").cogroup(candidates.groupBy("shard", "group")).applyInArrow(search, out)

    best = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    lowest = F.lit(float("-inf"))
    at_home = kept(searched(asked.select("q", "query_id", "query", F.col("home").alias("shard"), "group", lowest.alias("floor"))))
    floors = ranked(at_home).groupBy("q").agg(F.max("rank").alias("found"), F.min("score").alias("kth"))
    elsewhere = asked.join(floors, "q", "left").withColumn(
        "floor", F.when((F.col("found") == k) & (F.col("kth") > -LONG), F.col("kth").cast("double")).otherwise(lowest)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home").select(
        "q", "query_id", "query", "shard", "group", "floor")
    return ranked(at_home.union(searched(elsewhere))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The query's rows in DuckDB SQL.
SQL = """
with v as (select vec_id id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v
  from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.id query_id, c.id vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v),
    lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) score
  from v q, v c where q.id % 50 = 0 and c.id <> q.id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 5
"""
