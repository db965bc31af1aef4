"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1], linear from
``w * start`` to ``w * end``.  Its demand by time t is the target times the
integral of the schedule up to t (normalised over [0, 1]); inverting that at
the words taken so far gives each taken copy its position, and a range sort by
position gives the training order.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and
share all words.  A target stops at ``MAX_REPEAT`` times its source's size; the
excess is shared again by weight until no target is above, which is one water
level: a source is capped if ``cap / weight`` lies below the level.

Within a source the documents are taken in hash order of doc_id, in whole
passes; the last pass stops at the document where the target is reached, which
is taken whole or not at all, whichever comes nearer the target.  So a source
takes its target to within half a document, a text is never cut, and no
document is taken more than ``MAX_REPEAT`` times.

Running sums of a hot source: rows are dealt by (source, slice of the hash),
summed within the slice, and shifted by the sums of the slices before, so no
task holds a source.

Defined cases: a null text has size 0 and takes 0 words; a null source is a
source of its own; documents of equal id are ordered by size, and equal rows
count each; empty tables give no rows; a column of ``documents`` other than
doc_id, text and source is not read by the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.frames import kept

MAX_REPEAT = 3
SLICES = 256
#: a schedule's value at the start and at the end of training, by weight 1, 2, 3
SCHEDULES = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}
#: what ``mixed_documents`` tells of a copy: its place in the training order, and its numbers
ORDER = ("position", "twin", "copy")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, print, slice, place): the hash order within a source; ``print`` hashes the text."""
    place = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       words(F.col("text").cast("string")).alias("size"),
                       F.xxhash64(F.col("text").cast("string")).alias("print"), place.alias("place")
                       ).withColumn("slice", F.substring("place", 1, 2))


def targets(per_source: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row per source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per_source.withColumn("weight", ((F.row_number().over(in_order) - 1) % 3 + 1).cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    up, down = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = MAX_REPEAT * F.col("source_size").cast("double")
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(up), F.lit(0.0))) / F.sum("weight").over(down)
    found = weighed.withColumn("level", level).withColumn(
        "level", F.max("level").over(everything))  # it rises with every capped source taken out, and falls after
    return found.select("source", "source_size", "weight",
                        F.when(cap <= F.col("level") * F.col("weight"), cap)
                        .otherwise(F.col("level") * F.col("weight")).alias("target"))


def taken(docs: DataFrame) -> DataFrame:
    """Every document with what the mix takes of it.

    Columns: doc_id, source, size, print, source_size, weight, target, before
    (words of its source ahead of it in one pass), n_copies, taken.
    """
    rows = kept(sizes(docs))  # one scan of the texts
    per_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sums = per_slice.withColumns({
        "ahead": F.coalesce(F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)),
        "all": F.sum("slice_size").over(Window.partitionBy("source"))})
    goal = targets(per_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    of = sums.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        "s.source", "s.slice", "s.ahead", "g.source_size", "g.weight", "g.target")
    in_slice = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size", "print").rowsBetween(
        Window.unboundedPreceding, -1)
    local = rows.withColumn("within", F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
    joined = local.alias("r").join(of.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source"))
                                   & (F.col("r.slice") == F.col("o.slice"))).select(
        "r.doc_id", "r.source", "r.size", "r.print", "o.source_size", "o.weight", "o.target",
        (F.col("r.within") + F.col("o.ahead")).alias("before"))
    whole = F.floor("target").cast("long")
    full = F.col("source_size") > 0
    rest = F.when(full, whole % F.col("source_size")).otherwise(F.lit(0)) - F.col("before")
    passes = F.when(full, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    more = (rest > 0) & (2 * rest >= F.col("size"))  # the document at the target: whole if that is nearer
    copies = F.when(F.col("size") > 0, passes + more.cast("long")).otherwise(F.lit(0))
    return joined.withColumn("n_copies", copies.cast("long")).withColumn("taken", F.col("n_copies") * F.col("size"))


def position(progress: Column, start: Column, end: Column) -> Column:
    """Time t at which a linear schedule has given ``progress`` (0 to 1) of its integral."""
    slope, total = end - start, (start + end) / 2
    root = F.sqrt(start * start + 2 * slope * total * progress)
    return F.when(F.abs(slope) < 1e-12, progress).otherwise(F.abs((root - start) / slope))  # not -0.0


def planned(docs: DataFrame) -> DataFrame:
    """``taken`` with the column copies: number and position of each copy of the document, in training order."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(float(x)) for w, s in SCHEDULES.items() for x in (w, s[i])]),
                                  F.col("weight"))
    done = lambda copy: copy * F.col("source_size") + F.col("before")
    copies = F.transform(F.sequence(F.lit(1), F.col("n_copies").cast("int")), lambda c: F.struct(
        (c - 1).alias("copy"), position(done(c - 1) / F.col("target"), pick(0), pick(1)).alias("position")))
    return taken(docs).withColumn("copies", F.when(F.col("n_copies") > 0, copies).otherwise(F.slice(copies, 1, 0)))


def curriculum(docs: DataFrame) -> DataFrame:
    """One row per taken copy: (doc_id, source, print, twin, copy, copy_words, position).

    ``twin`` numbers rows of one doc_id, source and text.  The training order is
    ``in_order`` of (position, doc_id, print, twin, copy).
    """
    twin = F.row_number().over(Window.partitionBy("doc_id", "source", "print").orderBy("before"))
    return planned(docs).withColumn("twin", twin).withColumn("c", F.explode("copies")).select(
        "doc_id", "source", "print", "twin", "c.copy", F.col("size").alias("copy_words"), "c.position")


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows range-sorted: each partition holds one range of ``order``, and is sorted by it."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The taken copies as documents, in training order: the columns of docs, and ``ORDER`` (in place of such columns)."""
    names = [c for c in docs.columns if c not in ORDER]
    key = ("_id", "_source", "_print", "twin")
    copies = kept(curriculum(docs)).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                                           F.col("print").alias("_print"), *ORDER)
    own = docs.select(*names, F.col("doc_id").cast("long").alias("_own_id"), F.col("source").cast("string").alias("_own_source"),
                      F.xxhash64(F.col("text").cast("string")).alias("_own_print"))
    own = own.withColumn("_own_twin", F.row_number().over(
        Window.partitionBy("_own_id", "_own_source", "_own_print").orderBy(F.lit(0))))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(key, ("_own_id", "_own_source", "_own_print", "_own_twin"), strict=True)]
    rows = own.join(copies, same[0] & same[1] & same[2] & same[3])
    order = ("position", "doc_id", "_print", "twin", "copy")
    return rows.repartitionByRange("position").sortWithinPartitions(*order).select(*names, *ORDER)


_SQL = """
with d as (
  select cast(doc_id as bigint) doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) size,
    md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) place from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) weight from s),
l as (select *, (sum(source_size) over () - coalesce(sum(3 * cast(source_size as double)) over (
    order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (
    order by source_size / weight, source nulls last rows between current row and unbounded following) lvl from w),
g as (select source, source_size, weight, least(3.0 * source_size, weight * max(lvl) over ()) target from l),
r as (select d.doc_id, d.source, d.text, d.size, g.source_size, g.weight, g.target, cast(floor(g.target) as bigint) goal,
    cast(coalesce(sum(d.size) over (partition by d.source
    order by d.place, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as bigint) before
  from d join g on d.source is not distinct from g.source),
n as (select *, case when source_size = 0 then 0 else goal % source_size end - before as rest from r),
t as (select *, case when size = 0 then 0
    else goal // source_size + case when rest > 0 and 2 * rest >= size then 1 else 0 end end as copies from n),
c as (select t.*, cast(k.copy as int) as copy, (k.copy * source_size + before) / target as progress
  from t, range(3) k(copy) where k.copy < copies),
p as (select *, case weight when 1 then 1.5 - sqrt(2.25 - 2 * progress) when 2 then progress
    else sqrt(0.25 + 2 * progress) - 0.5 end as position from c)
"""

#: The query's rows in DuckDB SQL.
SQL = _SQL + """
select t.doc_id, cast(t.size as bigint) size, t.source_size, t.target, cast(t.copies * t.size as bigint) taken,
  min(position) as first_position, max(position) as last_position
from t left join p on p.doc_id is not distinct from t.doc_id and p.source is not distinct from t.source and p.before = t.before
  and p.text is not distinct from t.text
group by all
"""


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_position, last_position) of every document, in training order.

    The positions, null where nothing is taken, are those of its first and last
    copy in the curriculum.  Rows are range-sorted by the first one, so they
    come as training first reaches them; those that are not taken come last.
    """
    at = F.transform("copies", lambda c: c["position"])
    rows = planned(docs).withColumns({"first_position": F.array_min(at), "last_position": F.array_max(at)})
    return in_order(rows, F.col("first_position").asc_nulls_last(), "doc_id", "print").select(
        "doc_id", "size", F.col("source_size").cast("long"), "target",
        (F.size("copies") * F.col("size")).cast("long").alias("taken"), "first_position", "last_position")


#: The rows of ``ordered`` in DuckDB SQL.
CURRICULUM_SQL = _SQL + """
select doc_id, source, cast(row_number() over (partition by doc_id, source, text, copy order by before) as int) as twin, copy,
  cast(size as bigint) as copy_words, position
from p
"""


def ordered(docs: DataFrame) -> DataFrame:
    """The rows of ``curriculum`` without the print, range-sorted to the training order."""
    return in_order(curriculum(docs), "position", "doc_id", "print", "twin", "copy").select(
        "doc_id", "source", F.col("twin").cast("int").alias("twin"), "copy", F.col("copy_words").cast("long").alias("copy_words"), "position")
