"""Customer list: search, paging, page stats, and synthetic customers.

Lists are ordered by customerID, then by the other columns from left to right,
so that repeated ids have one order too; rows that are equal in every column
may stand for each other.  The comparison looks beyond the id only where ids
tie, so nothing is computed of a row to place it.

Three ways to a page: ``page`` sorts by OFFSET, which makes Spark keep all
rows up to the requested position; ``keyset_page`` (``customerID > last``)
stays cheap at any depth, as the predicate reaches the scan and a bounded top-k
returns the page, but only follows another page; ``indexed_page`` jumps to any
page of a written table by a positional index, and reads one range of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.scalar import parse_or_zero
from churnscope.functions.sequence import prefix_sum

# --- fixed values: paging and generator domains --------------------------------
PAGE_SIZE = 20
GENDERS = ["Male", "Female"]
YES_NO = ["Yes", "No"]
INTERNET_SERVICES = ["DSL", "Fiber optic", "No"]
CONTRACTS = ["Month-to-month", "One year", "Two year"]
PAYMENT_METHODS = ["Electronic check", "Mailed check", "Bank transfer (automatic)",
                   "Credit card (automatic)"]
SENIOR_PERCENT = 30
CHURN_PERCENT = 27
TENURE_MAX = 72
CHARGE_MIN, CHARGE_MAX = 18.0, 120.0
NOISE_MIN, NOISE_MAX = -50.0, 100.0
# -------------------------------------------------------------------------------


def search(df: DataFrame, term: str | None) -> DataFrame:
    """Case-insensitive substring match on customerID (the term's own
    ``%``/``_`` act as wildcards); a blank term applies no filter."""
    t = (term or "").strip()
    if not t:
        return df
    return df.where(F.col("customerID").ilike(f"%{t}%"))


def page(df: DataFrame, page_no: int = 1, term: str | None = None,
         size: int = PAGE_SIZE) -> DataFrame:
    """Rows ``[(p-1)*size, p*size)`` of the (searched) list by customerID,
    numeric fields parsed the way the list view parses them."""
    p = max(int(page_no), 1)
    rows = search(df, term).orderBy(*_order(df)).offset((p - 1) * size).limit(size)
    return parsed_view(rows)


def parsed_view(df: DataFrame) -> DataFrame:
    """SC14 applied to the list's numeric fields (unparseable -> 0)."""
    out = df
    for c in ("MonthlyCharges", "TotalCharges", "tenure", "SeniorCitizen"):
        out = out.withColumn(c, parse_or_zero(c))
    return out


def _others(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns if c != "customerID"]


def _order(df: DataFrame) -> list[str]:
    """The list's order: the id, then the other columns."""
    return ["customerID", *_others(df)]


Cursor = tuple[str, tuple, int]


def keyset_page(df: DataFrame, after: str | Cursor | None = None, term: str | None = None,
                size: int = PAGE_SIZE) -> DataFrame:
    """The page that follows ``after`` in the list's order.

    ``after`` is a customerID (its rows are all skipped) or, where ids may
    repeat, the cursor ``next_cursor`` gives for the page before: no row is
    lost or shown twice.  NULL ids come on the first pages, before any cursor
    of theirs exists, so page a table whose ids may be NULL without them.
    """
    return parsed_view(_after(search(df, term), after).limit(size))


def _after(rows: DataFrame, after: str | Cursor | None) -> DataFrame:
    order = _order(rows)
    if isinstance(after, tuple):
        last, values, seen = after
        types = [rows.schema[c.strip("`")].dataType for c in order[1:]]
        shown = F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(values, types))])
        own = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order[1:])])
        # a condition on the id alone, for the scan; then the exact place
        rows = rows.where((F.col("customerID") >= F.lit(last)) & ((F.col("customerID") > F.lit(last)) | (own >= shown)))
        return rows.orderBy(*order).offset(seen)
    if after is not None:
        rows = rows.where(F.col("customerID") > F.lit(after))
    return rows.orderBy(*order)


def next_cursor(df: DataFrame, after: str | Cursor | None = None, term: str | None = None,
                size: int = PAGE_SIZE) -> Cursor | None:
    """(customerID, other columns, rows shown that equal both) at the end of the page after ``after``; None past the end."""
    rows = search(df, term)
    shown = [(r[0], tuple(r[1:])) for r in _after(rows, after).limit(size).select(*_order(rows)).collect()]
    if not shown:
        return None
    last = shown[-1]
    seen = shown.count(last)
    if isinstance(after, tuple) and after[:2] == last:
        seen += after[2]
    return (*last, seen)


# --- positional index: any page of a written table ------------------------------
INDEX_ROWS = 10_000


def build_page_index(df: DataFrame, path: str, rows_per_range: int = INDEX_ROWS) -> None:
    """Write (low, high, n, before): id ranges of about ``rows_per_range`` rows, and the rows ahead of each.

    Only the ids are shuffled, and counted first, so a hot id is one row and
    lies in one range.  They are range-partitioned as any sort is, and cut
    within each partition: the sample that Spark's driver takes to place the
    bounds depends on the number of partitions, not on that of the ranges.
    NULL ids are ahead of all others and counted in the first range, whose low
    end is open.
    """
    counts = df.groupBy("customerID").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.repartitionByRange("customerID").withColumn("part", F.spark_partition_id())
    ahead = F.sum("n").over(Window.partitionBy("part").orderBy("customerID").rowsBetween(Window.unboundedPreceding, -1))
    per = placed.withColumn("range", F.floor(F.coalesce(ahead, F.lit(0)) / rows_per_range)).groupBy("part", "range").agg(
        F.min("customerID").alias("low"), F.max("customerID").alias("high"),
        F.coalesce(F.sum(F.when(F.col("customerID").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.sum("n").alias("n"))
    (prefix_sum(per, ["part", "range"], "n", "before").select("low", "high", "nulls", "n", F.col("before").cast("long").alias("before"))
     .write.mode("overwrite").parquet(path))


def indexed_page(df: DataFrame, index: DataFrame, page_no: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The page of ``page`` without a search, from the one or two id ranges that hold it."""
    at = (max(int(page_no), 1) - 1) * size
    hit = index.where((F.col("before") < at + size) & (F.col("before") + F.col("n") > at)).orderBy("before").collect()
    if not hit:
        return parsed_view(df.limit(0))
    wanted = F.lit(False)
    lows, highs = [r.low for r in hit if r.low is not None], [r.high for r in hit if r.high is not None]
    if lows:
        wanted = F.col("customerID").between(min(lows), max(highs))
    if any(r.nulls for r in hit):
        wanted = wanted | F.col("customerID").isNull()
    rows = df.where(wanted).orderBy(*_order(df)).offset(at - hit[0].before).limit(size)
    return parsed_view(rows)


def index_stats(index: DataFrame, page_no: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """P3 of the whole list, from the index alone."""
    return _stats(index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count")), page_no, size)


def page_stats(df: DataFrame, page_no: int = 1, term: str | None = None,
               size: int = PAGE_SIZE) -> DataFrame:
    """Total matches, page count, 1-based first and last index shown."""
    return _stats(search(df, term).agg(F.count(F.lit(1)).alias("total_count")), page_no, size)


def _stats(counted: DataFrame, page_no: int, size: int) -> DataFrame:
    p = max(int(page_no), 1)
    total = F.col("total_count")
    return counted.select(
        "total_count",
        F.ceil(total / size).cast("long").alias("total_pages"),
        F.lit((p - 1) * size + 1).cast("long").alias("start_index"),
        F.least(F.lit(p * size).cast("long"), total).alias("end_index"))


def _u(seed: Column, salt: str) -> Column:
    """Uniform [0, 1) from md5(seed:salt) — reproducible in any SQL engine."""
    h = F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":" + salt))), 1, 8), 16, 10)
    return h.cast("double") / float(2 ** 32)


def _choice(seed: Column, salt: str, options: list[str]) -> Column:
    idx = F.floor(_u(seed, salt) * len(options)).cast("int")
    expr = None
    for i, o in enumerate(options):
        expr = F.when(idx == i, F.lit(o)) if expr is None else expr.when(idx == i, F.lit(o))
    return expr


def generate_customers(seeds: DataFrame, seed_col: str = "customerID") -> DataFrame:
    """P5: one synthetic customer per seed row (21 columns).

    Same rules as the dashboard generator — uniform choices, internet add-ons
    only with internet, extra lines only with phone, 30 % seniors, tenure
    0-72, charge 18-120, total = max(0, charge * tenure + noise), 27 % churn —
    but driven by per-column hashes of the seed so that it is deterministic,
    parallel (no driver loop) and reproducible elsewhere."""
    s = F.col(seed_col)
    num = (F.floor(_u(s, "id") * 90000) + 10000).cast("int").cast("string")
    k = F.conv(F.substring(F.md5(F.concat(s.cast("string"), F.lit(":letters"))), 1, 8), 16, 10) \
         .cast("long")
    letters = F.concat(*[F.char((k / F.lit(26 ** i)).cast("long") % 26 + 65) for i in range(5)])
    phone = _choice(s, "phone", YES_NO)
    inet = _choice(s, "internet", INTERNET_SERVICES)
    tenure = F.floor(_u(s, "tenure") * (TENURE_MAX + 1)).cast("int")
    charge = F.round(F.lit(CHARGE_MIN) + _u(s, "charge") * (CHARGE_MAX - CHARGE_MIN), 2)
    noise = F.round(F.lit(NOISE_MIN) + _u(s, "noise") * (NOISE_MAX - NOISE_MIN), 2)

    def addon(name):
        return F.when(inet == "No", F.lit("No internet service")).otherwise(_choice(s, name, YES_NO))

    return seeds.select(
        F.concat(num, F.lit("-"), letters).alias("customerID"),
        _choice(s, "gender", GENDERS).alias("gender"),
        F.when(_u(s, "senior") * 100 < SENIOR_PERCENT, 1).otherwise(0).alias("SeniorCitizen"),
        _choice(s, "partner", YES_NO).alias("Partner"),
        _choice(s, "dependents", YES_NO).alias("Dependents"),
        tenure.alias("tenure"),
        phone.alias("PhoneService"),
        F.when(phone == "No", F.lit("No phone service")).otherwise(_choice(s, "lines", YES_NO))
         .alias("MultipleLines"),
        inet.alias("InternetService"),
        *[addon(n).alias(n) for n in ("OnlineSecurity", "OnlineBackup", "DeviceProtection",
                                       "TechSupport", "StreamingTV", "StreamingMovies")],
        _choice(s, "contract", CONTRACTS).alias("Contract"),
        _choice(s, "paperless", YES_NO).alias("PaperlessBilling"),
        _choice(s, "payment", PAYMENT_METHODS).alias("PaymentMethod"),
        charge.alias("MonthlyCharges"),
        F.round(F.greatest(F.lit(0.0), charge * tenure + noise), 2).alias("TotalCharges"),
        F.when(_u(s, "churn") * 100 < CHURN_PERCENT, "Yes").otherwise("No").alias("Churn"),
    )


def generate(spark, n: int, start: int = 0) -> DataFrame:
    """P5 convenience: ``n`` customers seeded by ``spark.range`` ids (parallel)."""
    return generate_customers(spark.range(start, start + n).withColumnRenamed("id", "seed"), "seed")


def append_customers(df: DataFrame, path: str) -> None:
    """IO7: append a batch of customers to the base table's files."""
    df.write.mode("append").parquet(path)
