"""Health of sources over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# How many postings boards put on a page.
PAGE_SIZES = (10, 12, 15, 16, 18, 20, 24, 25, 30, 36, 40, 48, 50, 60, 100)


def regressions(health: DataFrame, *, share: float = 0.5) -> DataFrame:
    """Good runs of a source that lost more than ``share`` of the rows of its last good run before.

    ``health`` has source_name, run_id, rows_found, ok; one row per source and run. A run that lost
    exactly ``share`` is none; nor is the first good run or one after an empty one.
    """
    w = Window.partitionBy("source_name").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("ok"), F.col("rows_found")), ignorenulls=True).over(w)
    return health.withColumn("previous", prev).where(F.col("ok") & (F.col("previous") > 0) & (F.col("rows_found") < F.col("previous") * (1 - share)))


def last_counts(health: DataFrame, n: int, *, run: int | None = None, kind: str | None = None) -> DataFrame:
    """The row counts of the last ``n`` good runs of each source, newest first.

    With ``run`` only runs up to that one count, and only sources that were good in it come out;
    with ``kind`` only runs of that kind (a column of ``health``).
    """
    good = health.where("ok")
    good = good if kind is None else good.where(F.col("kind") == kind)
    if run is not None:
        here = good.where(F.col("run_id") == run).select("source_name").distinct()
        good = good.where(F.col("run_id") <= run).join(here, "source_name", "left_semi")
    w = Window.partitionBy("source_name").orderBy(F.desc("run_id"))
    top = good.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n)
    pairs = F.array_sort(F.collect_list(F.struct("i", "rows_found")))
    return top.groupBy("source_name").agg(pairs.alias("p")).select("source_name", F.transform("p", lambda x: x["rows_found"]).alias("counts"))


def one_page(health: DataFrame, *, n: int = 5, sizes: Sequence[int] = PAGE_SIZES, run: int | None = None, kind: str | None = None) -> DataFrame:
    """Sources whose last ``n`` counts are all equal and of a usual page size: perhaps only one page was read."""
    c = last_counts(health, n, run=run, kind=kind)
    return c.where((F.size("counts") == n) & (F.array_min("counts") == F.array_max("counts")) & F.array_min("counts").isin(list(sizes)))


def empty_sources(health: DataFrame, run: int) -> DataFrame:
    """Sources that a run read without an error and without a row."""
    return health.where((F.col("run_id") == run) & F.col("ok") & (F.col("rows_found") == 0)).select("source_name")


def good_in(health: DataFrame, run: int) -> DataFrame:
    """Sources that a run read well and found rows of: those whose unsighted postings count as missed."""
    return health.where((F.col("run_id") == run) & F.col("ok") & (F.col("rows_found") > 0)).select("source_name").distinct()


def moved_totals(pages: DataFrame, *, source: str = "source_name", order: str = "page", total: str = "total") -> DataFrame:
    """Pages of a walk that state another total than the last page before that stated one: the board moved while it was read."""
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(total, ignorenulls=True).over(w)
    return pages.withColumn("before", before).where(F.col("before").isNotNull() & F.col(total).isNotNull() & (F.col("before") != F.col(total))).select(source, order, "before", total)


def percent_change(before: Column, after: Column) -> Column:
    """Whole percent from one figure to the next; null where the first is 0 or either is null."""
    return F.round(F.try_divide((after - before) * 100, before)).cast("int")


def most_common(rows: DataFrame, value: str, n: int = 0) -> DataFrame:
    """(value, n) of the ``n`` most common values, all for 0; ties in the order of the values."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(value))
    return counts.limit(n) if n else counts


def first_seen_per_walk(rows: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first occurrence of each key in the order of a walk.

    min_by over a struct combines in the map tasks, so a posting repeated on many pages is one row
    before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
