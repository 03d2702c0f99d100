"""Sheets for people: one order over everything, dense numbers, what is recent; numbered without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.session import spill


def numbered(rows: DataFrame, order: Sequence[Column], *, start: int = 1, name: str = "row_number") -> DataFrame:
    """Rows with dense numbers in an order that no two rows share, wherever the rows lie.

    The rows are put in ranges of the order and sorted there; a range's first number is the count of
    the rows in the ranges before it, so only one count a range comes together.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number of a row within its range is the low part of this; the range is the high part.
    ids = spill(placed.withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ids.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row a range: as many as there are shuffle partitions.
    before = counts.alias("a").join(counts.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy(F.col("a.__part").alias("__part")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    out = ids.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + place + start).drop("__id", "__part", "__before")


def numbered_within(rows: DataFrame, group: str, order: Sequence[Column], *, start: int = 1, name: str = "row_number") -> DataFrame:
    """Rows with dense numbers in each group; a group with a tenth of all rows is sorted in as many ranges as it fills."""
    every = numbered(rows, [F.col(group).asc_nulls_first(), *order], start=0, name="__all")
    first = every.groupBy(group).agg(F.min("__all").alias("__first")).withColumnRenamed(group, "__group")
    both = every.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return both.withColumn(name, F.col("__all") - F.col("__first") + start).drop("__all", "__first", "__group")


def recent(rows: DataFrame, column: str, n: int = 2) -> DataFrame:
    """Rows with is_recent: whether their value is one of the ``n`` latest."""
    latest = rows.select(F.col(column).alias("__v")).distinct().orderBy(F.desc("__v")).limit(n).withColumn("is_recent", F.lit(True))
    both = rows.join(F.broadcast(latest), F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")
    return both.withColumn("is_recent", F.coalesce("is_recent", F.lit(False)))


def review_sheet(jobs: DataFrame) -> DataFrame:
    """Best score first, unscored last, then by source, latest first; row numbers from 2, as row 1 is the header."""
    order = [F.coalesce("score", F.lit(-1)).desc(), F.lower("source_name"), F.desc("first_seen"), F.col("source_name"), F.col("dedupe_key")]
    return recent(numbered(jobs, order, start=2), "first_seen")


def archive_sheet(jobs: DataFrame) -> DataFrame:
    """Latest first, then by source; row numbers from 2."""
    return numbered(jobs, [F.desc("first_seen"), F.lower("source_name"), F.col("source_name"), F.col("dedupe_key")], start=2)


def write_sheet(sheet: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A sheet as CSV files in the order of its numbers, with a header in the first of each."""
    sheet.repartitionByRange("row_number").sortWithinPartitions("row_number").select(*columns).write.mode("overwrite").option("header", True).csv(path)
