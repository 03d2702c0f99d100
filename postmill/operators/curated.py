"""Curated lists of boards: what is banned, what is a candidate; checks of entries and of changes to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import fold_case, strip_or_empty
from postmill.operators.identity import board_identity


def is_date(c: Column | str) -> Column:
    """Whether text is a day as YYYY-MM-DD; false for null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & x.try_cast("date").isNotNull(), F.lit(False))


def faults(entries: DataFrame, *, required: tuple[str, ...], dates: tuple[str, ...] = ()) -> DataFrame:
    """Entries with what is wrong with them, as a list: an empty required field, a date that is none, a link that is none."""
    wrong = [F.when(strip_or_empty(c) == "", F.lit(f"{c} is empty")) for c in required]
    wrong += [F.when((strip_or_empty(c) != "") & ~is_date(c), F.lit(f"{c} is no date")) for c in dates]
    wrong.append(F.when(board_identity("url").isNull(), F.lit("url is no link")))
    return entries.withColumn("faults", F.array_compact(F.array(*wrong))).where(F.size("faults") > 0)


def on_list(sources: DataFrame, entries: DataFrame, *, ordinal: str = "ordinal") -> DataFrame:
    """(source_name, organisation, reason) of the sources whose board is on a list; of several entries for a board the first counts."""
    board = board_identity("url")
    first = entries.withColumn("board", board).where("board IS NOT NULL").groupBy("board").agg(F.min_by(F.struct("organisation", "reason"), ordinal).alias("e"))
    mine = sources.select("source_name", board.alias("board")).where("board IS NOT NULL")
    return mine.join(first, "board").select("source_name", "e.organisation", F.trim(F.regexp_replace(F.coalesce("e.reason", F.lit("")), r"(?U)\s+", " ")).alias("reason"))


def matches(rows: DataFrame, asked: str, *, names: tuple[str, ...]) -> DataFrame:
    """Rows whose board is the one asked for, or one of whose names holds it, whatever the case."""
    same = F.coalesce(board_identity("url") == board_identity(F.lit(asked)), F.lit(False))
    needle = fold_case(F.trim(F.lit(asked)))
    named = reduce(lambda a, b: a | b, [F.contains(fold_case(F.coalesce(F.col(c), F.lit(""))), needle) for c in names])
    return rows.where(same | ((needle != "") & named))


def refused(entries: DataFrame, new: DataFrame) -> DataFrame:
    """New entries that clash with the list, with why: the same board, or else the same organisation."""
    known = entries.select(board_identity("url").alias("board"), fold_case(F.trim("organisation")).alias("who"))
    mine = new.withColumn("board", board_identity("url")).withColumn("who", fold_case(F.trim("organisation")))
    b = mine.join(known.select("board").where("board IS NOT NULL").distinct().withColumn("has_board", F.lit(True)), "board", "left")
    both = b.join(known.select("who").distinct().withColumn("has_who", F.lit(True)), "who", "left")
    why = F.when(F.col("has_board"), "board").when(F.col("has_who"), "organisation")
    return both.withColumn("why", why).where("why IS NOT NULL").select(*new.columns, "why")


def filled(entries: DataFrame, fills: DataFrame, fields: tuple[str, ...], *, key: str = "organisation", record: str = "source_of_record") -> DataFrame:
    """The list with empty fields filled from ``fills``; ``record`` is extended after "; ".

    All or nothing: a fill for a field that already has a value ends the query when it is read.
    """
    told = [c for c in (*fields, record) if c in fills.columns]
    new = fills.select(key, *[F.col(c).alias(f"new_{c}") for c in told])
    both = entries.join(new, key, "left")

    def put(c: str) -> Column:
        old, value = F.col(c), F.col(f"new_{c}")
        given = strip_or_empty(value) != ""
        if c == record:
            return F.when(given & (strip_or_empty(old) != ""), F.concat(old, F.lit("; "), F.trim(value))).when(given, F.trim(value)).otherwise(old)
        return F.when(given & (strip_or_empty(old) != ""), F.raise_error(F.concat(F.lit(f"{c} is already set for "), F.col(key)))).when(given, F.trim(value)).otherwise(old)

    return both.select(*[put(c).alias(c) if c in told else F.col(c) for c in entries.columns])


def older_checks(entries: DataFrame, checks: DataFrame, *, key: str = "organisation", date: str = "last_checked") -> DataFrame:
    """Checks dated before the one that the list holds: those are refused."""
    both = checks.select(key, F.col(date).alias("new")).join(entries.select(key, F.col(date).alias("old")), key)
    return both.where((strip_or_empty("old") != "") & (F.col("new") < F.col("old")))
