"""Changes between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import instant_us, strip, strip_or_empty


def canonical_key(c: Column | str) -> Column:
    """A key without white space at its ends and with http:// read as https://."""
    k = strip(c)
    return F.when(k.startswith("http://"), F.concat(F.lit("https://"), F.substr(k, F.lit(8)))).otherwise(k)


def snapshot_changes(
    df: DataFrame,
    *,
    snapshot: str = "run_id",
    key: str = "dedupe_key",
    fields: Sequence[str] = ("title", "location", "status", "experience_level", "misses", "description_sha256"),
    recency: str = "last_seen",
) -> DataFrame:
    """Rows (snapshot, key, change) with change in added, removed and changed.

    Snapshots are numbered in the order of ``snapshot``; each key's states are windowed by that
    number. A lagged hash of ``fields`` (trimmed, null as empty) that differs is a change; a gap in
    the numbers is a removal in the snapshot after the gap's start and an addition at its end.
    The first snapshot gives no rows.

    * A key that comes more than once in a snapshot counts with its latest ``recency`` as an
      instant; unreadable instants are oldest. Full ties go to the greater content hash.
    * Rows with a null snapshot or null key are left out: no snapshot or record can be named.
    * An empty key is a key. An empty table gives no rows. Other columns are ignored, so
      columns of any further name cannot clash.

    The many rows of a hot key are combined per task before the shuffle; after it a key has at most
    one row per snapshot. Two shuffles: by key and snapshot (combined), then by key.
    """
    content = F.xxhash64(*[strip_or_empty(F.col(f).cast("string")) for f in fields])
    seen = F.coalesce(instant_us(F.col(recency).cast("string")), F.lit(-(1 << 63)))
    rows = df.select(F.col(snapshot).alias("__s"), canonical_key(key).alias("__k"), content.alias("__h"), seen.alias("__t"))
    rows = rows.where(F.col("__s").isNotNull() & F.col("__k").isNotNull())
    # The hash breaks ties, so that the choice does not hang on task order.
    states = rows.groupBy("__k", "__s").agg(F.max(F.struct("__t", "__h")).alias("__m")).select("__k", "__s", F.col("__m.__h").alias("__h"))

    # One row per snapshot, each a delivery of the whole table: so few that one task can number them and all can hold them.
    ids = df.select(F.col(snapshot).alias("__r")).where(F.col("__r").isNotNull()).distinct()
    order_of_runs = Window.orderBy("__r")
    index = ids.select("__r", F.row_number().over(order_of_runs).alias("__i"), F.lead("__r").over(order_of_runs).alias("__next"))
    numbered = states.join(F.broadcast(index), F.col("__s") == F.col("__r"))
    w = Window.partitionBy("__k").orderBy("__i")
    marked = numbered.select(
        "__k", "__s", "__i", "__next", F.lag("__i").over(w).alias("__b"), F.lead("__i").over(w).alias("__a"), (F.lag("__h").over(w) != F.col("__h")).alias("__d")
    )
    added = (F.col("__i") > 1) & (F.col("__b").isNull() | (F.col("__b") < F.col("__i") - 1))
    changed = (F.col("__b") == F.col("__i") - 1) & F.col("__d")
    removed = F.col("__next").isNotNull() & (F.col("__a").isNull() | (F.col("__a") > F.col("__i") + 1))

    def event(when: Column, at: str, what: str) -> Column:
        return F.when(when, F.struct(F.col(at).alias("s"), F.lit(what).alias("c")))

    events = F.array_compact(F.array(event(added, "__s", "added"), event(changed, "__s", "changed"), event(removed, "__next", "removed")))
    return marked.select("__k", F.explode(events).alias("e")).select(
        F.col("e.s").alias(snapshot), F.col("__k").alias(key), F.col("e.c").alias("change")
    )
