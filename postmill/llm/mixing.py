"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash; a source gives its documents below a threshold. Tokens are summed by
source and hash bucket, the bucket in which the budget ends is found, and only that bucket is looked
at more finely. The selection is a filter; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.session import spill

BITS = 10  # each level splits a bucket into 1024
LEVELS = 4
ROUNDS = 4  # how often what a document too large for the rest leaves open is filled from those after it
CLOSE = 0.005  # share of a budget that may stay open without another round


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", size: str = "n_tokens", total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Selections and shares for every mix.

    ``docs`` has the key, source and size (count it once and write it down: it is read several
    times); ``targets`` has mix, source, target_share and max_repeats. The selection has (mix, key,
    source, uses): the document is used that often in all, at most max_repeats times. The shares
    have (mix, source, target_share, adjusted_share, tokens, actual_share, repeats), one row per
    target; repeats is how often the source's tokens are used on average.

    The total of a mix is ``total`` or else the largest at which every source with documents can
    give its share. A source without documents gives nothing; adjusted_share is the target among
    those that have some, and what the shares reached are measured by.

    * A null or non-positive share gives 0, max_repeats under 1 or null no use. Documents without a
      source or with no tokens are never chosen. A mix whose sources are all empty has no selection
      and its shares are null. Repeated target rows of one mix and source are added up, with the
      larger max_repeats. Ties of hashes (rows with one key) are taken or left together.
    * The documents of a source are taken in the order of their hashes, whatever their sizes, up to the first that is
      larger than what is still owed. What is open then is filled from those after it that are not, and so on for ROUNDS
      rounds or until CLOSE is reached. So a large document is left out only where it does not fit any more, and no source
      is over its budget; one whose documents are all larger than it gives none.

    A source with a third of all rows is one sum per task and bucket before the shuffle, and of its
    rows only those of the boundary bucket are looked at again.
    """
    t = targets.groupBy("mix", "source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats")
    )
    have = docs.where(F.col("source").isNotNull() & (F.col(size) > 0)).select(
        F.col(key).alias("k"), F.col("source").alias("s"), F.col(size).alias("n"), F.xxhash64(key, F.lit("mix")).alias("h")
    )
    stock = have.groupBy("s").agg(F.sum("n").alias("stock"))
    w = Window.partitionBy("mix")
    usable = (F.coalesce("stock", F.lit(0)) > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    t = t.join(stock, F.col("source") == F.col("s"), "left").drop("s").withColumn("usable", usable)
    t = t.withColumn("adjusted_share", F.when(F.col("usable"), F.try_divide("target_share", F.sum(F.when(F.col("usable"), F.col("target_share"))).over(w))).otherwise(0.0))
    reach = F.when(F.col("usable"), F.col("max_repeats") * F.col("stock") / F.col("adjusted_share"))
    most = F.min(reach).over(w)
    t = t.withColumn("total", most if total is None else F.lit(float(total)))
    budget = F.least(F.floor(F.col("adjusted_share") * F.col("total") + 1e-6), F.col("max_repeats") * F.col("stock")).cast("bigint")
    t = t.withColumn("budget", F.when(F.col("usable"), budget).otherwise(0))
    # Whole passes over the source, and what is left for a part of it.
    t = t.withColumn("passes", F.when(F.col("usable"), F.floor(F.col("budget") / F.col("stock"))).otherwise(0).cast("int"))
    t = t.withColumn("rest", F.when(F.col("usable"), F.col("budget") - F.col("passes") * F.col("stock")).otherwise(0))

    t = spill(t)
    # As long as the list of targets, which is checked before it is sent to the tasks.
    sent = (lambda d: d) if t.count() > 100_000 else F.broadcast
    owed = t.where(F.col("rest") > 0).select("mix", F.col("source").alias("ps"), "rest")

    top = BITS * LEVELS
    place = F.shiftrightunsigned("h", 64 - top)

    def boundary(edge: DataFrame) -> DataFrame:
        """Level by level the bucket in which what is left of (em, es, left, lo, most) ends: (em, es, left, at, after).

        Documents count from place lo on if they are no larger than most; those before ``at`` fit and leave
        ``left``, the bucket ends before ``after``. A source that fits whole has no row.
        """
        out = None
        edge = edge.withColumn("prefix", F.lit(0).cast("bigint")).withColumn("owed", F.col("left"))
        for level in range(1, LEVELS + 1):
            shift = 64 - BITS * level
            inside = F.lit(True) if level == 1 else F.shiftrightunsigned("h", shift + BITS) == F.col("prefix")
            here = have.join(sent(edge), (F.col("s") == F.col("es")) & inside & (place >= F.col("lo")) & (F.col("n") <= F.col("most")))
            hist = here.groupBy("em", "es", "left", "lo", "most", F.shiftrightunsigned("h", shift).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("c"))
            run = Window.partitionBy("em", "es").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            hist = hist.withColumn("upto", F.sum("n").over(run)).where(F.col("upto") > F.col("left"))
            first = F.min_by(F.struct("b", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "lo", "most", "n", "c"), "b").alias("e")
            found = spill(hist.groupBy("em", "es").agg(first).select("em", "es", "e.*"))
            # A bucket of one document needs no finer look.
            done = (F.col("c") == 1) | F.lit(level == LEVELS)
            at, after = (F.shiftleft(F.col("b") + k, top - BITS * level) for k in (0, 1))
            part = found.where(done).select("em", "es", "left", at.alias("at"), after.alias("after"))
            out = part if out is None else out.unionByName(part)
            edge = found.where(~done).select("em", "es", "left", "lo", "most", F.col("b").alias("prefix"))
            if level < LEVELS and edge.isEmpty():
                break
        return out

    edge = owed.select(F.col("mix").alias("em"), F.col("ps").alias("es"), F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("lo"), F.lit((1 << 62)).alias("most"))
    taken = None
    for turn in range(1, ROUNDS + 1):
        b = boundary(edge).withColumnsRenamed({"em": "bm", "es": "bs", "left": "open"})
        both = spill(edge.join(b, (F.col("em") == F.col("bm")) & (F.col("es") == F.col("bs")), "left").drop("bm", "bs"))
        part = both.select("em", "es", "lo", F.coalesce("at", F.lit(1 << top)).alias("hi"), "most")
        taken = part if taken is None else taken.unionByName(part)
        edge = both.select("em", "es", F.col("open").alias("left"), F.col("after").alias("lo"), F.col("open").alias("most"))
        # A source that fits whole has nothing open.
        edge = edge.join(owed.select(F.col("mix").alias("om"), F.col("ps").alias("os"), "rest"), (F.col("em") == F.col("om")) & (F.col("es") == F.col("os")))
        edge = spill(edge.where(F.col("left") > CLOSE * F.col("rest")).select("em", "es", "left", "lo", "most"))
        if turn < ROUNDS and edge.isEmpty():
            break
    # One range of places for each round, so at most ROUNDS a target.
    ranges = taken.groupBy(F.col("em").alias("lm"), F.col("es").alias("ls")).agg(F.collect_list(F.struct("lo", "hi", "most")).alias("ranges"))
    plan = t.where(F.col("usable")).select("mix", F.col("source").alias("ps"), "passes")
    plan = plan.join(ranges, (F.col("mix") == F.col("lm")) & (F.col("ps") == F.col("ls")), "left").select("mix", "ps", "passes", "ranges")
    chosen = have.join(sent(plan), F.col("s") == F.col("ps"))
    part = F.coalesce(F.exists("ranges", lambda r: (place >= r["lo"]) & (place < r["hi"]) & (F.col("n") <= r["most"])), F.lit(False))
    chosen = chosen.withColumn("uses", F.col("passes") + part.cast("int")).where("uses > 0")
    selection = chosen.select("mix", F.col("k").alias(key), F.col("s").alias("source"), "uses", F.col("n").alias(size))

    used = chosen.groupBy(F.col("mix").alias("um"), F.col("s").alias("us")).agg(F.sum(F.col("uses") * F.col("n")).alias("tokens"))
    shares = t.join(used, (F.col("mix") == F.col("um")) & (F.col("source") == F.col("us")), "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    shares = shares.select(
        "mix", "source", "target_share", "adjusted_share", "tokens",
        F.try_divide(F.col("tokens"), F.sum("tokens").over(w)).alias("actual_share"),
        F.coalesce(F.try_divide(F.col("tokens"), F.col("stock")), F.lit(0.0)).alias("repeats"),
    )
    return selection, shares
