"""Evaluation of rules against labels, and counts of what they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_beta(precision: Column, recall: Column, beta: float = 2.0) -> Column:
    """F-beta; 0 where both are 0, null where one is not defined."""
    b2 = beta * beta
    return F.when((precision == 0) & (recall == 0), 0.0).otherwise(F.try_divide((1 + b2) * precision * recall, b2 * precision + recall))


def confusion(verdicts: DataFrame, *, wanted: str = "wanted", kept: str = "kept") -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall and F2; ratios are null where not defined."""
    w, k = F.col(wanted), F.col(kept)
    c = verdicts.agg(F.count_if(w & k).alias("tp"), F.count_if(~w & k).alias("fp"), F.count_if(w & ~k).alias("fn"), F.count_if(~w & ~k).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f_beta(p, r), 6).alias("f2"))


def layer_report(verdicts: DataFrame, layers: int) -> DataFrame:
    """Per layer 1..layers: how many reached it, were dropped by it, and how many of these were wanted."""
    return layer_confusion(verdicts, layers).select("layer", "reached", "dropped", "wanted_lost")


def layer_confusion(verdicts: DataFrame, layers: int) -> DataFrame:
    """Per layer 1..layers: what reached it, what it dropped, how many of these were wanted, and the confusion after it.

    ``verdicts`` has depth (the layer that dropped the row, layers + 1 if none did) and wanted.
    drop_precision is the share of its drops that were not wanted, null without drops.
    """
    counts = verdicts.groupBy("depth").agg(F.count("*").alias("n"), F.count_if("wanted").alias("w"))
    depths = verdicts.sparkSession.range(1, layers + 2).select(F.col("id").cast("int").alias("depth"))
    full = depths.join(counts, "depth", "left").fillna(0)
    # One row per layer, so the window has a handful of rows.
    later = Window.orderBy("depth").rowsBetween(0, Window.unboundedFollowing)
    past, sofar = Window.orderBy("depth").rowsBetween(1, Window.unboundedFollowing), Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    unwanted = F.col("n") - F.col("w")
    report = full.select(
        F.col("depth").alias("layer"), F.sum("n").over(later).alias("reached"), F.col("n").alias("dropped"), F.col("w").alias("wanted_lost"),
        F.coalesce(F.sum("w").over(past), F.lit(0)).alias("tp"), F.coalesce(F.sum(unwanted).over(past), F.lit(0)).alias("fp"),
        F.sum("w").over(sofar).alias("fn"), F.sum(unwanted).over(sofar).alias("tn"),
        F.round(F.try_divide(unwanted, F.col("n")), 6).alias("drop_precision"),
    )
    return report.where(F.col("layer") <= layers)


def rule_counts(drops: DataFrame) -> DataFrame:
    """(layer, rule, n, wanted): what each rule dropped, costliest first within a layer."""
    counts = drops.groupBy("layer", "rule").agg(F.count("*").alias("n"), F.count_if("wanted").alias("wanted"))
    return counts.orderBy("layer", F.desc("wanted"), F.desc("n"), "rule")


def costly_rules(drops: DataFrame) -> DataFrame:
    """(layer, rule, lost, n): the rules that dropped wanted rows, worst first."""
    return rule_counts(drops).where("wanted > 0").select("layer", "rule", F.col("wanted").alias("lost"), "n").orderBy(F.desc("lost"), F.desc("n"), "rule")


def net_effect(before: DataFrame, after: DataFrame, *, key: str, kept: str = "kept", wanted: str = "wanted") -> DataFrame:
    """One row: keys newly kept and newly dropped by ``after``, and how many of each are wanted."""
    both = before.select(key, F.col(kept).alias("b"), wanted).join(after.select(key, F.col(kept).alias("a")), key)
    w, gained, lost = F.col(wanted), F.col("a") & ~F.col("b"), F.col("b") & ~F.col("a")
    return both.agg(F.count_if(gained).alias("newly_kept"), F.count_if(lost).alias("newly_dropped"), F.count_if(gained & w).alias("recovered"), F.count_if(lost & w).alias("newly_lost"))


def changed_verdicts(before: DataFrame, after: DataFrame, *, key: str, kept: str = "kept", wanted: str = "wanted", title: str = "title") -> DataFrame:
    """(key, title, wanted, newly_kept) of the keys that one keeps and the other drops; newly kept first, then the wanted, then by title."""
    both = before.select(key, title, wanted, F.col(kept).alias("b")).join(after.select(key, F.col(kept).alias("a")), key).where("a <> b")
    return both.select(key, title, wanted, F.col("a").alias("newly_kept")).orderBy(F.desc("newly_kept"), F.desc(wanted), title, key)


def unanimous(labels: DataFrame, *, key: str, label: str, ordinal: str) -> DataFrame:
    """Labels with one row per key: the first; keys labelled both ways are left out."""
    g = labels.groupBy(key).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.min(ordinal).alias(ordinal))
    return g.where(F.col("__lo") == F.col("__hi")).select(key, F.col("__lo").alias(label), ordinal)


def verdict_changes(before: DataFrame, after: DataFrame, *, key: str, verdict: str) -> DataFrame:
    """The keys on which two configurations disagree."""
    b, a = before.select(key, F.col(verdict).alias("before")), after.select(key, F.col(verdict).alias("after"))
    return b.join(a, key).where(~F.col("before").eqNullSafe(F.col("after")))
