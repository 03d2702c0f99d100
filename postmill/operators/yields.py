"""What a source gives over the logged runs, whether its drops say anything, and whether a run's figures add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.droplog import LADDER, again
from postmill.operators.matchers import value_kind

# From which share of its first-rung drops a kind of location value starves a source, on how many postings one
# value is a constant, and how many good runs make a source old enough to judge.
STARVED_SHARE, CONSTANT_POSTINGS, MIN_RUNS = 0.25, 5, 5
# Kinds of location values that name no place, the rule that says a place is not wanted, and what tells later drops apart.
VAGUE = ("empty", "placeholder", "label", "grade", "title")
UNLISTED = "locations: city not on the list"
SETTLED = ("location:", "hybrid:")
UNREAD = "could not read the description"
FIRST = LADDER[0][0]


def window_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The scrapes that the log still holds."""
    return runs.where("kind = 'scrape'").join(log.select("run_id").distinct(), "run_id", "left_semi").select("run_id")


def source_counters(sources: DataFrame, health: DataFrame, log: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per configured source: good runs, rows seen, drops, kinds of dropped locations, and what is stored.

    Three aggregates of one row per source, joined onto the sources; a source without rows stays at
    zero, one that is not configured is left out.
    """
    window = window_runs(log, runs).withColumn("inside", F.lit(True))
    h = health.where("ok").join(window, "run_id", "left")
    seen = h.groupBy("source_name").agg(F.count("*").alias("health_runs"), F.count_if(F.col("inside")).alias("window_runs"), F.sum(F.when(F.col("inside"), F.col("rows_found"))).alias("seen"))
    drops = log.where(~again("layer")).join(window, "run_id", "left_semi").withColumn("kind", value_kind("location", "title"))
    first = F.col("layer") == FIRST
    place = F.when(first, F.coalesce("location", F.lit("")))
    who = F.coalesce(F.nullif(F.col("dedupe_key"), F.lit("")), F.col("title"), F.lit(""))
    later = F.col("layer").isin([x[0] for x in LADDER[1:]])
    settled = (F.col("layer") == LADDER[-1][0]) & (F.col("rule").startswith(SETTLED[0]) | F.col("rule").startswith(SETTLED[1]))
    dropped = drops.groupBy("source_name").agg(
        F.count("*").alias("log_rows"), F.count_if(first).alias("first_drops"), F.count_if(later).alias("later_drops"), F.count_if(settled).alias("settled"),
        *[F.count_if(first & (F.col("kind") == k)).alias(k) for k in VAGUE],
        F.count_distinct(place).alias("values"), F.count_distinct(F.when(first, F.col("rule"))).alias("rules"), F.max(F.when(first, F.col("rule"))).alias("rule"),
        F.count_distinct(F.when(first, who)).alias("postings"),
    )
    stored = jobs.groupBy("source_name").agg(F.count("*").alias("stored"), F.max(F.substring("first_seen", 1, 10)).alias("last_stored"))
    out = sources.select("source_name").join(seen, "source_name", "left").join(dropped, "source_name", "left").join(stored, "source_name", "left")
    numbers = [c for c in out.columns if c not in ("source_name", "rule", "last_stored")]
    out = out.fillna(0, numbers).withColumn("passes", F.col("seen") - F.col("first_drops"))
    return out.withColumn("constant_postings", F.when(F.col("values") == 1, F.col("postings")).otherwise(0)).drop("postings")


def starved(y: DataFrame) -> Column:
    """Why the first-rung drops of a source say nothing about where its postings are: a list, empty when they do."""
    kinds = [F.when((F.col(k) > 0) & (F.col(k) >= STARVED_SHARE * F.col("first_drops")), F.format_string(f"{k} on %d of %d drops", F.col(k), F.col("first_drops"))) for k in VAGUE]
    constant = F.when((F.col("values") == 1) & (F.col("constant_postings") >= CONSTANT_POSTINGS), F.format_string("one value on all %d postings", F.col("constant_postings")))
    one_rule = F.when((F.col("rules") == 1) & (F.col("rule") != UNLISTED), F.concat(F.lit("every drop by "), F.col("rule")))
    nothing = F.array(F.lit("nothing listed in the window"))
    found = F.array_compact(F.array(*kinds, constant, one_rule))
    return F.when((F.col("window_runs") > 0) & (F.col("seen") == 0), nothing).when(F.col("first_drops") == 0, F.array().cast("array<string>")).otherwise(found)


def yield_class(y: DataFrame, min_runs: int = MIN_RUNS) -> DataFrame:
    """Counters with signs (what starves the source) and class: A gives, C is starved, D is too new to say, B is elsewhere; the first that fits."""
    signs = y.withColumn("signs", starved(y))
    c = F.when((F.col("passes") > 0) | (F.col("stored") > 0), "A").when(F.size("signs") > 0, "C").when(F.col("window_runs") < min_runs, "D").otherwise("B")
    return signs.withColumn("class", c)


def run_gaps(health: DataFrame, log: DataFrame) -> DataFrame:
    """(run_id, source_name, rows_found, drops, gap): sources whose drops in a run do not fit the rows it read.

    gap is "not read" for drops of a source that the run did not read well, "more drops than rows"
    for more first-rung drops than rows. No rows means the figures add up.
    """
    found = health.where("ok").select("run_id", "source_name", "rows_found")
    first = F.count_if(F.col("layer") == FIRST).alias("first")
    drops = log.where(~again("layer")).groupBy("run_id", "source_name").agg(F.count("*").alias("all"), first)
    both = drops.join(found, ["run_id", "source_name"], "left")
    gap = F.when(F.col("rows_found").isNull(), "not read").when(F.col("first") > F.col("rows_found"), "more drops than rows")
    n = F.when(F.col("rows_found").isNull(), F.col("all")).otherwise(F.col("first"))
    return both.select("run_id", "source_name", "rows_found", n.alias("drops"), gap.alias("gap")).where("gap IS NOT NULL")


def run_balance(health: DataFrame, log: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per run: seen, first_drops, passes, title_drops, held_back, sighted (postings last seen in it) and the residual of the passes.

    A posting listed twice or without a key is counted in the rows but stored once, which leaves a
    residual; only for the latest run does ``sighted`` still say what it stored.
    """
    seen = health.where("ok").groupBy("run_id").agg(F.sum("rows_found").alias("seen"))
    titles = F.col("layer").isin(LADDER[1][0], LADDER[2][0])
    drops = log.where(~again("layer")).groupBy("run_id").agg(
        F.count_if(F.col("layer") == FIRST).alias("first_drops"), F.count_if(titles).alias("title_drops"), F.count_if(F.contains("rule", F.lit(UNREAD))).alias("held_back")
    )
    sighted = jobs.groupBy(F.col("last_run_id").alias("run_id")).agg(F.count("*").alias("sighted"))
    out = seen.join(drops, "run_id", "left").join(sighted, "run_id", "left").fillna(0).withColumn("passes", F.col("seen") - F.col("first_drops"))
    return out.withColumn("residual", F.col("passes") - F.col("title_drops") - F.col("held_back") - F.col("sighted"))
