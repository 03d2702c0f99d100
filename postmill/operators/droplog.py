"""The log of what a run dropped, rung by rung: record, search, count, prune, and the funnel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import fold_case
from postmill.operators.store import kept_runs

# The stored names of the rungs in the order they run, with the names shown. Logs are searched by the stored
# names, so these stay as they are.
LADDER = (
    ("0-rules", "Location and rules"), ("1a-title-keyword", "Title keywords"), ("1-seniority", "Seniority"), ("1d-review-status", "Review status"), ("2-detail", "Detail page"),
)
# Fixed value: what stands before the name of a rung when stored postings are filtered again.
AGAIN = "refilter/"
# The columns of a logged drop, in the order of the export.
FIELDS = ("run_id", "dedupe_key", "title", "company", "source_name", "location", "layer", "rule", "excluded_at")


def exclusions(rows: DataFrame, *, run_id: int | Column, at: str | Column, layer: str | Column, rule: Column) -> DataFrame:
    """Rows of the log, one for each dropped posting; columns that ``rows`` lacks are empty."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in ("dedupe_key", "title", "company", "source_name", "location")}
    made = text | {"run_id": lit(run_id).cast("bigint"), "layer": lit(layer), "rule": rule, "excluded_at": lit(at)}
    return rows.select(*[made[c].alias(c) for c in FIELDS])


def all_drops(*parts: DataFrame) -> DataFrame:
    """The drops of all rungs under one another."""
    return reduce(DataFrame.unionByName, parts)


def record(log: DataFrame, path: str) -> None:
    """Append a run's drops to the log, a folder for each run; a run that is recorded again replaces itself."""
    log.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def export_csv(log: DataFrame, path: str) -> None:
    """The log as CSV files with a header, in the order of FIELDS."""
    log.select(*FIELDS).write.mode("overwrite").option("header", True).csv(path)


def again(layer: Column | str) -> Column:
    """Whether a drop is one of stored postings that were filtered again."""
    return F.startswith(F.col(layer) if isinstance(layer, str) else layer, F.lit(AGAIN))


def rung(layer: Column | str) -> Column:
    """The number of a rung, from 1; one more than there are for a name no longer in use."""
    c = F.regexp_replace(layer, f"^{AGAIN}", "")
    return reduce(lambda w, x: w.when(c == x[1][0], x[0]), enumerate(LADDER, 1), F.when(F.lit(False), 0)).otherwise(len(LADDER) + 1)


def shown(layer: Column | str) -> Column:
    """How a rung is shown: "Layer 2: Title keywords", with "(re-filter)" or "(retired)" where that holds."""
    c = F.col(layer) if isinstance(layer, str) else layer
    names = F.array(*[F.lit(f"Layer {i}: {name}") for i, (_, name) in enumerate(LADDER, 1)])
    label = F.concat(F.get(names, rung(c) - 1), F.when(again(c), " (re-filter)").otherwise(""))
    return F.coalesce(label, F.concat(c, F.lit(" (retired)")))


def layer_argument(value: str) -> str | None:
    """Why a search argument cannot mean a stored rung: a bare number is one that is shown; null when it can."""
    typed = value.strip()
    if not (typed.isascii() and typed.isdigit()):
        return None
    n = int(typed)
    if not 1 <= n <= len(LADDER):
        return f"{typed} is a number as shown, and there is no rung {n}: they go from 1 to {len(LADDER)}"
    return f"{typed} is a number as shown; rung {n} is stored as {LADDER[n - 1][0]!r}"


def rule_counts(log: DataFrame) -> DataFrame:
    """(layer, rule, n), most frequent first; ties in the order of the ladder, scraped before filtered again, then by rule."""
    counts = log.groupBy("layer", "rule").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), rung("layer"), again("layer"), "layer", "rule")


def search(log: DataFrame, run_id: int, **parts: str) -> DataFrame:
    """The drops of a run whose columns hold these parts, whatever the case, by layer, rule, source and title.

    A part is taken as it stands: % and _ are signs like others.
    """
    rows = log.where(F.col("run_id") == run_id)
    for column, part in parts.items():
        rows = rows.where(F.contains(fold_case(F.coalesce(column, F.lit(""))), fold_case(F.lit(part))))
    return rows.orderBy("layer", "rule", "source_name", "title", "dedupe_key")


def latest_run(log: DataFrame, runs: DataFrame, kind: str = "scrape") -> DataFrame:
    """One row, the last run of a kind that logged a drop; null when there is none."""
    return runs.where(F.col("kind") == kind).join(log.select("run_id").distinct(), "run_id", "left_semi").agg(F.max("run_id").alias("run_id"))


def prune(log: DataFrame, runs: DataFrame, last: int) -> DataFrame:
    """The log without the runs before the ``last`` scrapes that logged anything."""
    return log.join(kept_runs(runs, log, last).select("run_id"), "run_id", "left_semi")


def funnel(health: DataFrame, log: DataFrame) -> DataFrame:
    """(run_id, layer, reached, dropped, remaining) for each run and rung: what reached it and what it left.

    The first rung is reached by the rows of all sources that the run read well. Drops of stored
    postings that were filtered again are left out.
    """
    seen = health.where("ok").groupBy("run_id").agg(F.sum("rows_found").alias("seen"))
    drops = log.where(~again("layer")).groupBy("run_id", "layer").agg(F.count("*").alias("dropped"))
    spark = health.sparkSession
    ladder = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LADDER, 1)], "layer_no int, layer string")
    grid = seen.join(F.broadcast(ladder))  # as many rows as runs and rungs
    both = grid.join(drops, ["run_id", "layer"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))
    # A run has as many rows as the ladder, so the higher-order sum stays small.
    per_run = both.groupBy("run_id", "seen").agg(F.array_sort(F.collect_list(F.struct("layer_no", "layer", "dropped"))).alias("d"))
    upto = lambda i: F.aggregate(F.slice("d", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["dropped"])
    rows = per_run.select("run_id", "seen", "d", F.posexplode("d").alias("i", "x"))
    return rows.select(
        "run_id", "x.layer", (F.col("seen") - upto(F.col("i"))).alias("reached"), F.col("x.dropped").alias("dropped"), (F.col("seen") - upto(F.col("i") + 1)).alias("remaining")
    )


def counts_by_cause(rows: DataFrame, causes: tuple[str, ...], *, source: str = "source_name", cause: str = "cause") -> DataFrame:
    """Per source how many rows have each of the causes, in their order, and how many in all."""
    return rows.groupBy(source).agg(*[F.count_if(F.col(cause) == c).alias(c) for c in causes], F.count("*").alias("rows"))


def clipped(c: Column | str, width: int) -> Column:
    """Text on one line, cut to ``width`` characters with an ellipsis as the last."""
    one = F.trim(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(one) <= width, one).otherwise(F.concat(F.substring(one, 1, width - 1), F.lit("…")))
