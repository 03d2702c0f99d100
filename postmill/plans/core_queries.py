"""Queries of the core operators on the test tables: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.session import table
from postmill.operators.snapshot_diff import snapshot_changes
from postmill.operators.timestamps import normalise

FEED_TIMES = {"path_feed": "postedOn", "oecd": "releasedDate", "givewell": "updated_at", "coefficient_giving": "publishedAt"}


def feed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four time columns of the feeds under one another, normalised."""
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), "board", "row_id", F.col(c).alias("value"), "fetched_at")
        for t, c in FEED_TIMES.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    boards = table(spark, sf_dir, "sources").select(F.col("source_name").alias("board"), "time_zone", "date_order")
    return normalise(rows, boards)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_times(spark, sf_dir).select("tbl", "row_id", "norm")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each feed settle on an instant, a day or nothing."""
    kind = F.when(F.col("norm") == "unresolved", "unresolved").when(F.length("norm") == 10, "day").otherwise("instant")
    return feed_times(spark, sf_dir).groupBy("tbl", kind.alias("kind")).agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "job_snapshots"))


P5_SQL = r"""
WITH c AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)
  || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201)
  || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) AS ws),
s AS (SELECT run_id, regexp_replace(trim(dedupe_key, ws), '^http://', 'https://') AS k, CAST(trim(last_seen, ws) AS TIMESTAMPTZ) AS seen,
  coalesce(trim(title, ws), '') || chr(0) || coalesce(trim(location, ws), '') || chr(0) || coalesce(trim(status, ws), '') || chr(0)
  || coalesce(trim(experience_level, ws), '') || chr(0) || coalesce(CAST(misses AS VARCHAR), '') || chr(0) || coalesce(trim(description_sha256, ws), '') AS v
  FROM job_snapshots, c WHERE run_id IS NOT NULL AND dedupe_key IS NOT NULL),
d AS (SELECT run_id, k, arg_max(v, seen) AS v FROM s GROUP BY run_id, k),
r AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS i, lead(run_id) OVER (ORDER BY run_id) AS following FROM (SELECT DISTINCT run_id FROM d)),
x AS (SELECT d.k, d.v, r.i, r.run_id, r.following FROM d JOIN r USING (run_id))
SELECT b.run_id, b.k AS dedupe_key, CASE WHEN a.k IS NULL THEN 'added' ELSE 'changed' END AS change
FROM x b LEFT JOIN x a ON a.k = b.k AND a.i = b.i - 1 WHERE b.i > 1 AND (a.k IS NULL OR a.v <> b.v)
UNION ALL
SELECT a.following, a.k, 'removed' FROM x a LEFT JOIN x b ON b.k = a.k AND b.i = a.i + 1 WHERE a.following IS NOT NULL AND b.k IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
}
SQL: dict[str, str] = {"p5_found": P5_SQL}
