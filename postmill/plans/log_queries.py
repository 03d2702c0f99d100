"""Queries of the drop log, the funnel, yields, evaluation and the store on the test tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.session import table
from postmill.operators import analytics, droplog, evaluate, identity, matchers, store, yields
from postmill.operators.snapshot_diff import canonical_key
from postmill.plans.reference_queries import HEALTH, KEYWORDS, OTHER, VERDICTS, WS, _case, health, kind_sql, verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# The drop log: every snapshot judged by three rungs, as if each were a run.

REJECTED = "review status: already rejected"


def drop_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "job_snapshots")
    kind, title = matchers.value_kind("location", "title"), matchers.first_match("title", KEYWORDS, label="title_keyword")
    judged = rows.withColumn("kind", kind).withColumn("title_rule", title)
    vague = F.col("kind").isin("placeholder", "label", "grade")
    layer = F.when(vague, "0-rules").when(F.col("title_rule").isNotNull(), "1a-title-keyword").when(F.col("status") == "rejected", "1d-review-status")
    rule = F.when(vague, F.concat(F.lit("locations: "), F.col("kind"))).otherwise(F.coalesce("title_rule", F.lit(REJECTED)))
    dropped = judged.withColumn("layer", layer).withColumn("rule", rule).where("layer IS NOT NULL")
    at = F.date_format("delivered_at", "yyyy-MM-dd")
    return droplog.exclusions(dropped, run_id=F.col("run_id"), at=at, layer=F.col("layer"), rule=F.col("rule"))


LOG = f"""
WITH v AS (SELECT *, {kind_sql()} AS kind, {_case('title', KEYWORDS, 'title_keyword')} AS title_rule FROM job_snapshots),
w AS (SELECT *, CASE WHEN kind IN ('placeholder', 'label', 'grade') THEN '0-rules' WHEN title_rule IS NOT NULL THEN '1a-title-keyword' WHEN status = 'rejected' THEN '1d-review-status' END AS layer FROM v),
l AS (SELECT run_id, coalesce(dedupe_key, '') AS dedupe_key, coalesce(title, '') AS title, '' AS company, coalesce(source_name, '') AS source_name, coalesce(location, '') AS location, layer,
 CASE layer WHEN '0-rules' THEN 'locations: ' || kind WHEN '1a-title-keyword' THEN title_rule ELSE '{REJECTED}' END AS rule, strftime(delivered_at, '%Y-%m-%d') AS excluded_at, kind FROM w WHERE layer IS NOT NULL),
g AS (SELECT source_name, run_id, count(*) AS rows_found, true AS ok FROM job_snapshots GROUP BY 1, 2)
"""
RUNG = "CASE layer WHEN '0-rules' THEN 1 WHEN '1a-title-keyword' THEN 2 WHEN '1-seniority' THEN 3 WHEN '1d-review-status' THEN 4 ELSE 5 END"


@query(LOG + "SELECT run_id, dedupe_key, title, company, source_name, location, layer, rule, excluded_at FROM l")
def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return drop_log(spark, sf)


@query(LOG + "SELECT layer, rule, count(*) AS n FROM l WHERE run_id = (SELECT max(l.run_id) FROM l JOIN runs USING (run_id) WHERE runs.kind = 'scrape') GROUP BY 1, 2")
def exclusions_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    log = drop_log(spark, sf)
    return droplog.rule_counts(log.join(F.broadcast(droplog.latest_run(log, table(spark, sf, "runs"))), "run_id", "left_semi"))


@query(LOG + """, k AS (SELECT DISTINCT run_id FROM l), o AS (SELECT min(run_id) AS oldest FROM (SELECT run_id FROM runs JOIN k USING (run_id) WHERE kind = 'scrape' ORDER BY run_id DESC LIMIT 3))
SELECT run_id, count(*) AS n FROM l, o WHERE run_id >= oldest GROUP BY 1""")  # fmt: skip
def prune_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return droplog.prune(drop_log(spark, sf), table(spark, sf, "runs"), 3).groupBy("run_id").agg(F.count("*").alias("n"))


@query(LOG + "SELECT dedupe_key, title, source_name, layer, rule FROM l WHERE run_id = (SELECT min(run_id) FROM l) AND contains(lower(title), 'records') AND contains(lower(layer), 'title')")
def search_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    log = drop_log(spark, sf)
    first = log.agg(F.min("run_id")).first()[0]
    return droplog.search(log, first or 0, title="RECORDS", layer="Title").select("dedupe_key", "title", "source_name", "layer", "rule")


@query(LOG + f""", s AS (SELECT run_id, CAST(sum(rows_found) AS BIGINT) AS seen FROM g GROUP BY 1), n AS (SELECT run_id, {RUNG} AS i, count(*) AS dropped FROM l GROUP BY 1, 2),
r AS (SELECT * FROM (VALUES (1, '0-rules'), (2, '1a-title-keyword'), (3, '1-seniority'), (4, '1d-review-status'), (5, '2-detail')) t(i, layer)),
d AS (SELECT s.run_id, s.seen, r.i, r.layer, coalesce(n.dropped, 0) AS dropped FROM s CROSS JOIN r LEFT JOIN n ON n.run_id = s.run_id AND n.i = r.i)
SELECT run_id, layer, CAST(seen - coalesce(sum(dropped) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS reached, dropped,
 CAST(seen - sum(dropped) OVER (PARTITION BY run_id ORDER BY i) AS BIGINT) AS remaining FROM d""")  # fmt: skip
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "job_snapshots").groupBy("source_name", "run_id").agg(F.count("*").alias("rows_found")).withColumn("ok", F.lit(True))
    return droplog.funnel(found, drop_log(spark, sf))


@query(LOG + f"SELECT DISTINCT layer, {RUNG} AS rung, 'Layer ' || {RUNG} || ': ' || CASE {RUNG} WHEN 1 THEN 'Location and rules' WHEN 2 THEN 'Title keywords' ELSE 'Review status' END AS shown FROM l")
def layer_names(spark: SparkSession, sf: str) -> DataFrame:
    return drop_log(spark, sf).select("layer").distinct().select("layer", droplog.rung("layer").alias("rung"), droplog.shown("layer").alias("shown"))


# Yields and reconciliation


def found_health(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by source and snapshot, one source in four not read well."""
    rows = table(spark, sf, "job_snapshots").groupBy("source_name", "run_id").agg(F.count("*").alias("rows_found"))
    return rows.withColumn("ok", F.length("source_name") % 4 != 0)


@query(LOG + """, h AS (SELECT * REPLACE (length(source_name) % 4 <> 0 AS ok) FROM g), f AS (SELECT * FROM h WHERE ok), n AS (SELECT run_id, source_name, count(*) AS a, count(*) FILTER (WHERE layer = '0-rules') AS first FROM l GROUP BY 1, 2)
SELECT run_id, source_name, rows_found, CASE WHEN rows_found IS NULL THEN a ELSE first END AS drops, CASE WHEN rows_found IS NULL THEN 'not read' ELSE 'more drops than rows' END AS gap
FROM n LEFT JOIN f USING (run_id, source_name) WHERE rows_found IS NULL OR first > rows_found""")  # fmt: skip
def run_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return yields.run_gaps(found_health(spark, sf), drop_log(spark, sf))


@query(LOG + """, s AS (SELECT run_id, CAST(sum(rows_found) AS BIGINT) AS seen FROM g GROUP BY 1),
d AS (SELECT run_id, count(*) FILTER (WHERE layer = '0-rules') AS first_drops, count(*) FILTER (WHERE layer IN ('1a-title-keyword', '1-seniority')) AS title_drops FROM l GROUP BY 1),
j AS (SELECT last_run_id AS run_id, count(*) AS sighted FROM jobs GROUP BY 1)
SELECT run_id, seen, first_drops, title_drops, seen - first_drops AS passes, coalesce(sighted, 0) AS sighted, seen - first_drops - title_drops - coalesce(sighted, 0) AS residual FROM s LEFT JOIN d USING (run_id) LEFT JOIN j USING (run_id)""")  # fmt: skip
def run_balance(spark: SparkSession, sf: str) -> DataFrame:
    out = yields.run_balance(found_health(spark, sf).withColumn("ok", F.lit(True)), drop_log(spark, sf), table(spark, sf, "jobs"))
    return out.select("run_id", "seen", "first_drops", "title_drops", "passes", "sighted", "residual")


YIELD = LOG + """, c AS (SELECT source_name FROM sources), win AS (SELECT DISTINCT l.run_id FROM l JOIN runs ON runs.run_id = l.run_id AND runs.kind = 'scrape'),
s AS (SELECT source_name, count(*) AS health_runs, count(*) FILTER (WHERE run_id IN (SELECT run_id FROM win)) AS window_runs, CAST(sum(rows_found) FILTER (WHERE run_id IN (SELECT run_id FROM win)) AS BIGINT) AS seen FROM g GROUP BY 1),
x AS (SELECT source_name, count(*) AS log_rows, count(*) FILTER (WHERE layer = '0-rules') AS first_drops, count(*) FILTER (WHERE layer <> '0-rules') AS later_drops,
 count(*) FILTER (WHERE layer = '0-rules' AND kind = 'placeholder') AS placeholder, count(DISTINCT location) FILTER (WHERE layer = '0-rules') AS "values", count(DISTINCT rule) FILTER (WHERE layer = '0-rules') AS rules,
 count(DISTINCT coalesce(nullif(dedupe_key, ''), title)) FILTER (WHERE layer = '0-rules') AS postings FROM l WHERE run_id IN (SELECT run_id FROM win) GROUP BY 1),
y AS (SELECT c.source_name, coalesce(health_runs, 0) AS health_runs, coalesce(window_runs, 0) AS window_runs, coalesce(seen, 0) AS seen, coalesce(log_rows, 0) AS log_rows, coalesce(first_drops, 0) AS first_drops,
 coalesce(later_drops, 0) AS later_drops, coalesce(placeholder, 0) AS placeholder, coalesce("values", 0) AS "values", coalesce(rules, 0) AS rules, CASE WHEN "values" = 1 THEN postings ELSE 0 END AS constant_postings
 FROM c LEFT JOIN s USING (source_name) LEFT JOIN x USING (source_name))
"""  # fmt: skip


@query(YIELD + "SELECT source_name, health_runs, window_runs, seen, log_rows, first_drops, later_drops, placeholder, \"values\", rules, constant_postings, seen - first_drops AS passes FROM y")
def yield_counters(spark: SparkSession, sf: str) -> DataFrame:
    found = found_health(spark, sf).withColumn("ok", F.lit(True))
    y = yields.source_counters(table(spark, sf, "sources"), found, drop_log(spark, sf), table(spark, sf, "runs"), table(spark, sf, "jobs"))
    return y.select("source_name", "health_runs", "window_runs", "seen", "log_rows", "first_drops", "later_drops", "placeholder", "values", "rules", "constant_postings", "passes")


@query(YIELD.replace("FROM job_snapshots", "FROM (SELECT * FROM job_snapshots WHERE trim(coalesce(location, '')) SIMILAR TO '[0-9]+ .*')") + """
SELECT source_name, CASE WHEN seen - first_drops > 0 THEN 'A' WHEN (window_runs > 0 AND seen = 0) OR (first_drops > 0 AND (placeholder >= 0.25 * first_drops AND placeholder > 0 OR "values" = 1 AND constant_postings >= 5 OR rules = 1)) THEN 'C'
 WHEN window_runs < 5 THEN 'D' ELSE 'B' END AS class FROM y""")  # fmt: skip
def yield_class(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as they would be if boards only ever listed numbers of locations, and nothing were stored."""
    rows = table(spark, sf, "job_snapshots").where(F.trim(F.coalesce("location", F.lit(""))).rlike("^[0-9]+ .*$"))
    found = rows.groupBy("source_name", "run_id").agg(F.count("*").alias("rows_found")).withColumn("ok", F.lit(True))
    log = drop_log(spark, sf).where(F.trim("location").rlike("^[0-9]+ .*$"))
    y = yields.source_counters(table(spark, sf, "sources"), found, log, table(spark, sf, "runs"), table(spark, sf, "jobs").limit(0))
    return yields.yield_class(y).select("source_name", "class")


# Evaluation


@query(VERDICTS + "SELECT depth AS layer, rule, count(*) FILTER (WHERE wanted) AS lost, count(*) AS n FROM d WHERE depth < 3 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE wanted) > 0")
def costly_rules(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.costly_rules(verdicts(spark, sf).where("depth < 3").withColumnRenamed("depth", "layer"))


@query(VERDICTS + """SELECT CAST(l AS INTEGER) AS layer, (SELECT count(*) FROM d WHERE depth > l AND wanted) AS tp, (SELECT count(*) FROM d WHERE depth > l AND NOT wanted) AS fp,
 (SELECT count(*) FROM d WHERE depth <= l AND wanted) AS fn, (SELECT count(*) FROM d WHERE depth <= l AND NOT wanted) AS tn,
 (SELECT round(count(*) FILTER (WHERE NOT wanted) / nullif(count(*), 0), 6) FROM d WHERE depth = l) AS drop_precision FROM range(1, 3) r(l)""")  # fmt: skip
def layer_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.layer_confusion(verdicts(spark, sf), 2).select("layer", "tp", "fp", "fn", "tn", "drop_precision")


COMPARED = f"""
WITH c AS (SELECT dedupe_key, coalesce(title, '') AS title, coalesce(status = 'shortlisted', false) AS wanted, {_case('title', KEYWORDS, 'title')} IS NULL AS b, {_case('title', OTHER, 'title')} IS NULL AS a FROM jobs)
"""


def compared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    jobs = table(spark, sf, "jobs").select("dedupe_key", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("status") == "shortlisted", F.lit(False)).alias("wanted"))
    before, after = (jobs.withColumn("kept", matchers.first_match("title", k, label="title").isNull()) for k in (KEYWORDS, OTHER))
    return before, after


@query(COMPARED + "SELECT count(*) FILTER (WHERE a AND NOT b) AS newly_kept, count(*) FILTER (WHERE b AND NOT a) AS newly_dropped, count(*) FILTER (WHERE a AND NOT b AND wanted) AS recovered, count(*) FILTER (WHERE b AND NOT a AND wanted) AS newly_lost FROM c")
def net_effect(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.net_effect(*compared(spark, sf), key="dedupe_key")


@query(COMPARED + "SELECT dedupe_key, title, wanted, a AS newly_kept FROM c WHERE a <> b")
def changed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.changed_verdicts(*compared(spark, sf), key="dedupe_key")


@query("SELECT CASE WHEN contains(lower(coalesce(title,'')), 'analyst') THEN 'exclude_keywords: matched ''Analyst''' WHEN NOT (contains(lower(coalesce(title,'')), 'data') OR contains(lower(coalesce(title,'')), 'officer')) THEN 'include_keywords: no match' END AS rule, count(*) AS n FROM jobs GROUP BY 1")
def keyword_rules(spark: SparkSession, sf: str) -> DataFrame:
    rule = matchers.keyword_rule(F.coalesce("title", F.lit("")), exclude=["Analyst"], include=["Data", "officer"])
    return table(spark, sf, "jobs").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


# The store


@query(f"""
WITH k AS (SELECT DISTINCT regexp_replace(trim(dedupe_key, {WS}), '^http://', 'https://') AS dedupe_key FROM job_snapshots WHERE run_id = (SELECT min(run_id) FROM job_snapshots)),
o AS (SELECT source_name FROM sources WHERE length(source_name) % 3 <> 0),
m AS (SELECT j.*, CASE WHEN o.source_name IS NOT NULL AND k.dedupe_key IS NOT NULL THEN 0 WHEN o.source_name IS NOT NULL AND j.status IS DISTINCT FROM 'delisted' THEN coalesce(j.misses, 0) + 1 ELSE coalesce(j.misses, 0) END AS n, o.source_name IS NOT NULL AS ok
 FROM jobs j LEFT JOIN k ON k.dedupe_key = j.dedupe_key LEFT JOIN o ON o.source_name = j.source_name)
SELECT dedupe_key, CAST(n AS INTEGER) AS misses, CASE WHEN status IN ('new', 'seen') AND ok AND n >= 2 THEN 'delisted' ELSE status END AS status FROM m
""")
def delist_step(spark: SparkSession, sf: str) -> DataFrame:
    """The store after a run that sighted what the first snapshot held, at two sources of three."""
    snaps = table(spark, sf, "job_snapshots")
    first = snaps.join(F.broadcast(snaps.agg(F.min("run_id").alias("run_id"))), "run_id", "left_semi").select(canonical_key("dedupe_key").alias("dedupe_key"))
    scraped = table(spark, sf, "sources").where(F.length("source_name") % 3 != 0)
    return store.delist(table(spark, sf, "jobs"), first, scraped, threshold=2).select("dedupe_key", "misses", "status")


BATCH = f"""
WITH s AS (SELECT regexp_replace(trim(dedupe_key, {WS}), '^http://', 'https://') AS dedupe_key, coalesce(title, '') AS title, coalesce(location, '') AS location, coalesce(source_name, '') AS source_name, coalesce(experience_level, '') AS lv,
 CAST(trim(last_seen) AS TIMESTAMPTZ) AS t, description_sha256 FROM job_snapshots WHERE run_id = (SELECT max(run_id) FROM job_snapshots)),
o AS (SELECT *, epoch_us(t) AS u FROM s),
b AS (SELECT dedupe_key, arg_max(title, (u, title, location)) AS title, arg_max(location, (u, title, location)) AS location, arg_max(lv, (u, title, location)) FILTER (WHERE lv <> '') AS lv FROM o WHERE coalesce(dedupe_key, '') <> '' GROUP BY 1),
a AS (SELECT * FROM jobs WHERE length(coalesce(title, '')) % 2 = 0)
"""


def last_batch(spark: SparkSession, sf: str) -> DataFrame:
    from postmill.functions.text import instant_us

    snaps = table(spark, sf, "job_snapshots")
    last = snaps.join(F.broadcast(snaps.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")
    order = F.struct(instant_us("last_seen").alias("u"), F.coalesce("title", F.lit("")).alias("t"), F.coalesce("location", F.lit("")).alias("l"))
    return last.select(canonical_key("dedupe_key").alias("dedupe_key"), "title", "location", "source_name", "experience_level", order.alias("ord"))


@query(BATCH + """SELECT coalesce(a.dedupe_key, b.dedupe_key) AS dedupe_key, coalesce(b.title, a.title) AS title, coalesce(b.location, a.location) AS location,
 CASE WHEN a.dedupe_key IS NULL THEN 'new' WHEN b.dedupe_key IS NOT NULL AND a.status = 'delisted' THEN 'seen' ELSE a.status END AS status, CAST(CASE WHEN b.dedupe_key IS NOT NULL THEN 0 ELSE a.misses END AS INTEGER) AS misses,
 CASE WHEN b.lv <> '' THEN b.lv ELSE coalesce(a.experience_level, '') END AS experience_level, coalesce(a.first_seen, '2026-11-01T00:00:00') AS first_seen FROM a FULL OUTER JOIN b ON a.dedupe_key = b.dedupe_key""")  # fmt: skip
def merge_sightings(spark: SparkSession, sf: str) -> DataFrame:
    """The last snapshot merged into a store that holds about half of it."""
    stored = table(spark, sf, "jobs").where(F.length(F.coalesce("title", F.lit(""))) % 2 == 0)
    out = store.merge_sightings(stored, last_batch(spark, sf), run_id=99, now="2026-11-01T00:00:00")
    return out.select("dedupe_key", "title", "location", "status", "misses", "experience_level", "first_seen")


@query(BATCH + """, n AS (SELECT o.dedupe_key, count(*) AS n, bool_or(a.dedupe_key IS NOT NULL) AS known FROM o LEFT JOIN (SELECT dedupe_key FROM a) a ON a.dedupe_key = o.dedupe_key WHERE coalesce(o.dedupe_key, '') <> '' GROUP BY 1)
SELECT count(*) FILTER (WHERE NOT known) AS inserted, CAST(sum(CASE WHEN known THEN n ELSE n - 1 END) AS BIGINT) AS updated FROM n""")  # fmt: skip
def merge_counts(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "jobs").where(F.length(F.coalesce("title", F.lit(""))) % 2 == 0)
    return store.merge_counts(stored, last_batch(spark, sf))


@query(HEALTH + """, n AS (SELECT source_name, run_id, rows_found + 1 AS rows_found, false AS ok FROM h WHERE run_id % 2 = 0)
SELECT source_name, run_id, coalesce(n.rows_found, h.rows_found) AS rows_found, coalesce(n.ok, h.ok) AS ok FROM h LEFT JOIN n USING (source_name, run_id)""")  # fmt: skip
def health_record(spark: SparkSession, sf: str) -> DataFrame:
    old = health(spark, sf).select("source_name", "run_id", "rows_found", "ok").withColumn("at", F.lit("2026-01-01"))
    new = old.where("run_id % 2 = 0").select("source_name", "run_id", (F.col("rows_found") + 1).alias("rows_found"), F.lit(False).alias("ok"), F.lit("2026-02-01").alias("at"))
    return store.health_record(old, new).select("source_name", "run_id", "rows_found", "ok")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'new' THEN 'seen' ELSE status END AS status FROM jobs) GROUP BY 1")
def sweep_new(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "jobs")
    return store.decide(jobs, jobs.limit(0).select(F.lit(0).alias("row_number"), "dedupe_key"), {}, sweep="seen").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT last_run_id, status, count(*) AS n FROM jobs GROUP BY 1, 2")
def store_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "jobs").groupBy("last_run_id", "status").agg(F.count("*").alias("n"))


@query(f"""
WITH k AS (SELECT DISTINCT dedupe_key FROM jobs), o AS (SELECT DISTINCT regexp_replace(trim(dedupe_key, {WS}), '^http://', 'https://') AS dedupe_key FROM job_snapshots)
SELECT dedupe_key FROM o WHERE dedupe_key NOT IN (SELECT dedupe_key FROM k WHERE dedupe_key IS NOT NULL)
""")
def seen_minus_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a snapshot held and the store does not."""
    keys = table(spark, sf, "job_snapshots").select(canonical_key("dedupe_key").alias("dedupe_key")).where("dedupe_key IS NOT NULL").distinct()
    return keys.join(table(spark, sf, "jobs").select("dedupe_key"), "dedupe_key", "left_anti")


# Sources over runs


@query("SELECT location, count(*) AS n FROM jobs GROUP BY 1 ORDER BY n DESC, location NULLS FIRST LIMIT 20")
def most_common_locations(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.most_common(table(spark, sf, "jobs"), "location", 20)


@query("""
WITH p AS (SELECT board AS source_name, page_no, CASE WHEN page_no % 3 <> 1 THEN count(*) // 10 END AS total FROM path_feed GROUP BY 1, 2),
b AS (SELECT *, last_value(total IGNORE NULLS) OVER (PARTITION BY source_name ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT source_name, page_no, before, total FROM b WHERE before <> total
""")
def moved_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the list walk with a total that changes, some without one."""
    pages = table(spark, sf, "path_feed").groupBy(F.col("board").alias("source_name"), "page_no").agg(F.floor(F.count("*") / 10).alias("n"))
    pages = pages.withColumn("total", F.when(F.col("page_no") % 3 != 1, F.col("n"))).drop("n")
    return analytics.moved_totals(pages, order="page_no")


@query(HEALTH + """, p AS (SELECT source_name, run_id, rows_found, lag(rows_found) OVER (PARTITION BY source_name ORDER BY run_id) AS before FROM h)
SELECT source_name, run_id, CAST(round((rows_found - before) * 100.0 / before) AS INTEGER) AS change FROM p WHERE before IS NOT NULL""")  # fmt: skip
def percent_changes(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source_name").orderBy("run_id")
    rows = health(spark, sf).withColumn("before", F.lag("rows_found").over(w)).where("before IS NOT NULL")
    return rows.select("source_name", "run_id", analytics.percent_change(F.col("before"), F.col("rows_found")).alias("change"))


SHARED_URLS = "SELECT source_name, 'https://www.Job-Boards.greenhouse.io/EN-gb/de/' || source_name || '/jobs/1?x=2' AS a, 'job-boards.greenhouse.io/' || upper(source_name) AS b, 'https://acme.wd3.myworkdayjobs.com/en-US/' || source_name AS c, url AS d FROM sources"


@query(f"WITH u AS ({SHARED_URLS}) SELECT source_name, 'job-boards.greenhouse.io/' || lower(source_name) AS a, 'acme.wd3.myworkdayjobs.com/' || lower(source_name) AS c, regexp_replace(lower(regexp_extract(d,'^[a-z]+://([^/:?#]+)',1)),'^www\\.','') AS d, true AS same FROM u")
def shared_board_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Boards on shared hosts: locales skipped, case and www. ignored, a host without a scheme read."""
    name = F.col("source_name")
    a, b = F.concat(F.lit("https://www.Job-Boards.greenhouse.io/EN-gb/de/"), name, F.lit("/jobs/1?x=2")), F.concat(F.lit("job-boards.greenhouse.io/"), F.upper(name))
    c = F.concat(F.lit("https://acme.wd3.myworkdayjobs.com/en-US/"), name)
    return table(spark, sf, "sources").select(
        "source_name", identity.board_identity(a).alias("a"), identity.board_identity(c).alias("c"), identity.board_identity("url").alias("d"), identity.same_board(a, b).alias("same")
    )


# Postings against the store


@query("SELECT p.row_id, j.dedupe_key IS NOT NULL AS is_stored, j.status AS stored_status, CAST(length(coalesce(j.description_text, '')) AS INTEGER) AS stored_chars FROM (SELECT row_id, CASE WHEN row_id % 2 = 0 THEN (SELECT dedupe_key FROM jobs ORDER BY dedupe_key LIMIT 1) ELSE externalPath END AS dedupe_key FROM path_feed) p LEFT JOIN (SELECT * FROM jobs) j ON j.dedupe_key = p.dedupe_key".replace("CAST(length(coalesce(j.description_text, '')) AS INTEGER)", "CASE WHEN j.dedupe_key IS NOT NULL THEN CAST(length(coalesce(j.description_text, '')) AS INTEGER) END"))
def stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every second row of the list walk as the same stored posting, the others as new ones."""
    jobs = table(spark, sf, "jobs")
    first = jobs.agg(F.min("dedupe_key")).first()[0]
    rows = table(spark, sf, "path_feed").select("row_id", F.when(F.col("row_id") % 2 == 0, first).otherwise(F.col("externalPath")).alias("dedupe_key"))
    return store.stored_index(rows, jobs).select("row_id", "is_stored", "stored_status", "stored_chars")


PAIR = f"WITH s AS (SELECT DISTINCT run_id, regexp_replace(trim(dedupe_key, {WS}), '^http://', 'https://') AS dedupe_key FROM job_snapshots)"


def snapshot_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "job_snapshots").select("run_id", canonical_key("dedupe_key").alias("dedupe_key")).distinct()


@query(PAIR + " SELECT run_id, dedupe_key FROM s WHERE dedupe_key IN (SELECT dedupe_key FROM jobs WHERE status = 'rejected')")
def rejected_semi(spark: SparkSession, sf: str) -> DataFrame:
    return store.by_status(snapshot_keys(spark, sf), table(spark, sf, "jobs"), "rejected")[0].select("run_id", "dedupe_key")


@query(PAIR + " SELECT run_id, dedupe_key FROM s WHERE NOT EXISTS (SELECT 1 FROM jobs WHERE status = 'rejected' AND jobs.dedupe_key = s.dedupe_key)")
def rejected_anti(spark: SparkSession, sf: str) -> DataFrame:
    return store.by_status(snapshot_keys(spark, sf), table(spark, sf, "jobs"), "rejected")[1].select("run_id", "dedupe_key")


@query(LOG + f""", a AS (SELECT dedupe_key, location, last_seen AS ts FROM jobs UNION ALL SELECT regexp_replace(trim(dedupe_key, {WS}), '^http://', 'https://'), location, excluded_at FROM l),
m AS (SELECT dedupe_key, arg_max(location, (coalesce(ts, ''), location)) AS x FROM (SELECT dedupe_key, ts, location FROM a WHERE coalesce(location, '') <> '') GROUP BY 1), j AS (SELECT dedupe_key, CASE WHEN length(title) % 2 = 0 THEN location ELSE 'elsewhere' END AS location FROM jobs WHERE status <> 'new')
SELECT j.dedupe_key, coalesce(x, location) AS latest, coalesce(x, location) IS DISTINCT FROM location AS differs FROM j LEFT JOIN m USING (dedupe_key)""")  # fmt: skip
def label_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Decided postings as labels, half of them with another location, against the store and the log."""
    jobs = table(spark, sf, "jobs")
    labels = jobs.where("status <> 'new'").select("dedupe_key", F.when(F.length("title") % 2 == 0, F.col("location")).otherwise("elsewhere").alias("location"))
    log = drop_log(spark, sf).select(canonical_key("dedupe_key").alias("dedupe_key"), "location", F.col("excluded_at").alias("at"))
    stored = jobs.select("dedupe_key", "location", F.coalesce("last_seen", F.lit("")).alias("at"))
    return store.latest_locations(labels, stored, log).select("dedupe_key", "latest", "differs")


CAUSE = "CASE WHEN coalesce(description_text, '') = '' THEN 'empty' WHEN length(description_text) < 500 THEN 'short' WHEN description_fetched_at IS NULL OR description_fetched_at = '' THEN 'unfetched' ELSE 'read' END"


@query(f"SELECT source_name, count(*) FILTER (WHERE c = 'read') AS read, count(*) FILTER (WHERE c = 'short') AS short, count(*) FILTER (WHERE c = 'empty') AS empty, count(*) FILTER (WHERE c = 'unfetched') AS unfetched, count(*) AS rows FROM (SELECT source_name, {CAUSE} AS c FROM jobs) GROUP BY 1")
def causes_by_source(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("description_text", F.lit(""))
    cause = F.when(text == "", "empty").when(F.length(text) < 500, "short").when(F.coalesce("description_fetched_at", F.lit("")) == "", "unfetched").otherwise("read")
    return droplog.counts_by_cause(table(spark, sf, "jobs").withColumn("cause", cause), ("read", "short", "empty", "unfetched"))


@query("WITH h AS (SELECT board AS source_name, page_no AS run_id, count(*) AS n FROM path_feed GROUP BY 1, 2) SELECT source_name FROM h WHERE run_id = 2 AND n % 3 = 0")
def empty_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of the walk as a run; counts that three divides stand for none."""
    h = table(spark, sf, "path_feed").groupBy(F.col("board").alias("source_name"), F.col("page_no").alias("run_id")).agg(F.count("*").alias("n"))
    h = h.select("source_name", "run_id", F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")).alias("rows_found"), F.lit(True).alias("ok"))
    return analytics.empty_sources(h, 2)


@query(HEALTH + " SELECT DISTINCT source_name FROM h WHERE ok AND rows_found > 0 AND run_id = (SELECT max(run_id) FROM job_snapshots)")
def good_sources(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "job_snapshots").agg(F.max("run_id")).first()[0]
    return analytics.good_in(health(spark, sf), last)


@query("SELECT board AS source_name FROM path_feed UNION SELECT board FROM oecd UNION SELECT board FROM givewell UNION SELECT source_name FROM sources")
def all_source_names(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "sources").select("source_name")
    for t in ("path_feed", "oecd", "givewell"):
        names = names.union(table(spark, sf, t).select(F.col("board").alias("source_name")).distinct())
    return names.distinct()
