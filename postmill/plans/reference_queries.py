"""Queries of the general operators on the test tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions.session import table
from postmill.functions.text import instant_us, strip_or_empty
from postmill.operators import analytics, evaluate, exports, identity, matchers, store
from postmill.operators.snapshot_diff import canonical_key
from postmill.sources import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


# Identity


@query(r"""
WITH k AS (SELECT regexp_replace(trim(coalesce(detail_url,''), %s),'^http://','https://') AS d, regexp_replace(trim(coalesce(apply_url,''), %s),'^http://','https://') AS a FROM jobs)
SELECT CASE WHEN d <> '' THEN d ELSE a END AS posting_key, count(*) AS n FROM k GROUP BY 1
""" % (WS, WS))  # fmt: skip
def dedupe_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = identity.dedupe_key("detail_url", "apply_url").alias("posting_key")
    return table(spark, sf, "jobs").groupBy(key).agg(F.count("*").alias("n"))


@query(r"""
SELECT source_name, regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/:?#]+)',1)),'^www\.','') AS board FROM sources
""")
def board_identity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").select("source_name", identity.board_identity("url").alias("board"))


@query(r"""
WITH h AS (SELECT regexp_replace(lower(regexp_extract(detail_url,'^[a-z]+://([^/:?#]+)',1)),'^www\.','') AS host, source_name FROM jobs)
SELECT host, count(*) AS n, count(DISTINCT source_name) AS sources FROM h GROUP BY 1
""")
def postings_by_host(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "jobs").select(identity.host("detail_url").alias("host"), "source_name")
    return jobs.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("source_name").alias("sources"))


# Feeds


def all_feeds(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, read in (("givewell", feeds.greenhouse), ("oecd", feeds.smartrecruiters), ("coefficient_giving", feeds.ashby), ("path_feed", feeds.workday)):
        part = read(table(spark, sf, name), F.col("board")).withColumn("feed", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


FEEDS_SQL = """
WITH f AS (
 SELECT 'givewell' AS feed, board AS source_name, CAST(id AS VARCHAR) AS posting_id, trim(title) AS title, '' AS department, coalesce(location.name,'') AS location,
  coalesce(absolute_url,'') AS detail_url, coalesce(updated_at,'') AS posted_at FROM givewell
 UNION ALL SELECT 'oecd', board, id, trim(name), coalesce(department.label,''),
  coalesce(nullif(location.fullLocation,''), concat_ws(', ', nullif(location.city,''), nullif(location.country,''))), coalesce(ref,''), coalesce(releasedDate,'') FROM oecd
 UNION ALL SELECT 'coefficient_giving', board, id, trim(title), coalesce(nullif(department,''), team, ''),
  coalesce(array_to_string(list_filter(list_concat([location], list_transform(coalesce(secondaryLocations, []), lambda x: x.location)), lambda x, i: x IS NOT NULL AND x <> ''
    AND list_position(list_concat([location], list_transform(coalesce(secondaryLocations, []), lambda y: y.location)), x) = i), ' | '), ''),
  'ashby:' || id, coalesce(publishedAt,'') FROM coefficient_giving WHERE coalesce(isListed, true)
 UNION ALL SELECT 'path_feed', board, coalesce(bulletFields[1],''), trim(title), '', coalesce(locationsText,''), coalesce(externalPath,''), coalesce(postedOn,'') FROM path_feed)
"""


@query(FEEDS_SQL + "SELECT * FROM f WHERE title <> ''")
def unified_postings(spark: SparkSession, sf: str) -> DataFrame:
    return all_feeds(spark, sf)


@query(FEEDS_SQL + "SELECT feed, source_name, count(*) AS postings, count(DISTINCT posting_id) AS ids, count(*) FILTER (WHERE location = '') AS unplaced FROM f WHERE title <> '' GROUP BY 1, 2")
def feed_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = all_feeds(spark, sf).groupBy("feed", "source_name")
    return g.agg(F.count("*").alias("postings"), F.count_distinct("posting_id").alias("ids"), F.count_if(F.col("location") == "").alias("unplaced"))


def payloads(spark: SparkSession, sf: str, name: str, items: str, columns: list[str]) -> DataFrame:
    """Pages of a feed as JSON text again, a hundred postings each: what its reader gets from the board."""
    rows = table(spark, sf, name).select("board", F.floor(F.col("row_id") / 100).alias("page"), F.struct(*columns).alias("job"))
    pages = rows.groupBy("board", "page").agg(F.collect_list("job").alias(items))
    return pages.select(F.col("board").alias("source_name"), F.to_json(F.struct(items)).alias("payload"))


@query("SELECT board AS source_name, CAST(id AS VARCHAR) AS posting_id, trim(title) AS title, coalesce(location.name,'') AS location, coalesce(updated_at,'') AS posted_at FROM givewell WHERE trim(title) <> ''")
def json_reader_greenhouse(spark: SparkSession, sf: str) -> DataFrame:
    pages = payloads(spark, sf, "givewell", "jobs", ["id", "title", "absolute_url", "location", "requisition_id", "updated_at"])
    return feeds.read_payloads(pages, "greenhouse").select("source_name", "posting_id", "title", "location", "posted_at")


@query(FEEDS_SQL + "SELECT source_name, posting_id, title, department, location, posted_at FROM f WHERE feed = 'coefficient_giving' AND title <> ''")
def json_reader_ashby(spark: SparkSession, sf: str) -> DataFrame:
    pages = payloads(spark, sf, "coefficient_giving", "jobs", ["id", "title", "department", "team", "location", "secondaryLocations", "isListed", "workplaceType", "publishedAt", "descriptionPlain"])
    return feeds.read_payloads(pages, "ashby").select("source_name", "posting_id", "title", "department", "location", "posted_at")


@query(FEEDS_SQL + "SELECT source_name, posting_id, title, department, location, posted_at FROM f WHERE feed = 'oecd' AND title <> ''")
def json_reader_smartrecruiters(spark: SparkSession, sf: str) -> DataFrame:
    pages = payloads(spark, sf, "oecd", "content", ["id", "name", "releasedDate", "location", "department", "ref"])
    return feeds.read_payloads(pages, "smartrecruiters").select("source_name", "posting_id", "title", "department", "location", "posted_at")


@query(FEEDS_SQL + "SELECT source_name, posting_id, title, location, detail_url, posted_at FROM f WHERE feed = 'path_feed' AND title <> ''")
def json_reader_workday(spark: SparkSession, sf: str) -> DataFrame:
    pages = payloads(spark, sf, "path_feed", "jobPostings", ["title", "externalPath", "locationsText", "postedOn", "bulletFields", "timeType"])
    return feeds.read_payloads(pages, "workday").select("source_name", "posting_id", "title", "location", "detail_url", "posted_at")


@query("SELECT board AS source_name, id AS posting_id, trim(name) AS title, coalesce(location.city,'') AS location FROM oecd WHERE trim(name) <> ''")
def xml_reader_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "oecd")

    def tag(name: str, c: str) -> F.Column:
        safe = F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.concat(F.lit(f"<{name}>"), safe, F.lit(f"</{name}>"))

    one = F.concat(F.lit("<position>"), tag("id", "id"), tag("name", "name"), tag("office", "location.city"), F.lit("</position>"))
    pages = rows.groupBy("board", F.floor(F.col("row_id") / 100).alias("page")).agg(F.array_join(F.collect_list(one), "").alias("p"))
    pages = pages.select(F.col("board").alias("source_name"), F.concat(F.lit("<workzag-jobs>"), F.col("p"), F.lit("</workzag-jobs>")).alias("payload"))
    return feeds.read_payloads(pages, "positions").select("source_name", "posting_id", "title", "location")


@query("""
WITH t AS (SELECT board AS source_name, max(page_no) * 20 - 19 AS total FROM path_feed GROUP BY 1), n AS (SELECT board AS source_name, count(*) AS collected FROM path_feed GROUP BY 1)
SELECT source_name, collected, total, CASE WHEN total IS NULL THEN 'unverified' WHEN collected < total THEN 'short' ELSE 'complete' END AS verdict FROM t JOIN n USING (source_name)
""")
def walk_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """Rows against the fewest that the last page number implies, at 20 a page."""
    rows = table(spark, sf, "path_feed").withColumnRenamed("board", "source_name")
    stated = rows.groupBy("source_name").agg((F.max("page_no") * 20 - 19).alias("total"))
    return feeds.reconciled(rows, stated)


@query("""
SELECT board, externalPath, page_no, row_id, title FROM (SELECT *, row_number() OVER (PARTITION BY board, externalPath ORDER BY page_no, row_id) AS i FROM path_feed) WHERE i = 1
""")
def walk_first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "path_feed").select("board", "externalPath", "page_no", "row_id", "title")
    return analytics.first_seen_per_walk(rows, keys=("board", "externalPath"), order=("page_no", "row_id"))


@query("""
SELECT board, externalPath, arg_max(title, (CAST(fetched_at AS TIMESTAMPTZ), row_id)) AS title, count(*) AS sightings, count(DISTINCT title) > 1 AS conflict FROM path_feed GROUP BY 1, 2
""")
def latest_sighting(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "path_feed").withColumn("t", instant_us("fetched_at"))
    latest = F.max_by("title", F.struct("t", "row_id")).alias("title")
    return rows.groupBy("board", "externalPath").agg(latest, F.count("*").alias("sightings"), (F.count_distinct("title") > 1).alias("conflict"))


@query("SELECT source_name, count(*) FILTER (WHERE trim(coalesce(title,'')) = '') AS untitled, count(*) AS n FROM jobs GROUP BY 1")
def untitled_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "jobs").groupBy("source_name").agg(F.count_if(identity.untitled("title")).alias("untitled"), F.count("*").alias("n"))


# Matching with attribution

KEYWORDS = [("Warehouse", "word"), ("Coordinat", "prefix"), ("analyst", "contains"), ("Records Manager", "word"), ("Fachkraft", "word")]
LOWER = {"word": r"\b{}\b", "prefix": r"\b{}", "contains": "{}"}


def _case(column: str, keywords: list[tuple[str, str]], label: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({column}, '(?i){LOWER[k].format(w)}') THEN '{label}: ''{w}'' ({k})'" for w, k in keywords)
    return f"CASE {arms} END"


def _plain(column: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({column},''), '[\\s\u00a0]+', ' ', 'g')))"


def kind_sql(location: str = "location", title: str = "title") -> str:
    c = _plain(location)
    return f"""CASE WHEN {c} = '' THEN 'empty' WHEN {c} = {_plain(title)} THEN 'title'
 WHEN regexp_matches({c}, '^([0-9]+|{'|'.join(matchers.COUNTS)}) ({'|'.join(matchers.WHERES)})$') OR {c} IN {matchers.ALONE} THEN 'placeholder'
 WHEN {c} IN {matchers.LABELS} THEN 'label' WHEN regexp_matches({c}, '^({'|'.join(matchers.GRADES)})[ -]?[0-9]{{1,2}}$|^({'|'.join(matchers.GRADE_WORDS)}) \\S+$') THEN 'grade' ELSE 'place' END"""


KIND_SQL = kind_sql()


@query(f"SELECT {_case('title', KEYWORDS, 'title')} AS rule, count(*) AS n FROM jobs GROUP BY 1")
def title_keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    rule = matchers.first_match("title", KEYWORDS, label="title").alias("rule")
    return table(spark, sf, "jobs").groupBy(rule).agg(F.count("*").alias("n"))


@query(f"SELECT {KIND_SQL} AS kind, count(*) AS n, count(DISTINCT location) AS spellings FROM jobs GROUP BY 1")
def location_value_kind(spark: SparkSession, sf: str) -> DataFrame:
    kind = matchers.value_kind("location", "title").alias("kind")
    return table(spark, sf, "jobs").groupBy(kind).agg(F.count("*").alias("n"), F.count_distinct("location").alias("spellings"))


@query("""
SELECT len(list_filter(list_transform(regexp_split_to_array(coalesce(location,''), '[|/\n;]+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS options, count(*) AS n FROM jobs GROUP BY 1
""")
def location_options(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "jobs").groupBy(F.size(matchers.options("location")).cast("bigint").alias("options")).agg(F.count("*").alias("n"))


VERDICTS = f"""
WITH v AS (SELECT dedupe_key, source_name, title, status = 'shortlisted' AS wanted, {KIND_SQL} AS kind, {_case('title', KEYWORDS, 'title')} AS title_rule FROM jobs),
d AS (SELECT *, CASE WHEN kind IN ('placeholder', 'label', 'grade') THEN 1 WHEN title_rule IS NOT NULL THEN 2 ELSE 3 END AS depth,
 CASE WHEN kind IN ('placeholder', 'label', 'grade') THEN 'location: ' || kind ELSE title_rule END AS rule FROM v)
"""


def verdicts(spark: SparkSession, sf: str, keywords: list[tuple[str, str]] = KEYWORDS) -> DataFrame:
    """Two rungs over the store: location values that say nothing, then title keywords; with the rule that hit."""
    kind = matchers.value_kind("location", "title")
    rule = matchers.first_match("title", keywords, label="title")
    v = table(spark, sf, "jobs").select("dedupe_key", "source_name", "title", F.coalesce(F.col("status") == "shortlisted", F.lit(False)).alias("wanted"), kind.alias("kind"), rule.alias("title_rule"))
    vague = F.col("kind").isin("placeholder", "label", "grade")
    return v.withColumn("depth", F.when(vague, 1).when(F.col("title_rule").isNotNull(), 2).otherwise(3)).withColumn("rule", F.when(vague, F.concat(F.lit("location: "), F.col("kind"))).otherwise(F.col("title_rule")))


@query(VERDICTS + "SELECT depth AS layer, rule, count(*) AS n, count(*) FILTER (WHERE wanted) AS wanted FROM d WHERE depth < 3 GROUP BY 1, 2")
def drop_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rule_counts(verdicts(spark, sf).where("depth < 3").withColumnRenamed("depth", "layer"))


@query(VERDICTS + """, c AS (SELECT count(*) FILTER (WHERE wanted AND depth = 3) AS tp, count(*) FILTER (WHERE NOT wanted AND depth = 3) AS fp,
 count(*) FILTER (WHERE wanted AND depth < 3) AS fn, count(*) FILTER (WHERE NOT wanted AND depth < 3) AS tn FROM d),
p AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS pr, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS re FROM c)
SELECT tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr = 0 AND re = 0 THEN 0 ELSE 5 * pr * re / nullif(4 * pr + re, 0) END, 6) AS f2 FROM p""")  # fmt: skip
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(verdicts(spark, sf).withColumn("kept", F.col("depth") == 3))


@query(VERDICTS + """SELECT CAST(l AS INTEGER) AS layer, (SELECT count(*) FROM d WHERE depth >= l) AS reached, (SELECT count(*) FROM d WHERE depth = l) AS dropped,
 (SELECT count(*) FROM d WHERE depth = l AND wanted) AS wanted_lost FROM range(1, 3) r(l)""")  # fmt: skip
def layer_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.layer_report(verdicts(spark, sf), 2)


OTHER = [("Programme", "prefix"), ("Warehouse", "word"), ("Coordinat", "prefix")]


@query(f"""SELECT dedupe_key, b AS before, a AS after FROM (SELECT dedupe_key, {_case('title', KEYWORDS, 'title')} AS b, {_case('title', OTHER, 'title')} AS a FROM jobs) WHERE b IS DISTINCT FROM a""")
def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "jobs")
    before, after = (jobs.select("dedupe_key", matchers.first_match("title", k, label="title").alias("rule")) for k in (KEYWORDS, OTHER))
    return evaluate.verdict_changes(before, after, key="dedupe_key", verdict="rule")


@query("""
WITH l AS (SELECT title, status = 'shortlisted' AS wanted, dedupe_key FROM jobs WHERE status IN ('shortlisted', 'rejected'))
SELECT title, bool_and(wanted) AS wanted, min(dedupe_key) AS dedupe_key FROM l GROUP BY 1 HAVING count(DISTINCT wanted) = 1
""")
def unanimous_labels(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "jobs").where(F.col("status").isin("shortlisted", "rejected")).select("title", (F.col("status") == "shortlisted").alias("wanted"), "dedupe_key")
    return evaluate.unanimous(l, key="title", label="wanted", ordinal="dedupe_key")


# Health of sources over runs


def health(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by source and delivered run; a run that broke off is not good."""
    rows = table(spark, sf, "job_snapshots").groupBy("source_name", "run_id").agg(F.count("*").alias("rows_found"))
    runs = table(spark, sf, "runs").select("run_id", F.col("finished_at").isNotNull().alias("ok"))
    return rows.join(runs, "run_id")


HEALTH = "WITH h AS (SELECT s.source_name, s.run_id, s.rows_found, r.finished_at IS NOT NULL AS ok FROM (SELECT source_name, run_id, count(*) AS rows_found FROM job_snapshots GROUP BY 1, 2) s JOIN runs r USING (run_id))"


@query(HEALTH + "SELECT * FROM h")
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    return health(spark, sf)


def uneven_health(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by board and page of the list walk, as if each page were a run: counts that fall and recover, with failed runs between."""
    rows = table(spark, sf, "path_feed").groupBy(F.col("board").alias("source_name"), F.col("page_no").cast("bigint").alias("run_id")).agg(F.count("*").alias("rows_found"))
    return rows.withColumn("ok", F.col("run_id") % 5 != 3)


UNEVEN = "WITH h AS (SELECT board AS source_name, CAST(page_no AS BIGINT) AS run_id, count(*) AS rows_found, page_no % 5 <> 3 AS ok FROM path_feed GROUP BY 1, 2, 4)"


@query(UNEVEN + """, p AS (SELECT *, last_value(CASE WHEN ok THEN rows_found END IGNORE NULLS) OVER (PARTITION BY source_name ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM h)
SELECT source_name, run_id, rows_found, previous FROM p WHERE ok AND previous > 0 AND rows_found < previous * 0.5""")  # fmt: skip
def health_regressions(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.regressions(uneven_health(spark, sf)).select("source_name", "run_id", "rows_found", "previous")


@query(HEALTH + """, t AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY run_id DESC) AS i FROM h WHERE ok)
SELECT source_name, string_agg(CAST(rows_found AS VARCHAR), ',' ORDER BY i) AS counts FROM t WHERE i <= 5 GROUP BY 1""")  # fmt: skip
def last_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = analytics.last_counts(health(spark, sf), 5)
    return c.select("source_name", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


@query(f"""
WITH h AS (SELECT board AS source_name, CAST(page_no AS BIGINT) AS run_id, 10 + hash_page % 3 * CAST(page_no < 3 AS INT) AS rows_found FROM (SELECT DISTINCT board, page_no, length(board) AS hash_page FROM path_feed)),
t AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY run_id DESC) AS i FROM h)
SELECT source_name, CAST(min(rows_found) AS BIGINT) AS size FROM t WHERE i <= 5 GROUP BY 1 HAVING count(*) = 5 AND min(rows_found) = max(rows_found) AND min(rows_found) IN {analytics.PAGE_SIZES}
""")
def one_page_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the list walk as runs, each with ten rows but for some of the first two."""
    pages = table(spark, sf, "path_feed").select(F.col("board").alias("source_name"), F.col("page_no").cast("bigint").alias("run_id")).distinct()
    found = F.lit(10) + F.length("source_name") % 3 * (F.col("run_id") < 3).cast("int")
    c = analytics.one_page(pages.select("source_name", "run_id", found.cast("bigint").alias("rows_found"), F.lit(True).alias("ok")))
    return c.select("source_name", F.array_min("counts").alias("size"))


@query("""
SELECT s.source_name, s.platform, coalesce(j.postings, 0) AS postings, coalesce(j.shortlisted, 0) AS shortlisted, j.newest FROM sources s
LEFT JOIN (SELECT source_name, count(*) AS postings, count(*) FILTER (WHERE status = 'shortlisted') AS shortlisted, max(first_seen) AS newest FROM jobs GROUP BY 1) j USING (source_name)
""")
def source_yield(spark: SparkSession, sf: str) -> DataFrame:
    """Configured sources with what the store has of them; sources without postings stay at zero."""
    jobs = table(spark, sf, "jobs").groupBy("source_name").agg(F.count("*").alias("postings"), F.count_if(F.col("status") == "shortlisted").alias("shortlisted"), F.max("first_seen").alias("newest"))
    return table(spark, sf, "sources").select("source_name", "platform").join(jobs, "source_name", "left").fillna(0, ["postings", "shortlisted"])


@query("SELECT source_name, status, count(*) AS n, max(first_seen) AS newest FROM jobs GROUP BY 1, 2")
def store_by_source_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "jobs").groupBy("source_name", "status").agg(F.count("*").alias("n"), F.max("first_seen").alias("newest"))


@query("SELECT board AS source_name, count(*) AS n FROM path_feed WHERE board NOT IN (SELECT source_name FROM sources WHERE platform <> 'workday') GROUP BY 1")
def unconfigured_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Boards of the list walk against a configuration from which those of its own platform were taken out."""
    feed = table(spark, sf, "path_feed").withColumnRenamed("board", "source_name")
    configured = table(spark, sf, "sources").where("platform <> 'workday'").select("source_name")
    return feed.join(configured, "source_name", "left_anti").groupBy("source_name").agg(F.count("*").alias("n"))


# The store


def snapshot(spark: SparkSession, sf: str, back: int) -> DataFrame:
    """The snapshot ``back`` deliveries before the last, with canonical keys; one row per key."""
    snaps = table(spark, sf, "job_snapshots")
    ids = snaps.select("run_id").distinct().orderBy(F.desc("run_id")).limit(back + 1)
    run = ids.agg(F.min("run_id").alias("run_id"))
    rows = snaps.join(F.broadcast(run), "run_id", "left_semi").withColumn("dedupe_key", canonical_key("dedupe_key"))
    best = F.struct(instant_us("last_seen").alias("t"), F.coalesce("misses", F.lit(0)).alias("m"))
    return rows.groupBy("dedupe_key").agg(
        *[F.max_by(F.trim(c), best).alias(c) for c in ("title", "source_name")], *[F.max_by(c, best).alias(c) for c in ("misses", "last_seen", "run_id")], F.max_by(strip_or_empty("location"), best).alias("location")
    )


SNAP = """
WITH r AS (SELECT DISTINCT run_id FROM job_snapshots ORDER BY run_id DESC LIMIT 2),
s AS (SELECT run_id, regexp_replace(trim(dedupe_key, {ws}), '^http://', 'https://') AS dedupe_key, trim(title) AS title, trim(source_name) AS source_name, misses, last_seen,
 coalesce(trim(location, {ws}), '') AS location, CAST(trim(last_seen) AS TIMESTAMPTZ) AS t FROM job_snapshots),
b AS (SELECT dedupe_key, arg_max(location, (t, coalesce(misses, 0))) AS location, arg_max(misses, (t, coalesce(misses, 0))) AS misses FROM s WHERE run_id = (SELECT max(run_id) FROM r) GROUP BY 1),
a AS (SELECT dedupe_key, arg_max(location, (t, coalesce(misses, 0))) AS location, arg_max(misses, (t, coalesce(misses, 0))) AS misses FROM s WHERE run_id = (SELECT min(run_id) FROM r) GROUP BY 1)
""".replace("{ws}", WS)


@query(SNAP + """SELECT coalesce(b.dedupe_key, a.dedupe_key) AS dedupe_key, CASE WHEN b.dedupe_key IS NULL THEN a.misses ELSE b.misses END AS misses,
 coalesce(nullif(b.location, ''), a.location) AS location, a.dedupe_key IS NULL AS is_new FROM a FULL OUTER JOIN b USING (dedupe_key)""")  # fmt: skip
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The last snapshot merged into the one before; an empty location does not replace one."""
    old = snapshot(spark, sf, 1).select("dedupe_key", "misses", "location").withColumn("is_new", F.lit(False))
    new = snapshot(spark, sf, 0).select("dedupe_key", "misses", "location")
    return store.upsert(old, new, key="dedupe_key", overwrite=("misses",), sticky=("location",), first={"is_new": F.lit(True)}, keep=("is_new",))


@query("""
WITH s AS (SELECT DISTINCT run_id, regexp_replace(trim(dedupe_key, {ws}), '^http://', 'https://') AS dedupe_key, misses FROM job_snapshots),
k AS (SELECT run_id, dedupe_key, max(misses) > 0 AS m FROM s GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY run_id) AS i FROM k),
g AS (SELECT *, i - row_number() OVER (PARTITION BY dedupe_key ORDER BY run_id) AS island FROM i WHERE m)
SELECT dedupe_key, min(run_id) AS first_run, max(run_id) AS last_run, count(*) AS streak FROM g GROUP BY dedupe_key, island
""".replace("{ws}", WS))  # fmt: skip
def miss_streaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "job_snapshots").groupBy(canonical_key("dedupe_key").alias("dedupe_key"), "run_id").agg(F.max("misses").alias("misses"))
    return store.miss_streaks(rows, missed=F.col("misses") > 0)


@query("""
WITH l AS (SELECT DISTINCT run_id FROM job_snapshots), o AS (SELECT min(run_id) AS oldest FROM (SELECT run_id FROM runs JOIN l USING (run_id) WHERE kind = 'scrape' ORDER BY run_id DESC LIMIT 3))
SELECT run_id, kind FROM runs JOIN l USING (run_id), o WHERE run_id >= oldest
""")
def prune_window(spark: SparkSession, sf: str) -> DataFrame:
    return store.kept_runs(table(spark, sf, "runs"), table(spark, sf, "job_snapshots"), 3).select("run_id", "kind")


@query("""
WITH t AS (SELECT run_id, kind, epoch_us(CAST(started_at AS TIMESTAMPTZ)) AS a, epoch_us(CAST(finished_at AS TIMESTAMPTZ)) AS b FROM runs)
SELECT kind, count(*) AS runs, count(*) FILTER (WHERE b IS NULL) AS broken, CAST(max(b - a) // 1000000 AS BIGINT) AS longest_s FROM t GROUP BY 1
""")
def run_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "runs").select("kind", instant_us("started_at").alias("a"), instant_us("finished_at").alias("b"))
    return t.groupBy("kind").agg(F.count("*").alias("runs"), F.count_if(F.col("b").isNull()).alias("broken"), F.floor(F.max(F.col("b") - F.col("a")) / 1000000).alias("longest_s"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY coalesce(score, -1) DESC, first_seen DESC, dedupe_key) + 1 AS row_number,
 dense_rank() OVER (PARTITION BY source_name ORDER BY substr(first_seen, 1, 10) DESC) <= 2 AS is_recent FROM jobs)
SELECT source_name, row_number, dedupe_key, is_recent FROM n
""")
def export_map(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of each source's sheet in review order, numbered from 2, with the two newest days marked."""
    jobs = table(spark, sf, "jobs").select("source_name", "dedupe_key", "score", "first_seen", F.substring("first_seen", 1, 10).alias("day"))
    sheet = exports.numbered_within(jobs, "source_name", [F.col("score").desc_nulls_last(), F.desc("first_seen"), F.col("dedupe_key")], start=2)
    # The days of a source are few beside its rows.
    days = jobs.select("source_name", "day").distinct().withColumn("i", F.dense_rank().over(Window.partitionBy("source_name").orderBy(F.desc("day"))))
    newest = days.where("i <= 2").select(F.col("source_name").alias("s"), F.col("day").alias("d"))
    both = sheet.join(newest, F.col("source_name").eqNullSafe(F.col("s")) & F.col("day").eqNullSafe(F.col("d")), "left")
    return both.select("source_name", "row_number", "dedupe_key", F.coalesce(F.col("s").isNotNull(), F.lit(False)).alias("is_recent"))


@query("""
WITH l AS (SELECT regexp_replace(trim(dedupe_key, {ws}), '^http://', 'https://') AS dedupe_key, min(description_sha256) AS scored FROM job_snapshots WHERE run_id = (SELECT min(run_id) FROM job_snapshots) GROUP BY 1)
SELECT j.dedupe_key, l.scored IS NULL AS unscored FROM jobs j LEFT JOIN l ON j.dedupe_key = l.dedupe_key
WHERE coalesce(j.description_text, '') <> '' AND j.status = 'new' AND (l.scored IS NULL OR l.scored <> sha256(j.description_text))
""".replace("{ws}", WS))  # fmt: skip
def rescore_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """New postings whose text is not the one of the first snapshot."""
    snaps = table(spark, sf, "job_snapshots")
    first = snaps.agg(F.min("run_id").alias("run_id"))
    scored = snaps.join(F.broadcast(first), "run_id", "left_semi").groupBy(canonical_key("dedupe_key").alias("dedupe_key")).agg(F.min("description_sha256").alias("scored"))
    jobs = table(spark, sf, "jobs").where((F.coalesce("description_text", F.lit("")) != "") & (F.col("status") == "new")).select("dedupe_key", F.sha2("description_text", 256).alias("sha"))
    both = jobs.join(scored, "dedupe_key", "left")
    return both.where(F.col("scored").isNull() | (F.col("scored") != F.col("sha"))).select("dedupe_key", F.col("scored").isNull().alias("unscored"))


@query("""
SELECT source_name, count(*) FILTER (WHERE coalesce(description_text,'') = '') AS empty, count(*) FILTER (WHERE length(description_text) BETWEEN 1 AND 499) AS short,
 count(*) FILTER (WHERE length(description_text) >= 500) AS readable FROM jobs GROUP BY 1
""")
def unreadable_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length(F.coalesce("description_text", F.lit("")))
    return table(spark, sf, "jobs").groupBy("source_name").agg(F.count_if(n == 0).alias("empty"), F.count_if(n.between(1, 499)).alias("short"), F.count_if(n >= 500).alias("readable"))


@query("""
SELECT location, count(DISTINCT coalesce(nullif(dedupe_key, ''), title)) AS postings FROM jobs WHERE trim(coalesce(location, '')) <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(nullif(dedupe_key, ''), title)) >= 5
""")
def constant_locations(spark: SparkSession, sf: str) -> DataFrame:
    who = F.coalesce(F.nullif(F.col("dedupe_key"), F.lit("")), F.col("title"))
    jobs = table(spark, sf, "jobs").where(F.trim(F.coalesce("location", F.lit(""))) != "")
    return jobs.groupBy("location").agg(F.count_distinct(who).alias("postings")).where("postings >= 5")
