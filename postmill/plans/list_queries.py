"""Queries of curated lists, page scans, robots files, stored answers and exports on the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import scoring
from postmill.functions.session import table
from postmill.functions.text import instant_us
from postmill.operators import curated, droplog, exports
from postmill.sources import fetched, probe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


HOST = "regexp_replace(lower(regexp_extract({}, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"


def banned(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the boards as a list, each twice, the second under another name."""
    s = table(spark, sf, "sources").where(F.length("source_name") % 2 == 0)
    one = s.select(F.lit(1).alias("ordinal"), F.col("company").alias("organisation"), F.concat(F.col("url"), F.lit("jobs?x=1")).alias("url"), F.concat(F.lit(" not  for "), F.col("platform")).alias("reason"))
    return one.unionByName(one.select(F.lit(2).alias("ordinal"), F.lit("later").alias("organisation"), "url", F.lit("x").alias("reason")))


@query("SELECT source_name, company AS organisation, 'not for ' || platform AS reason FROM sources WHERE length(source_name) % 2 = 0")
def tombstoned_sources(spark: SparkSession, sf: str) -> DataFrame:
    return curated.on_list(table(spark, sf, "sources"), banned(spark, sf))


@query(f"SELECT source_name FROM sources WHERE {HOST.format('url')} = (SELECT {HOST.format('min(url)')} FROM sources) OR contains(lower(company), 'al') OR contains(lower(source_name), 'al')")
def source_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """By board or by a part of the name: each asked for on its own, then together."""
    s = table(spark, sf, "sources")
    first = s.agg(F.min("url")).first()[0]
    return curated.matches(s, first, names=("company", "source_name")).union(curated.matches(s, "AL", names=("company", "source_name"))).select("source_name").distinct()


@query("SELECT source_name, CASE WHEN length(source_name) % 2 = 0 THEN 'board' ELSE 'organisation' END AS why FROM sources WHERE length(source_name) % 2 = 0 OR lower(trim(company)) IN (SELECT lower(trim(company)) FROM sources WHERE length(source_name) % 2 = 0)")
def refused_entries(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "sources").select("source_name", F.upper("company").alias("organisation"), "url")
    return curated.refused(banned(spark, sf), new).select("source_name", "why")


@query("""
WITH t AS (SELECT row_id, epoch_us(CAST(fetched_at AS TIMESTAMPTZ)) AS a FROM path_feed), n AS (SELECT max(a) AS now FROM t)
SELECT CASE WHEN now - a BETWEEN 0 AND 1800000000 THEN 'hit' WHEN row_id % 2 = 0 THEN 'revalidate' ELSE 'miss' END AS state, count(*) AS n FROM t, n GROUP BY 1
""")
def cache_states(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched pages as stored answers when the last of them came, every second with an etag."""
    rows = table(spark, sf, "path_feed").select("row_id", instant_us("fetched_at").alias("a"))
    now = rows.agg(F.max("a")).first()[0]
    state = fetched.cache_state(F.col("a"), F.lit(now), F.when(F.col("row_id") % 2 == 0, "e"))
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT dedupe_key AS url, NOT (length(source_name) % 3 = 0 AND contains(dedupe_key, '/jobs/')) AS allowed, CASE length(source_name) % 3 WHEN 1 THEN 'absent' ELSE 'file' END AS reason FROM jobs WHERE regexp_matches(dedupe_key, '^https://[^/]+/.')")
def robots_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each host by its source's name: one in three closes /jobs/, one in three is absent, one is open."""
    from postmill.operators.identity import origin

    jobs = table(spark, sf, "jobs").where(F.col("dedupe_key").rlike("^https://[^/]+/."))
    m = F.length("source_name") % 3
    files = jobs.groupBy(origin("dedupe_key").alias("origin")).agg(F.min("source_name").alias("source_name"))
    files = files.select("origin", F.when(m == 1, 404).otherwise(200).alias("status"), F.when(m == 0, "User-agent: *\nDisallow: /jobs/").otherwise("User-agent: *\nDisallow:").alias("text"))
    return fetched.robots_verdicts(jobs.select(F.col("dedupe_key").alias("url")), files, "reader").select("url", "allowed", "reason")


@query("""
WITH p AS (SELECT board, count(*) AS n, count(DISTINCT row_id) AS links FROM givewell GROUP BY 1)
SELECT board AS url, CAST(links AS INTEGER) AS posting_links, CAST(n AS INTEGER) AS cards, CAST(n + 7 AS INTEGER) AS total, CAST(20 AS INTEGER) AS page_size, true AS has_postings, 'next link,later page' AS pager FROM p
""")
def page_scans(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each board, with a card for each posting and a range of totals."""
    card = F.concat(F.lit('<li class="job-card"><a href="/jobs/p-'), F.col("row_id").cast("string"), F.lit('">x</a></li>'))
    rows = table(spark, sf, "givewell").groupBy("board").agg(F.array_join(F.collect_list(card), "").alias("c"), F.count("*").alias("n"))
    tail = F.concat(F.lit('<p>Showing 1 to 20 of '), (F.col("n") + 7).cast("string"), F.lit('</p><a rel="next" href="/all?page=2">next</a>'))
    pages = rows.select(F.col("board").alias("url"), F.concat(F.col("c"), tail).alias("html"))
    out = probe.scan_pages(pages)
    return out.select("url", "posting_links", "cards", "total", "page_size", "has_postings", F.array_join("pager", ",").alias("pager"))


@query("SELECT source_name, CASE platform WHEN 'greenhouse' THEN 'greenhouse:' || source_name WHEN 'ashby' THEN 'ashby:' || source_name WHEN 'smartrecruiters' THEN 'smartrecruiters:' || source_name ELSE '' END AS found FROM sources")
def platform_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    s, name = table(spark, sf, "sources"), F.col("source_name")
    page = (
        F.when(F.col("platform") == "greenhouse", F.concat(F.lit("<script src='https://boards.greenhouse.io/embed/job_board/js?for="), name, F.lit("'>")))
        .when(F.col("platform") == "ashby", F.concat(F.lit("<a href='https://jobs.ashbyhq.com/"), name, F.lit("'>")))
        .when(F.col("platform") == "smartrecruiters", F.concat(F.lit("<a href='https://careers.smartrecruiters.com/"), name, F.lit("'>")))
        .otherwise("<p>nothing</p>")
    )
    told = F.transform(probe.fingerprint(page), lambda x: F.concat(x["platform"], F.lit(":"), F.array_join(x["boards"], ",")))
    return s.select("source_name", F.array_join(told, ";").alias("found"))


@query("SELECT dedupe_key, CASE WHEN score IS NULL THEN 'score' WHEN status = 'new' THEN 'relevance' END AS fault FROM jobs")
def scorer_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The store's scores as answers; some lack the score, new ones have an unknown relevance."""
    jobs = table(spark, sf, "jobs")
    answer = F.to_json(F.struct("score", F.lit("good").alias("seniority_fit"), F.when(F.col("status") == "new", "?").otherwise("high").alias("relevance"), F.lit("fits").alias("reasoning"), F.array(F.lit("a")).alias("flags")))
    return jobs.select("dedupe_key", scoring.answer_fault(answer, seniority=("good",), relevance=("high",)).alias("fault"))


@query("SELECT dedupe_key, '=HYPERLINK(\"' || replace(detail_url, '\"', '\"\"') || '\",\"' || replace(coalesce(title, ''), '\"', '\"\"') || '\")' AS link FROM jobs WHERE coalesce(detail_url, '') <> ''")
def sheet_links(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "jobs").where(F.coalesce("detail_url", F.lit("")) != "")
    return jobs.select("dedupe_key", scoring.sheet_link(F.col("detail_url"), F.col("title")).alias("link"))


@query("SELECT row_id, CASE WHEN length(t) <= 24 THEN t ELSE substr(t, 1, 23) || '…' END AS title FROM (SELECT row_id, trim(regexp_replace(coalesce(title, ''), '[\\s ]+', ' ', 'g')) AS t FROM path_feed)")
def clipped_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "path_feed").select("row_id", droplog.clipped("title", 24).alias("title"))


@query("""
WITH n AS (SELECT dedupe_key, row_number() OVER (ORDER BY coalesce(score, -1) DESC, lower(source_name), first_seen DESC, source_name, dedupe_key) + 1 AS row_number, first_seen FROM jobs WHERE status = 'new'),
d AS (SELECT DISTINCT first_seen FROM n ORDER BY first_seen DESC LIMIT 2)
SELECT dedupe_key, row_number, first_seen IN (SELECT first_seen FROM d) AS is_recent FROM n
""")
def review_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """All that is still to be reviewed in one order, numbered from 2, with what came on the two latest times marked."""
    return exports.review_sheet(table(spark, sf, "jobs").where("status = 'new'")).select("dedupe_key", "row_number", "is_recent")


@query("SELECT dedupe_key, row_number() OVER (ORDER BY first_seen DESC, lower(source_name), source_name, dedupe_key) + 1 AS row_number FROM jobs WHERE status <> 'new'")
def archive_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return exports.archive_sheet(table(spark, sf, "jobs").where("status <> 'new'")).select("dedupe_key", "row_number")
