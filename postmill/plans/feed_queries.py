"""Queries of the readers on payloads written from the feed tables in each platform's shape, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.session import table
from postmill.sources import boards, feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEEN = ["source_name", "posting_id", "title", "department", "location", "detail_url"]


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def pages(rows: DataFrame, item: Column, wrap: str | None) -> DataFrame:
    """Pages of a hundred items a board as JSON text, as the board would send them."""
    got = rows.groupBy(F.col("board").alias("source_name"), F.floor(F.col("row_id") / 100).alias("page")).agg(F.collect_list(item).alias("items"))
    body = F.to_json("items") if wrap is None else F.to_json(F.struct(F.col("items").alias(wrap)))
    return got.select("source_name", body.alias("payload"))


@query("""
SELECT board AS source_name, id AS posting_id, trim(name) AS title, coalesce(trim(department.label), '') AS department,
 coalesce(nullif(concat_ws(', ', nullif(trim(location.city), ''), nullif(trim(location.country), '')), ''), '') AS location, 'https://apply.workable.com/' || board || '/j/' || id || '/' AS detail_url,
 CASE WHEN location.remote THEN 'Remote' ELSE '' END AS workplace FROM oecd WHERE trim(name) <> ''
""")
def json_reader_workable(spark: SparkSession, sf: str) -> DataFrame:
    """Places as a shown one twice and a hidden one; rows without any have the single location."""
    place = lambda hidden: F.struct(F.col("location.city").alias("city"), F.col("location.country").alias("country"), F.lit(hidden).alias("hidden"))
    hidden = F.struct(F.lit("Hidden").alias("city"), F.lit("Place").alias("country"), F.lit(True).alias("hidden"))
    some = F.col("row_id") % 2 == 0
    item = F.struct(
        F.col("id").alias("shortcode"), F.col("name").alias("title"), F.array(F.col("department.label")).alias("department"), F.when(F.col("location.remote"), "remote").otherwise("on_site").alias("workplace"),
        place(False).alias("location"), F.when(some, F.array(place(False), hidden, place(False))).otherwise(F.array(hidden)).alias("locations"),
    )
    return feeds.read_payloads(pages(table(spark, sf, "oecd"), item, "results"), "workable").select(*SEEN, "workplace")


@query("SELECT board AS source_name, CAST(id AS VARCHAR) AS posting_id, trim(title) AS title, coalesce(trim(requisition_id), '') AS department, coalesce(location.name, '') AS location, coalesce(absolute_url, '') AS detail_url FROM givewell WHERE trim(title) <> ''")
def json_reader_breezy(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(F.col("id").cast("string").alias("id"), F.col("title").alias("name"), F.col("absolute_url").alias("url"), F.col("requisition_id").alias("department"), F.col("location"))
    return feeds.read_payloads(pages(table(spark, sf, "givewell"), item, None), "breezy").select(*SEEN)


@query("""
SELECT board AS source_name, id AS posting_id, trim(title) AS title, coalesce(trim(department), '') AS department, coalesce(trim(location), '') AS location, '/jobs/' || id AS detail_url,
 CASE lower(workplaceType) WHEN 'remote' THEN 'Remote' WHEN 'hybrid' THEN 'Hybrid' ELSE '' END AS workplace, 'About us & you' AS description_text FROM coefficient_giving WHERE trim(title) <> ''
""")
def json_reader_hibob(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(
        "id", "title", "department", F.lit("x").alias("site"), F.col("location").alias("country"), F.col("workplaceType").alias("workspaceTypeId"),
        F.lit("<p>About <b>us</b></p>").alias("description"), F.lit(" ").alias("responsibilities"), F.lit("&amp; you<script>x()</script>").alias("requirements"), F.lit(None).cast("string").alias("benefits"),
    )
    return feeds.read_payloads(pages(table(spark, sf, "coefficient_giving"), item, "jobAdDetails"), "hibob").select(*SEEN, "workplace", "description_text")


@query("""
SELECT board AS source_name, id AS posting_id, trim(title) AS title, coalesce(trim(team), '') AS department, coalesce(trim(location), '') AS location, 'https://x.test/' || id AS detail_url,
 concat_ws(chr(10) || chr(10), nullif(trim(regexp_replace(coalesce(descriptionPlain, ''), '[\\s ]+', ' ', 'g')), ''), 'Tasks' || chr(10) || 'Lead it', 'Tea') AS description_text FROM coefficient_giving WHERE trim(title) <> ''
""")
def json_reader_pinpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Sections: one without a heading, one with, one blank, one whose heading is empty."""
    some = F.col("row_id") % 2 == 0
    where = F.struct(F.when(some, F.col("location")).alias("name"), F.when(~some, F.col("location")).alias("city"), F.col("location").alias("province"))
    item = F.struct(
        "id", "title", F.concat(F.lit("https://x.test/"), F.col("id")).alias("url"), F.col("workplaceType").alias("workplace_type"), where.alias("location"),
        F.struct(F.struct(F.col("team").alias("name")).alias("department")).alias("job"), F.col("descriptionPlain").alias("description"),
        F.lit("<ul><li>Lead it</li></ul>").alias("key_responsibilities"), F.lit("Tasks").alias("key_responsibilities_header"), F.lit("<p> </p>").alias("skills_knowledge_expertise"),
        F.lit("Skills").alias("skills_knowledge_expertise_header"), F.lit("Tea").alias("benefits"), F.lit("").alias("benefits_header"),
    )
    return feeds.read_payloads(pages(table(spark, sf, "coefficient_giving"), item, "data"), "pinpoint").select(*SEEN, "description_text")


@query("""
SELECT board AS source_name, CAST(row_id AS VARCHAR) AS posting_id, trim(name) AS title, coalesce(trim(department.label), '') AS department, coalesce(trim(location.city), '') AS location,
 'https://emp.jobylon.com/jobs/' || row_id || '/' AS detail_url, 'https://emp.jobylon.com/jobs/' || row_id || '/' AS apply_url FROM oecd WHERE trim(name) <> ''
""")
def json_reader_jobylon(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the jobs name their sites, half only have geocoded cities."""
    some, city = F.col("row_id") % 2 == 0, F.col("location.city")
    site = F.struct(F.struct(F.when(some, city).alias("name")).alias("department"))
    layer = lambda c: F.struct(F.struct(c.alias("text")).alias("layer"))
    item = F.struct(
        F.col("row_id").alias("id"), F.col("name").alias("title"), F.array(site, site).alias("departments"), F.array(F.struct(F.struct(city.alias("city")).alias("location"))).alias("locations"),
        F.array(layer(F.lit(" ")), layer(F.col("department.label"))).alias("layers_2"), F.struct(F.lit("").alias("apply")).alias("urls"),
    )
    return feeds.read_payloads(pages(table(spark, sf, "oecd"), item, None), "jobylon").select(*SEEN, "apply_url")


@query("""
WITH d AS (SELECT *, TRY_CAST(substr(trim(fetched_at), 1, 10) AS DATE) AS day FROM path_feed WHERE trim(title) <> '' AND trim(externalPath) <> ''), t AS (SELECT max(day) AS today FROM d)
SELECT board AS source_name, trim(externalPath) AS detail_url, trim(title) AS title, coalesce(trim(timeType), '') AS company FROM d, t WHERE day IS NULL OR date_diff('day', day, today) <= 30
""")
def json_reader_hydra(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "path_feed")
    kept = rows.where((F.trim("title") != "") & (F.trim("externalPath") != ""))
    today = kept.agg(F.max(F.substring(F.trim("fetched_at"), 1, 10).try_cast("date"))).first()[0]
    item = F.struct(
        "title", F.col("externalPath").alias("view_url"), F.col("fetched_at").alias("published_at"), F.struct(F.col("timeType").alias("name")).alias("company"),
        F.struct(F.col("locationsText").alias("city"), F.lit("SE").alias("country")).alias("location"), F.lit("<p>Text</p>").alias("description"),
    )
    return feeds.read_payloads(pages(rows, item, "hydra:member"), "hydra", today=F.lit(today)).select("source_name", "detail_url", "title", "company")


@query("""
WITH p AS (SELECT board AS source_name, page_no AS page, count(*) AS rows FROM path_feed GROUP BY 1, 2), w AS (SELECT *, CASE WHEN page < max(page) OVER (PARTITION BY source_name) THEN page % (CASE WHEN length(source_name) % 3 = 0 THEN 2 ELSE 1000 END) END AS token,
 CASE WHEN length(source_name) % 2 = 0 THEN 300 END AS total FROM p), g AS (SELECT source_name, count(*) AS pages, CAST(sum(rows) AS BIGINT) AS collected, arg_min(coalesce(total, -1), page) AS total, count(token) > count(DISTINCT token) AS round FROM w GROUP BY 1)
SELECT source_name, pages, collected, CASE WHEN round THEN 'round' WHEN total < 0 THEN 'unverified' WHEN collected < total THEN 'short' ELSE 'complete' END AS verdict FROM g
""")
def token_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Walks by tokens: some boards send a token twice, some state no total."""
    from pyspark.sql import Window

    p = table(spark, sf, "path_feed").groupBy(F.col("board").alias("source_name"), F.col("page_no").alias("page")).agg(F.count("*").alias("rows"))
    last = F.max("page").over(Window.partitionBy("source_name"))
    every = F.when(F.length("source_name") % 3 == 0, 2).otherwise(1000)
    p = p.withColumn("token", F.when(F.col("page") < last, F.col("page") % every)).withColumn("total", F.when(F.length("source_name") % 2 == 0, 300))
    return feeds.walked(p).select("source_name", "pages", "collected", "verdict")


@query("""
WITH b AS (SELECT board AS source_name, count(*) FILTER (WHERE trim(coalesce(title, '')) <> '') AS n, bool_or(trim(coalesce(title, '')) = '') AS bad FROM coefficient_giving WHERE coalesce(isListed, true) OR trim(coalesce(title, '')) = '' GROUP BY 1)
SELECT source_name, CASE WHEN bad THEN 0 ELSE n END AS rows_found, NOT bad AS ok FROM b
""")
def source_status(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct("id", "title", "department", "team", "location", "secondaryLocations", "isListed", "publishedAt")
    return feeds.source_status(pages(table(spark, sf, "coefficient_giving"), item, "jobs"), "ashby").select("source_name", "rows_found", "ok")


@query("SELECT g.board AS source_name, CAST(g.id AS VARCHAR) AS posting_id, coalesce(s.company, '') AS company FROM givewell g LEFT JOIN sources s ON s.source_name = g.board WHERE trim(g.title) <> ''")
def company_stamping(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.greenhouse(table(spark, sf, "givewell"), F.col("board"))
    return feeds.stamped(rows, table(spark, sf, "sources")).select("source_name", "posting_id", "company")


# HTML listings: pages of a hundred cards a board, written from the feed in each layout.


def html_postings(spark: SparkSession, sf: str, layout: str, card: Callable[[dict[str, Column]], list[Column | str]], wrap: tuple[str, str] = ("", ""), data: Callable | None = None) -> DataFrame:
    """The postings that a layout's reader finds on pages with a card for each row of the feed."""

    def safe(c: str) -> Column:
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    parts = card({c: safe(c) for c in ("row_id", "title", "department", "location")})
    one = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = table(spark, sf, "coefficient_giving")
    more = [data().alias("data")] if data else []
    got = rows.select("board", F.floor(F.col("row_id") / 100).alias("page"), one.alias("card"), *more).groupBy("board", "page")
    got = got.agg(F.array_join(F.collect_list("card"), "").alias("cards"), F.count("*").alias("n"), *([F.to_json(F.collect_list("data")).alias("data")] if data else []))
    tail = F.replace(F.lit(wrap[1]), F.lit("{n}"), F.col("n").cast("string"))
    tail = F.replace(tail, F.lit("{data}"), F.col("data")) if data else tail
    html = F.concat(F.lit(wrap[0]), F.col("cards"), tail)
    pages_ = got.select(F.col("board").alias("source_name"), F.lit("https://x.test/careers/").alias("url"), html.alias("html"))
    return boards.postings(boards.read_pages(pages_, F.lit(layout)))


def _words(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '[\\s ]+', ' ', 'g'))"


T, D, L = _words("title"), _words("department"), _words("location")
FROM = f"FROM coefficient_giving WHERE {T} <> ''"
PARTS = f"list_filter([{D}, {L}], lambda x: x <> '' AND lower(x) NOT IN ('hybrid', 'remote', 'on-site', 'onsite', 'on site'))"


@query(f"SELECT board AS source_name, {T} AS title, CASE WHEN len({PARTS}) > 1 THEN {PARTS}[-2] ELSE '' END AS department, coalesce({PARTS}[-1], '') AS location, 'https://x.test/jobs/' || row_id AS detail_url {FROM}")
def html_reader_teamtailor(spark: SparkSession, sf: str) -> DataFrame:
    card = lambda r: ['<li><a href="/jobs/', r["row_id"], '"><h3>', r["title"], "</h3><p>", r["department"], " · ", r["location"], "</p></a></li>"]
    return html_postings(spark, sf, "teamtailor", card, ("<ul>", "</ul>")).select("source_name", "title", "department", "location", "detail_url")


@query(f"SELECT board AS source_name, {T} AS title, {L} AS location, 'https://x.test/open-roles/offer/?id=' || row_id AS detail_url {FROM}")
def html_reader_bearingpoint(spark: SparkSession, sf: str) -> DataFrame:
    card = lambda r: ['<a href="/open-roles/offer/?id=', r["row_id"], '"><div class="row"><h3>', r["title"], '</h3><div class="columns job-info">', r["location"], "</div></div></a>"]
    return html_postings(spark, sf, "bearingpoint", card).select("source_name", "title", "location", "detail_url")


@query(f"SELECT board AS source_name, {T} AS title, 'https://x.test/careers/' || row_id AS detail_url {FROM}")
def html_reader_gfi_europe(spark: SparkSession, sf: str) -> DataFrame:
    card = lambda r: ['<a href="', r["row_id"], '">', r["title"], '</a><a href="https://other.test/careers/', r["row_id"], '">elsewhere</a><a href="/about/x">no role</a>']
    return html_postings(spark, sf, "gfi_europe", card).select("source_name", "title", "detail_url")


@query(f"SELECT board AS source_name, {T} AS title, {D} AS department, 'https://x.test/careers/' || row_id AS detail_url {FROM}")
def html_reader_giving_what_we_can(spark: SparkSession, sf: str) -> DataFrame:
    card = lambda r: ['<li><a href="/careers/', r["row_id"], '"><span><span><span>', r["title"], "</span></span><span>Team</span></span><span>", r["department"], "</span></a></li>"]
    return html_postings(spark, sf, "giving_what_we_can", card, ('<section id="open-roles"><ul>', "</ul></section>")).select("source_name", "title", "department", "detail_url")


@query(f"SELECT board AS source_name, {T} AS title, {L} AS location, 'https://x.test/Vacancies/' || row_id || '/x' AS detail_url {FROM}")
def html_reader_mammut(spark: SparkSession, sf: str) -> DataFrame:
    span = '<span class="table-as-list__subtitle">'
    card = lambda r: [f'<tr><td><img></td><td>{span}<a href="/Vacancies/', r["row_id"], '/x">', r["title"], f"</a></span>{span}| Full</span>{span}| ", r["location"], "</span></td></tr>"]
    return html_postings(spark, sf, "mammut", card, ("<table>", "</table>")).select("source_name", "title", "location", "detail_url")


@query(f"SELECT board AS source_name, {T} AS title, 'https://x.test/careers/n.aspx?n=' || row_id AS detail_url {FROM}")
def html_reader_against_malaria(spark: SparkSession, sf: str) -> DataFrame:
    card = lambda r: ["<h3>", r["title"], ' - posted 12th March</h3><p>Text.</p><p><a href="n.aspx?n=', r["row_id"], '">More details</a></p>']
    return html_postings(spark, sf, "against_malaria", card).select("source_name", "title", "detail_url")


@query(f"SELECT board AS source_name, {T} AS title, {L} AS location, 'https://x.test/jobs/apply/' || row_id AS detail_url, CASE WHEN row_id % 2 = 0 THEN 'Do it & well' ELSE '' END AS description_text {FROM}")
def html_reader_asana(spark: SparkSession, sf: str) -> DataFrame:
    """Every other card has its description among the data of the page."""
    card = lambda r: ['<a href="/jobs/apply/', r["row_id"], '"><p>', r["title"], "</p><p>", r["location"], "</p></a>"]
    data = lambda: F.when(F.col("row_id") % 2 == 0, F.struct(F.col("row_id").alias("id"), F.lit("&lt;p&gt;Do &lt;b&gt;it&lt;/b&gt; &amp;amp; well&lt;/p&gt;").alias("content")))
    tail = '<script id="__NEXT_DATA__" type="application/json">{"props":[{"componentName":"greenhouseJobsList","jobs":{data}}]}</script>'
    return html_postings(spark, sf, "asana", card, ("", tail), data).select("source_name", "title", "location", "detail_url", "description_text")


@query(f"SELECT board AS source_name, {T} AS title, {L} AS location, 'https://a.test/' || row_id AS apply_url {FROM}")
def html_reader_pure_earth(spark: SparkSession, sf: str) -> DataFrame:
    head, body = '<div class="card"><div class="card-header"><a>HQ: ', '</a></div><div class="card-body"><p><strong>Localização</strong>: '
    card = lambda r: [head, r["title"], body, r["location"], '</p><p><a href="d.pdf">Job</a></p><p><a href="https://a.test/', r["row_id"], '">Apply now</a></p></div></div>']
    return html_postings(spark, sf, "pure_earth", card, ('<div id="accordion">', "</div>")).select("source_name", "title", "location", "apply_url")


@query("SELECT board AS source_name, 'Chef ' || row_id AS title, 'Visby' AS location, 'https://x.test/careers/' || row_id || '-chef-' || row_id AS detail_url FROM coefficient_giving")
def html_reader_sida(spark: SparkSession, sf: str) -> DataFrame:
    """One page a row, so that the places in the flat array are known; every second page links its ad, none disagrees with the stated total."""
    n = F.col("row_id").cast("string")
    flat = F.concat(F.lit('["https://r.test/?rmjob='), n, F.lit('","Chef '), n, F.lit('","Visby",{"projectNr":0,"url":0,"title":1,"Area2":2}]'))
    link = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit('<a href="/lediga-tjanster/'), n, F.lit("-chef-"), n, F.lit('">Chef</a>'))).otherwise("")
    html = F.concat(link, F.lit('<p>Totalt 1 lediga tjänster</p><script id="__NUXT_DATA__">'), flat, F.lit("</script>"))
    rows = table(spark, sf, "coefficient_giving").select(F.col("board").alias("source_name"), F.lit("https://x.test/lediga-tjanster/").alias("url"), html.alias("html"))
    out = boards.postings(boards.read_pages(rows, F.lit("sida")))
    return out.select("source_name", "title", "location", F.replace("detail_url", F.lit("/lediga-tjanster/"), F.lit("/careers/")).alias("detail_url"))


@query(f"SELECT board AS source_name, {T} AS title, {L} AS location, 'https://x.test/m/JobDetail/x/' || row_id AS detail_url {FROM}")
def html_reader_unops(spark: SparkSession, sf: str) -> DataFrame:
    card = lambda r: ['<article class="article"><h3><a href="/m/JobDetail/x/', r["row_id"], '">', r["title"], '</a></h3><span class="list-item-Duty Station">', r["location"], "</span></article>"]
    return html_postings(spark, sf, "unops", card, ("", "<p>1-6 of {n} results</p>")).select("source_name", "title", "location", "detail_url")


@query(f"SELECT board AS source_name, {T} AS title, {L} AS location, 'https://x.test/jobs/vacant-positions/cvtp-' || row_id || '/' AS detail_url {FROM}")
def html_reader_niras(spark: SparkSession, sf: str) -> DataFrame:
    card = lambda r: ['<a href="/jobs/vacant-positions/cvtp-', r["row_id"], '/"><div><p class="headline">', r["title"], '</p><p class="list-tags">Country: <span>', r["location"], '</span></p><p class="list-tags">Deadline: <span>x</span></p></div></a>']
    return html_postings(spark, sf, "niras", card).select("source_name", "title", "location", "detail_url")


@query(f"SELECT board AS source_name, {T} AS title, {D} AS company, {L} AS location, 'https://x.test/jobs/' || row_id AS detail_url FROM coefficient_giving")
def html_reader_impactpool(spark: SparkSession, sf: str) -> DataFrame:
    """Blank titles stay: leaving them out is the pipeline's business."""
    field = '<div type="bodyEmphasis">'
    card = lambda r: ['<div class="job"><a href="/jobs/', r["row_id"], '"><h3 type="cardTitle">', r["title"], f'</h3><div class="ip-layout">{field}', r["department"], f'</div><div class="ip-layout">{field}', r["location"], f"</div>{field}P-3</div></div></div></a></div>"]
    return html_postings(spark, sf, "impactpool", card).select("source_name", "title", "company", "location", "detail_url")


@query(f"SELECT board AS source_name, count(*) AS rows_found FROM coefficient_giving WHERE {T} <> '' GROUP BY 1")
def html_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "coefficient_giving").where(F.trim("title") != "")
    html = F.concat(F.lit('<h3>'), F.lit("Title - posted x"), F.lit("</h3>"))
    pages_ = rows.select(F.col("board").alias("source_name"), F.lit("https://x.test/").alias("url"), html.alias("html"))
    return boards.status(boards.read_pages(pages_, F.lit("against_malaria"))).select("source_name", "rows_found")


@query(f"SELECT board AS source_name, row_id, lower({L}) = lower({T}) AS misread FROM coefficient_giving WHERE {L} <> '' UNION ALL SELECT board, -row_id - 1, true FROM coefficient_giving WHERE {T} <> ''")
def misread_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The feed's own locations, and the titles cut short in their place."""
    rows = table(spark, sf, "coefficient_giving")
    own = rows.where(F.trim(F.coalesce("location", F.lit(""))) != "").select(F.col("board").alias("source_name"), "row_id", "title", "location")
    cut = rows.where(F.trim(F.coalesce("title", F.lit(""))) != "").select(F.col("board").alias("source_name"), (-F.col("row_id") - 1).alias("row_id"), "title", F.concat(F.substring(F.trim("title"), 1, 4), F.lit("…")).alias("location"))
    both = own.unionByName(cut)
    return both.select("source_name", "row_id", boards.title_read_as_location("title", "location").alias("misread"))
