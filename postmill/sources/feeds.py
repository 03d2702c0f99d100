"""Readers of listing feeds: payload text or parsed tables to one relation of postings.

All give source_name, title, department, location, detail_url, posting_id and posted_at. Blank titles
are skipped. JSON and XML are read with a declared schema; a payload that does not parse gives no
rows and is reported by ``bad_payloads``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import strip, strip_or_empty
from postmill.sources.html import plain_text

POSTING = ("source_name", "posting_id", "title", "department", "location", "detail_url", "posted_at")

GREENHOUSE = "struct<jobs:array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,requisition_id:string,updated_at:string>>>"
ASHBY = (
    "struct<jobs:array<struct<id:string,title:string,department:string,team:string,location:string,"
    "secondaryLocations:array<struct<location:string>>,isListed:boolean,workplaceType:string,publishedAt:string,descriptionPlain:string>>>"
)
SMARTRECRUITERS = (
    "struct<content:array<struct<id:string,name:string,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean,"
    "hybrid:boolean,fullLocation:string>,department:struct<id:string,label:string>,ref:string>>,totalFound:int>"
)
WORKDAY = "struct<total:int,jobPostings:array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>,timeType:string>>>"
LEVER = "array<struct<id:string,text:string,hostedUrl:string,categories:struct<department:string,team:string,location:string>>>"
POSITIONS = "struct<position:array<struct<id:string,name:string,department:string,office:string,createdAt:string>>>"


WORKABLE = (
    "struct<total:int,nextPage:string,results:array<struct<id:bigint,shortcode:string,title:string,department:array<string>,workplace:string,"
    "location:struct<city:string,country:string>,locations:array<struct<city:string,country:string,hidden:boolean>>>>>"
)
BREEZY = "array<struct<id:string,name:string,url:string,department:string,location:struct<name:string>>>"
HIBOB = (
    "struct<jobAdDetails:array<struct<id:string,title:string,department:string,site:string,country:string,workspaceTypeId:string,"
    "description:string,responsibilities:string,requirements:string,benefits:string>>>"
)
PINPOINT = (
    "struct<data:array<struct<id:string,title:string,url:string,workplace_type:string,location:struct<name:string,city:string,province:string>,job:struct<department:struct<name:string>>,"
    "description:string,key_responsibilities:string,key_responsibilities_header:string,skills_knowledge_expertise:string,skills_knowledge_expertise_header:string,benefits:string,benefits_header:string>>>"
)
JOBYLON = (
    "array<struct<id:bigint,title:string,workplaceTypes:string,descr:string,skills:string,urls:struct<apply:string>,departments:array<struct<department:struct<name:string>>>,"
    "locations:array<struct<location:struct<city:string>>>,layers_1:array<struct<layer:struct<text:string>>>,layers_2:array<struct<layer:struct<text:string>>>>>"
)
HYDRA = (
    "struct<`hydra:member`:array<struct<title:string,view_url:string,published_at:string,functions:string,application_url:string,url:string,description:string,"
    "location:struct<city:string,country:string>,company:struct<name:string>>>>"
)


# What some readers give beside POSTING.
MORE = ("company", "workplace", "apply_url", "description_text")


def _posting(df: DataFrame, **columns: Column) -> DataFrame:
    out = df.select(*[columns[c].alias(c) for c in (*POSTING, *MORE) if c in columns])
    return out.where(strip_or_empty("title") != "")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _first(*columns: Column) -> Column:
    """The first of the columns that is not blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(""))


def _list(parts: Column, mark: str = " | ") -> Column:
    """The non-empty parts, each once, in order, joined."""
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, strip), lambda x: x != "")), mark)


def _workplace(c: str) -> Column:
    """The word for a workplace: only remote and hybrid say something."""
    low = F.lower(strip_or_empty(c))
    return F.when(low == "remote", "Remote").when(low == "hybrid", "Hybrid").otherwise("")


def _joined(*columns: str, mark: str = ", ") -> Column:
    return F.array_join(F.filter(F.array(*[strip_or_empty(c) for c in columns]), lambda x: x != ""), mark)


def greenhouse(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of Greenhouse jobs: id, title, absolute_url, location.name, updated_at."""
    return _posting(rows, source_name=source, posting_id=_text("id"), title=F.trim(_text("title")), department=F.lit(""), location=_text("location.name"), detail_url=_text("absolute_url"), posted_at=_text("updated_at"))


def ashby(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of Ashby jobs; unlisted ones are skipped; locations are joined by " | ", each once, in order."""
    places = F.array(F.col("location"))
    more = F.coalesce(F.transform("secondaryLocations", lambda x: x["location"]), F.array().cast("array<string>"))
    where = F.array_join(F.array_distinct(F.filter(F.concat(places, more), lambda x: x.isNotNull() & (x != ""))), " | ")
    rows = rows.where(F.coalesce("isListed", F.lit(True)))
    return _posting(rows, source_name=source, posting_id=_text("id"), title=F.trim(_text("title")), department=F.coalesce(F.nullif("department", F.lit("")), F.col("team"), F.lit("")), location=where, detail_url=F.concat(F.lit("ashby:"), _text("id")), posted_at=_text("publishedAt"))


def smartrecruiters(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of SmartRecruiters postings: name, location.fullLocation or city and country, department.label."""
    full = F.coalesce(F.nullif(F.col("location.fullLocation"), F.lit("")), F.concat_ws(", ", F.nullif(F.col("location.city"), F.lit("")), F.nullif(F.col("location.country"), F.lit(""))))
    return _posting(rows, source_name=source, posting_id=_text("id"), title=F.trim(_text("name")), department=_text("department.label"), location=F.coalesce(full, F.lit("")), detail_url=_text("ref"), posted_at=_text("releasedDate"))


def workday(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of Workday list pages: title, externalPath, locationsText, postedOn, first bullet field."""
    return _posting(rows, source_name=source, posting_id=F.coalesce(F.get("bulletFields", F.lit(0)), F.lit("")), title=F.trim(_text("title")), department=F.lit(""), location=_text("locationsText"), detail_url=_text("externalPath"), posted_at=_text("postedOn"))


def lever(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of Lever postings; the department is categories.department, or else the team."""
    return _posting(rows, source_name=source, posting_id=_text("id"), title=F.trim(_text("text")), department=F.coalesce(F.nullif(F.col("categories.department"), F.lit("")), F.col("categories.team"), F.lit("")), location=_text("categories.location"), detail_url=_text("hostedUrl"), posted_at=F.lit(""))


def positions(rows: DataFrame, source: Column, base: Column | None = None) -> DataFrame:
    """Rows of XML position elements: id, name, department, office, createdAt; without an id none. Links are below ``base``, else ``position:``."""
    link = F.concat(base, F.lit("/job/"), strip_or_empty("id"), F.lit("?language=en")) if base is not None else F.concat(F.lit("position:"), _text("id"))
    rows = rows.where(strip_or_empty("id") != "")
    return _posting(rows, source_name=source, posting_id=_text("id"), title=F.trim(_text("name")), department=_text("department"), location=_text("office"), detail_url=link, posted_at=_text("createdAt"))


def workable(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of Workable results: every place that is not hidden, else the single one; the first department."""
    place = lambda x: F.array_join(F.filter(F.array(F.trim(F.coalesce(x["city"], F.lit(""))), F.trim(F.coalesce(x["country"], F.lit("")))), lambda y: y != ""), ", ")
    shown = _list(F.transform(F.filter("locations", lambda x: ~F.coalesce(x["hidden"], F.lit(False))), place))
    where = _first(shown, F.when(F.col("location").isNotNull(), place(F.col("location"))))
    code = strip_or_empty("shortcode")
    link = F.when(code != "", F.concat(F.lit("https://apply.workable.com/"), source, F.lit("/j/"), code, F.lit("/"))).otherwise("")
    return _posting(rows, source_name=source, posting_id=_first(F.col("shortcode"), F.col("id").cast("string")), title=strip_or_empty("title"), department=strip_or_empty(F.get("department", F.lit(0))), location=where, detail_url=link, posted_at=F.lit(""), workplace=_workplace("workplace"))


def breezy(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of Breezy positions: name, department, location.name, url."""
    return _posting(rows, source_name=source, posting_id=_text("id"), title=strip_or_empty("name"), department=strip_or_empty("department"), location=_text("location.name"), detail_url=_text("url"), posted_at=F.lit(""))


def hibob(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of HiBob ads: the location is the country; the four sections are one text."""
    sections = ("description", "responsibilities", "requirements", "benefits")
    text = plain_text(_joined(*sections, mark=" "))
    return _posting(rows, source_name=source, posting_id=strip_or_empty("id"), title=strip_or_empty("title"), department=strip_or_empty("department"), location=strip_or_empty("country"), detail_url=F.concat(F.lit("/jobs/"), strip_or_empty("id")), posted_at=F.lit(""), workplace=_workplace("workspaceTypeId"), description_text=text)


def pinpoint(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of Pinpoint postings: the place's name, else city and province; sections after their headings, a blank line between."""
    parts = []
    for c, head in (("description", None), ("key_responsibilities", "key_responsibilities_header"), ("skills_knowledge_expertise", "skills_knowledge_expertise_header"), ("benefits", "benefits_header")):
        text = plain_text(_text(c))
        title = strip_or_empty(head) if head else F.lit("")
        parts.append(F.when(text == "", "").when(title == "", text).otherwise(F.concat(title, F.lit("\n"), text)))
    body = F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")
    where = _first(F.col("location.name"), _list(F.array(_text("location.city"), _text("location.province")), ", "))
    return _posting(rows, source_name=source, posting_id=_text("id"), title=strip_or_empty("title"), department=strip_or_empty("job.department.name"), location=where, detail_url=strip_or_empty("url"), posted_at=F.lit(""), workplace=_workplace("workplace_type"), description_text=body)


def jobylon(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of Jobylon jobs: the places are the departments, else the cities; the department is the first text of the second layer."""
    sites, cities = F.transform("departments", lambda x: x["department"]["name"]), F.transform("locations", lambda x: x["location"]["city"])
    layer = F.get(F.filter(F.transform("layers_2", lambda x: F.trim(F.coalesce(x["layer"]["text"], F.lit("")))), lambda x: x != ""), F.lit(0))
    ad = F.concat(F.lit("https://emp.jobylon.com/jobs/"), _text("id"), F.lit("/"))
    text = F.trim(F.concat_ws(" ", F.nullif(plain_text(_text("descr")), F.lit("")), F.nullif(plain_text(_text("skills")), F.lit(""))))
    return _posting(rows, source_name=source, posting_id=_text("id"), title=strip_or_empty("title"), department=F.coalesce(layer, F.lit("")), location=_first(_list(sites), _list(cities)), detail_url=ad, posted_at=F.lit(""), workplace=_workplace("workplaceTypes"), apply_url=_first(F.col("urls.apply"), ad), description_text=text)


# Fixed value: days after which a posting of a search walk is stale.
STALE_DAYS = 30


def age_days(published: Column, today: Column) -> Column:
    """Whole days since the UTC date of an ISO time; null where it does not parse."""
    return F.date_diff(today, F.substring(strip(published), 1, 10).try_cast("date"))


def hydra(rows: DataFrame, source: Column, *, today: Column | None = None, city: str = "Lund") -> DataFrame:
    """Rows of a hydra search walk: postings older than STALE_DAYS are left out, those without a readable date kept; each has its company."""
    old = age_days(F.col("published_at"), F.current_date() if today is None else today) > STALE_DAYS
    rows = rows.where(~F.coalesce(old, F.lit(False)) & (strip_or_empty("view_url") != ""))
    where = F.concat_ws(", ", F.initcap(_first(F.col("location.city"), F.lit(city))), F.nullif(strip_or_empty("location.country"), F.lit("")))
    return _posting(rows, source_name=source, posting_id=strip_or_empty("view_url"), title=strip_or_empty("title"), department=strip_or_empty("functions"), location=where, detail_url=strip_or_empty("view_url"), posted_at=_text("published_at"), company=strip_or_empty("company.name"), apply_url=_first(F.col("application_url"), F.col("url"), F.col("view_url")), description_text=plain_text(_text("description")))


READERS = {
    "greenhouse": (GREENHOUSE, "jobs", greenhouse),
    "ashby": (ASHBY, "jobs", ashby),
    "smartrecruiters": (SMARTRECRUITERS, "content", smartrecruiters),
    "workday": (WORKDAY, "jobPostings", workday),
    "lever": (LEVER, None, lever),
    "positions": (POSITIONS, "position", positions),
    "workable": (WORKABLE, "results", workable),
    "breezy": (BREEZY, None, breezy),
    "hibob": (HIBOB, "jobAdDetails", hibob),
    "pinpoint": (PINPOINT, "data", pinpoint),
    "jobylon": (JOBYLON, None, jobylon),
    "hydra": (HYDRA, "hydra:member", hydra),
}
# Fields without which a posting of a platform cannot be read: a page that holds such a one is bad, not shorter.
REQUIRED = {"ashby": ("id", "title"), "workable": ("title",), "hibob": ("id", "title"), "pinpoint": ("title", "url"), "jobylon": ("id", "title")}


def _parsed(platform: str, payload: str) -> Column:
    """The list of postings of a payload; null where it does not parse or has none."""
    schema, items, _ = READERS[platform]
    parsed = F.from_xml(payload, schema) if platform == "positions" else F.from_json(payload, schema)
    return parsed.getField(items) if items else parsed


def read_payloads(pages: DataFrame, platform: str, *, source: str = "source_name", payload: str = "payload", **options: object) -> DataFrame:
    """Postings of raw payloads (one page a row) of a platform; ``options`` go to its reader."""
    rows = pages.select(F.col(source).alias("__source"), _parsed(platform, payload).alias("__l"))
    rows = rows.select("__source", F.explode("__l").alias("__i")).select("__source", "__i.*")
    return READERS[platform][2](rows, F.col("__source"), **options)


def bad_payloads(pages: DataFrame, platform: str, *, source: str = "source_name", payload: str = "payload") -> DataFrame:
    """Per source: pages, and pages whose payload does not parse, lacks its list or holds a posting without a required field."""
    listed = _parsed(platform, payload)
    lacks = [lambda x, name=c: strip_or_empty(x[name].cast("string")) == "" for c in REQUIRED.get(platform, ())]
    bad = listed.isNull()
    if lacks:
        bad = bad | F.coalesce(F.exists(listed, lambda x: reduce(lambda a, b: a | b, [f(x) for f in lacks])), F.lit(False))
    return pages.groupBy(source).agg(F.count("*").alias("pages"), F.count_if(bad).alias("bad"))


def source_status(pages: DataFrame, platform: str, *, source: str = "source_name", payload: str = "payload") -> DataFrame:
    """A health row per source: rows_found, ok and error; a bad page fails its own source only, which then has no rows."""
    bad = bad_payloads(pages, platform, source=source, payload=payload).select(source, "bad")
    found = read_payloads(pages, platform, source=source, payload=payload).groupBy(F.col("source_name").alias(source)).agg(F.count("*").alias("n"))
    both = bad.join(found, source, "left")
    ok = F.col("bad") == 0
    return both.select(source, F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).alias("rows_found"), ok.alias("ok"), F.when(~ok, F.format_string("%d pages could not be read", F.col("bad"))).alias("error"))


def walked(pages: DataFrame, *, source: str = "source_name", page: str = "page", token: str = "token", rows: str = "rows", total: str = "total", most: int = 100) -> DataFrame:
    """Per source how a walk by tokens ended: complete, short of the first page's total, going round (a token came twice), at the limit of pages, or unverified."""
    first = F.min_by(total, page)
    per = pages.groupBy(source).agg(
        F.count("*").alias("pages"), F.sum(rows).alias("collected"), first.alias("total"), (F.count(token) > F.count_distinct(token)).alias("round"), F.max_by(token, page).isNotNull().alias("open")
    )
    verdict = F.when(F.col("round"), "round").when(F.col("open") & (F.col("pages") >= most), "limit").when(F.col("total").isNull(), "unverified").when(F.col("collected") < F.col("total"), "short").otherwise("complete")
    return per.select(source, "pages", "collected", "total", verdict.alias("verdict"))


def stamped(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Postings with the company of their configured source where the reader left none."""
    known = sources.select("source_name", F.col("company").alias("__company"))
    has = "company" in postings.columns
    own = F.nullif(strip(F.col("company")), F.lit("")) if has else F.lit(None).cast("string")
    both = postings.join(known, "source_name", "left").withColumn("company", F.coalesce(own, F.col("__company"), F.lit("")))
    return both.drop("__company")


def reconciled(collected: DataFrame, stated: DataFrame, *, source: str = "source_name") -> DataFrame:
    """Per source whether a walk is complete: fewer rows than stated fail it, more are fine, no total only warns."""
    n = collected.groupBy(source).agg(F.count("*").alias("collected"))
    both = stated.join(n, source, "left").withColumn("collected", F.coalesce("collected", F.lit(0)))
    verdict = F.when(F.col("total").isNull(), "unverified").when(F.col("collected") < F.col("total"), "short").otherwise("complete")
    return both.select(source, "collected", "total", verdict.alias("verdict"))
