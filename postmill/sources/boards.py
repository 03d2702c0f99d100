"""Readers of HTML listings: a page to rows, by the structure of each layout.

A reader takes the tree of a page and its address and gives rows of title, department, location,
detail_url, apply_url and description_text. A page that a reader does not understand raises; the
error becomes the status of that page and its source, and other sources go on.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import fold_case, strip_or_empty
from postmill.sources.dom import Node, parse

FIELDS = ("title", "department", "location", "detail_url", "apply_url", "description_text", "company")
Row = dict[str, str]


class Unreadable(ValueError):
    """The page does not have the shape that its reader knows."""


def row(title: str, url: str, *, location: str = "", department: str = "", apply_url: str = "", text: str = "", company: str = "") -> Row:
    return dict(zip(FIELDS, (title, department, location, url, apply_url or url, text, company)))


def read_as_place(title: str, location: str) -> bool:
    """Whether a location is the title itself or the title cut short: then the reader took the wrong element."""
    t, where = title.strip().casefold(), location.strip().casefold()
    bare = where.rstrip(".…").rstrip()
    return bool(bare) and (bare == t.rstrip(".…").rstrip() or where != bare and t.startswith(bare))


def title_read_as_location(title: Column | str, location: Column | str) -> Column:
    """read_as_place() for columns."""
    t, where = fold_case(strip_or_empty(title)), fold_case(strip_or_empty(location))
    bare = F.regexp_replace(where, r"[.…\s]+$", "")
    return (bare != "") & ((bare == F.regexp_replace(t, r"[.…\s]+$", "")) | ((where != bare) & F.startswith(t, bare)))


def links(page: Node, url: str, test: Callable[[str], bool]) -> Iterator[tuple[Node, str]]:
    """Anchors whose address fits, with the address in full; each address once."""
    seen = set()
    for a in page.all("a", lambda n: bool(n.get("href"))):
        if test(a.get("href")):
            full = urljoin(url, a.get("href").strip())
            if full not in seen:
                seen.add(full)
                yield a, full


def _text(n: Node | None) -> str:
    return n.text() if n is not None else ""


# Words for where work is done, on cards that do not mark them.
WORK_TYPES = {"hybrid", "remote", "on-site", "onsite", "on site"}


def _details(n: Node | None) -> tuple[str, str]:
    """(department, location) of a card's details: the last two parts that are no type of work, read from the end."""
    if n is None:
        return "", ""
    spans = [c for c in n.elements() if c.tag == "span"]
    if spans:
        # A type of work has an icon in its span; a divider is a dot alone.
        parts = [s.text() for s in spans if s.text() not in ("", "·") and s.first("i") is None]
    else:
        parts = [p for p in map(str.strip, n.text().split("·")) if p and p.casefold() not in WORK_TYPES]
    return (parts[-2] if len(parts) > 1 else ""), (parts[-1] if parts else "")


def teamtailor(page: Node, url: str) -> list[Row]:
    """Cards that link /jobs/<number>: the title is a heading, a span with a title, the first block or the anchor's text; details lie in or beside it."""
    out = []
    for a, full in links(page, url, lambda h: re.search(r"/jobs/\d+", h) is not None):
        blocks = [c for c in a.elements() if c.tag == "div"]
        heading, span = a.first("h3"), a.first("span", lambda n: bool(n.get("title")))
        title = _text(heading) if heading is not None else span.get("title").strip() if span is not None else (blocks[0].text() if blocks else a.text())
        if not title:
            continue
        details = a.first("p")
        if details is None and heading is None and span is not None and span.parent is not a:
            details = next((n for n in span.after() if n.tag == "div"), None)
        if details is None and blocks and (len(blocks) > 1 or heading is None and span is not None):
            details = blocks[-1]
        if details is None and a.parent is not None:
            details = a.parent.first("p") or next((n for n in a.parent.elements() if n.tag == "div" and n.text()), None)
        department, location = _details(details)
        if read_as_place(title, location):
            raise Unreadable(f"the title {title!r} stands where a place should")
        out.append(row(title, full, location=location, department=department))
    return out


def bearingpoint(page: Node, url: str) -> list[Row]:
    """Anchors of offers with a heading and a paragraph or a block of job-info."""
    out = []
    for a, full in links(page, url, lambda h: "/open-roles/offer/" in h):
        title = _text(a.first("h3")) or a.text()
        if title:
            out.append(row(title, full, location=_text(a.first("p") or a.first("div", lambda n: n.has_class("job-info")))))
    return out


def gfi_europe(page: Node, url: str) -> list[Row]:
    """Anchors on the page's own host whose path lies below /careers/."""
    out = []
    for a, full in links(page, url, lambda h: True):
        parts = urlsplit(full)
        if parts.netloc == urlsplit(url).netloc and parts.path.startswith("/careers/") and parts.path.rstrip("/") != "/careers" and a.text():
            out.append(row(a.text(), full))
    return out


def giving_what_we_can(page: Node, url: str) -> list[Row]:
    """Rows of the section open-roles: the title is the innermost first span of the first column, the department the second column."""
    section = page.first("section", lambda n: n.get("id") == "open-roles")
    anchors = section.all("a", lambda n: bool(n.get("href")) and n.parent is not None and n.parent.tag == "li") if section else []
    if not anchors:
        raise Unreadable("no section of open roles" if section is None else "the section lists no roles")
    out = []
    for a in anchors:
        columns = [c for c in a.elements() if c.tag == "span"]
        n = columns[0] if columns else None
        while n is not None and any(c.tag == "span" for c in n.elements()):
            n = next(c for c in n.elements() if c.tag == "span")
        if not _text(n):
            raise Unreadable(f"the role {a.get('href')!r} has no title")
        out.append(row(_text(n), urljoin(url, a.get("href").strip()), department=_text(columns[1]) if len(columns) > 1 else ""))
    return out


def mammut(page: Node, url: str) -> list[Row]:
    """Table rows with a vacancy link; the location is the third subtitle of the cell, without its bar."""
    out = []
    for a, full in links(page, url, lambda h: re.search(r"/Vacancies/\d+", h) is not None):
        cell = a.above("td")
        subtitles = cell.all("span", lambda n: n.has_class("table-as-list__subtitle")) if cell is not None else []
        if a.text():
            out.append(row(a.text(), full, location=subtitles[2].text().lstrip("|").strip() if len(subtitles) > 2 else ""))
    return out


def against_malaria(page: Node, url: str) -> list[Row]:
    """Headings "Title - posted date" with the nearest link after them."""
    out = []
    for h in page.all("h3"):
        title = re.sub(r"\s*-\s*posted\s.*$", "", h.text(), flags=re.I).strip()
        link = next((a for n in h.after() for a in n.all("a", lambda x: bool(x.get("href")))), None)
        if title:
            out.append(row(title, urljoin(url, link.get("href")) if link is not None else url))
    return out


def embedded(page: Node, script_id: str) -> object:
    """The JSON of a page's script; None where there is none."""
    script = page.first("script", lambda n: n.get("id") == script_id)
    try:
        return json.loads(script.raw()) if script is not None else None
    except ValueError as e:
        raise Unreadable(f"the data of {script_id} are no JSON") from e


def found(data: object, test: Callable[[dict], bool]) -> Iterator[dict]:
    """All objects anywhere in JSON data that pass a test."""
    stack = [data]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if test(x):
                yield x
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def asana(page: Node, url: str) -> list[Row]:
    """Cards with two paragraphs, joined to the descriptions embedded in the page by the number in their link; a card without one has none."""
    try:
        data = embedded(page, "__NEXT_DATA__")
    except Unreadable:
        data = None
    texts = {
        str(job.get("id")): parse(html.unescape(str(job.get("content") or ""))).text()
        for part in found(data, lambda x: x.get("componentName") == "greenhouseJobsList")
        for job in part.get("jobs") or []
        if isinstance(job, dict)
    }
    out = []
    for a, full in links(page, url, lambda h: "/jobs/apply/" in h):
        parts = [c.text() for c in a.elements() if c.tag == "p"]
        number = re.search(r"/jobs/apply/(\d+)", full)
        if parts and parts[0]:
            out.append(row(parts[0], full, location=parts[1] if len(parts) > 1 else "", text=texts.get(number[1], "") if number else ""))
    return out


def pure_earth(page: Node, url: str) -> list[Row]:
    """Cards of an accordion: "Unit: Title" headers, a labelled location, the link to apply or else a document."""
    accordion = page.first(test=lambda n: n.get("id") == "accordion")
    cards = accordion.all("div", lambda n: n.has_class("card")) if accordion is not None else []
    if not cards:
        raise Unreadable("no accordion of cards")
    out: dict[str, Row] = {}
    for i, card in enumerate(cards, 1):
        head, body = (card.first("div", lambda n, c=c: n.has_class(c)) for c in ("card-header", "card-body"))
        if head is None or body is None:
            raise Unreadable(f"card {i} has no header or body")
        unit = re.match(r"[^:]{1,40}:\s+(?=\S)", head.text())
        title = head.text()[unit.end() :] if unit else head.text()
        labelled = (re.match(r"(?:location|localização)\s*:?\s*(.*)$", p.text(), re.I) for p in body.all("p"))
        where = next((m[1].lstrip(": ").strip() for m in labelled if m), None)
        anchors = body.all("a", lambda n: bool(n.get("href")))
        apply_to = next((a.get("href") for a in anchors if a.text().casefold() == "apply now"), "")
        document = next((a.get("href") for a in anchors if a.get("href").split("?")[0].lower().endswith(".pdf")), "")
        if where is None or not title or not (apply_to or document) or read_as_place(title, where):
            raise Unreadable(f"card {i} has no title, place or link")
        out.setdefault(apply_to or document, row(title, apply_to or document, location=where, apply_url=apply_to, text=body.text()))
    return list(out.values())


def slug(title: str) -> str:
    """A title as the end of an address: lower case, å ä ö as a a o, other signs as single hyphens."""
    return re.sub(r"[^a-z0-9]+", "-", title.lower().translate(str.maketrans("åäö", "aao"))).strip("-")


def sida(page: Node, url: str) -> list[Row]:
    """Ads in a flat array whose objects hold places in it; addresses are built by a rule that the page's own links prove, and the stated total must agree."""
    flat = embedded(page, "__NUXT_DATA__")
    if flat is not None and not isinstance(flat, list):
        raise Unreadable("the embedded data are no array")

    def value(ad: dict, name: str) -> str:
        at = ad.get(name)
        if name not in ad:
            return ""
        if not isinstance(at, int) or not 0 <= at < len(flat) or not isinstance(flat[at], str):
            raise Unreadable(f"{name} of an ad is no text")
        return flat[at].strip()

    ads: dict[str, tuple[str, str]] = {}
    for ad in (x for x in flat or [] if isinstance(x, dict) and "projectNr" in x):
        number, title = re.search(r"rmjob=(\d+)", value(ad, "url")), value(ad, "title")
        if number is None or not title:
            raise Unreadable("an ad has no number or no title")
        ads.setdefault(number[1], (title, value(ad, "Area2")))
    linked: dict[str, str] = {}
    for _, full in links(page, url, lambda h: re.search(r"/lediga-tjanster/\d+-", h) is not None):
        linked.setdefault(re.search(r"/lediga-tjanster/(\d+)-", full)[1], full)
    totals = (re.search(r"Totalt\s+(\d+)\s+lediga\s+tjänster", p.text()) for p in page.all("p"))
    total = next((int(m[1]) for m in totals if m), None)
    if total is None or total != len(ads) or set(linked) - set(ads):
        raise Unreadable(f"{total} stated, {len(ads)} in the data, {len(set(linked) - set(ads))} linked that are not in it")
    out = []
    for number, (title, place) in ads.items():
        built, plain = urljoin(url, f"{number}-{slug(title)}"), re.fullmatch(r"[\x00-\x7fåäöÅÄÖ]*", title)
        if plain and linked.get(number, built) != built or not plain and number not in linked:
            raise Unreadable(f"the address of {title!r} cannot be built by the rule")
        out.append(row(title, linked.get(number, built), location=place))
    if out and not any(r["location"] for r in out):
        raise Unreadable("no ad has a place")
    return out


def unops(page: Node, url: str) -> list[Row]:
    """Articles with a link to JobDetail; the place is the span of the duty station."""
    out = []
    for article in page.all("article"):
        a = article.first("a", lambda n: "JobDetail" in n.get("href"))
        if a is not None and a.text():
            station = article.first("span", lambda n: n.get("class").split() == ["list-item-Duty", "Station"])
            out.append(row(a.text(), urljoin(url, a.get("href")), location=_text(station)))
    return out


def unops_total(page: Node) -> int | None:
    """The "N" of "1-6 of N results", or of a label that is "N results" and nothing else."""
    m = re.search(r"\bof\s+(\d[\d,\s]*)\s+results\b", page.text(), re.I)
    labels = (re.fullmatch(r"\s*(\d[\d,\s]*?)\s+results\s*", n.get("aria-label"), re.I) for n in page.walk() if n.get("aria-label"))
    m = m or next((x for x in labels if x), None)
    return int(re.sub(r"\D", "", m[1])) if m else None


def niras(page: Node, url: str) -> list[Row]:
    """Cards of one anchor: the headline paragraph and the element that begins with "Country:"."""
    out = []
    for a, full in links(page, url, lambda h: "/jobs/vacant-positions/cvtp" in h):
        headline = a.first("p", lambda n: n.has_class("headline")) or next((c for c in a.elements() if c.text()), a)
        country = next((t[len("Country:") :].strip() for t in (n.text() for n in a.walk()) if t.startswith("Country:")), "")
        if headline.text():
            out.append(row(headline.text(), full, location=country))
    return out


def niras_total(page: Node) -> int | None:
    figures = re.sub(r"\D", "", _text(page.first("span", lambda n: n.has_class("filter-result-text"))))
    return int(figures) if figures else None


def impactpool(page: Node, url: str) -> list[Row]:
    """Cards by the roles of their fields: title, organisation, and a place unless there is only a grade; a blank title is kept for the pipeline to leave out."""
    out: dict[str, Row] = {}
    for card in page.all("div", lambda n: n.has_class("job")):
        a = card.first("a")
        if a is None or not a.get("href").startswith("/jobs/"):
            continue
        title = a.first(test=lambda n: n.get("type") == "cardTitle")
        outer = next((c for c in a.elements() if c.has_class("ip-layout")), None)
        inner = next((c for c in outer.elements() if c.has_class("ip-layout")), None) if outer is not None else None
        fields = [[c.text() for c in n.elements() if c.get("type") == "bodyEmphasis"] if n is not None else [] for n in (outer, inner)]
        if title is None or len(fields[0]) != 1 or len(fields[1]) not in (1, 2):
            raise Unreadable(f"the card {a.get('href')!r} has other fields than the reader knows")
        full = urljoin(url, a.get("href"))
        out.setdefault(full, row(title.text(), full, location=fields[1][0] if len(fields[1]) == 2 else "", company=fields[0][0]))
    return list(out.values())


READERS: dict[str, Callable[[Node, str], list[Row]]] = {
    "teamtailor": teamtailor, "bearingpoint": bearingpoint, "gfi_europe": gfi_europe, "giving_what_we_can": giving_what_we_can, "mammut": mammut,
    "against_malaria": against_malaria, "asana": asana, "pure_earth": pure_earth, "sida": sida,
    "unops": unops, "niras": niras, "impactpool": impactpool,
}
# Layouts that state how many postings there are; a total counts only on a page that shows some.
TOTALS: dict[str, Callable[[Node], int | None]] = {"unops": unops_total, "niras": niras_total}
RESULT = "rows array<struct<" + ",".join(f"{c}:string" for c in FIELDS) + ">>, stated int, error string"


def read_pages(pages: DataFrame, layout: Column | str, *, source: str = "source_name", url: str = "url", payload: str = "html") -> DataFrame:
    """Pages with their rows, or the error that kept them from being read: (source, url, rows, stated, error).

    ``layout`` names each page's reader; stated is the total that the page states, if its layout has one.
    """
    kind = pages.schema[source].dataType.simpleString()
    asked = pages.select(F.col(source).alias("s"), F.col(url).alias("u"), F.col(payload).alias("p"), (F.col(layout) if isinstance(layout, str) else layout).alias("l"))

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for s, u, p, name in zip(pdf["s"], pdf["u"], pdf["p"], pdf["l"]):
                rows, stated, error = [], None, None
                try:
                    if name not in READERS:
                        raise Unreadable(f"no reader is called {name!r}")
                    tree = parse(p if isinstance(p, str) else "")
                    rows = READERS[name](tree, u if isinstance(u, str) else "")
                    stated = TOTALS[name](tree) if rows and name in TOTALS else None
                except ValueError as e:
                    error = str(e)
                out.append((s, u, rows, stated, error))
            yield pd.DataFrame(out, columns=["s", "u", "rows", "stated", "error"]).astype({"stated": "Int32"})

    done = asked.mapInPandas(read, f"s {kind}, u string, {RESULT}")
    return done.select(F.col("s").alias(source), F.col("u").alias(url), "rows", "stated", "error")


def postings(read: DataFrame, *, source: str = "source_name") -> DataFrame:
    """The rows of read pages, each address once a source: source and FIELDS."""
    rows = read.select(source, F.explode("rows").alias("r")).select(source, "r.*")
    first = rows.groupBy(source, "detail_url").agg(F.min(F.struct(*[c for c in FIELDS if c != "detail_url"])).alias("r"))
    return first.select(source, *[F.col("detail_url") if c == "detail_url" else F.col(f"r.{c}").alias(c) for c in FIELDS])


def status(read: DataFrame, *, source: str = "source_name") -> DataFrame:
    """A health row per source: a page that could not be read, or fewer addresses than a page states, fails its source, which then has no rows.

    rows_found counts the rows of all pages, the total is held against their different addresses.
    """
    g = read.groupBy(source).agg(F.sum(F.size("rows")).alias("n"), F.max("stated").alias("stated"), F.min("error").alias("bad"))
    unique = read.where("stated IS NOT NULL").select(source, F.explode("rows.detail_url").alias("a")).distinct().groupBy(source).agg(F.count("*").alias("unique"))
    both = g.join(unique, source, "left")
    short = F.when(F.col("unique") < F.col("stated"), F.format_string("%d of %d postings", F.col("unique"), F.col("stated")))
    error = F.coalesce("bad", short)
    return both.select(source, F.when(error.isNull(), F.col("n")).otherwise(0).alias("rows_found"), error.isNull().alias("ok"), error.alias("error"))
