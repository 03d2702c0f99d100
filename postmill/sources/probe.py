"""What a listing page shows of its postings: links, cards, embedded data, a stated total, signs of more pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.sources.dom import Node, parse

# Words for postings in addresses and totals, and last parts of addresses that are no posting.
IN_PATHS = "jobs? job-?details? positions? vacanc(?:y|ies) openings? postings? requisitions? stellen(?:angebote)? lediga-jobb".split()
IN_QUERIES = "gh_jid jobid job_id reqid requisitionid jid".split()
NO_POSTING = set("search page category categories department departments locations location alerts alert saved all list index feed rss".split())
COUNTED = "(?:jobs?|positions?|vacanc(?:y|ies)|openings?|roles?|results?)"
PAYLOADS = ("window.__appData", "__NEXT_DATA__", "__NUXT__", "__INITIAL_STATE__")
MOUNTS = ("root", "app", "__next", "__nuxt", "main-app")
PAGE_WORDS = "page startrow offset start pg".split()

_PATH = re.compile(rf"/(?:{'|'.join(IN_PATHS)})/([^/?#]{{2,}})", re.I)
_QUERY = re.compile(rf"[?&](?:{'|'.join(IN_QUERIES)})=", re.I)
_CARD = re.compile(r"\b(?:job[-_]?(?:card|tile|item|listing|row|post(?:ing)?|result|teaser)|vacanc(?:y|ies)[-_]?(?:card|item|row))s?\b", re.I)
_N = r"(\d[\d,]*)"
_RANGE = re.compile(rf"(?:(?:results|showing|jobs?|positions?)\s+{_N}\s*(?:to|-|–)\s*{_N}\s+of\s+{_N})|(?:{_N}\s*(?:to|-|–)\s*{_N}\s+of\s+{_N}\s+{COUNTED})", re.I)
_SAID = (re.compile(rf"{_N}\s+(?:open\s+)?{COUNTED}\s+found", re.I), re.compile(rf"(?:vacant positions|open positions|jobs|vacancies)\s*:\s*{_N}\b", re.I))
_HEADING = re.compile(rf"{_N}\s+(?:open\s+)?(?:jobs?|positions?|vacanc(?:y|ies)|openings?|roles?)", re.I)
_IN_JSON = re.compile(r'"(?:totalFound|totalJobs|totalCount|total_count)"\s*:\s*(\d+)')
_LATER = re.compile(rf"[?&](?:{'|'.join(PAGE_WORDS)})=(\d+)", re.I)
_PAGER = re.compile(r"paginat|pager\b|paging", re.I)
_MORE = re.compile(r"(?:load|show|see|view)\s+more(?:\s+(?:jobs|results|positions|vacancies|roles))?", re.I)
_LD = re.compile(r'"@type"\s*:\s*"JobPosting"', re.I)
_ARRAY = re.compile(r'"(?:jobPostings|jobs|postings|vacancies|positions)"\s*:\s*\[\s*\{')
_NEEDS_SCRIPT = re.compile(r"enable\s+javascript|requires?\s+javascript", re.I)


def stated_total(page: Node, html: str) -> tuple[int | None, int | None]:
    """(total, page size) as the page states them: a range, a number found, a labelled one, a heading, its data; the first that is there."""
    texts = [page.text(), *(n.get("aria-label") for n in page.walk() if n.get("aria-label"))]
    number = lambda s: int(s.replace(",", ""))
    for t in texts:
        if m := _RANGE.search(t):
            last, total = [g for g in m.groups() if g][-2:]
            return number(total), number(last)
    for rx in _SAID:
        for t in texts:
            if m := rx.search(t):
                return number(m[1]), None
    for h in page.walk():
        if h.tag in ("h1", "h2", "h3") and (m := _HEADING.fullmatch(h.text())):
            return number(m[1]), None
    m = _IN_JSON.search(html)
    return (int(m[1]) if m else None), None


def pager_signs(page: Node) -> list[str]:
    """What says that there is more than one page: next link, pager element, link to a later page, control for more."""
    nodes = list(page.walk())
    names = lambda n: f"{n.get('class')} {n.get('id')} {n.get('aria-label')}"
    later = (m for n in nodes if n.tag == "a" and (m := _LATER.search(n.get("href"))))
    signs = {
        "next link": any(n.tag in ("a", "link") and "next" in n.get("rel").split() for n in nodes),
        "pager": any(_PAGER.search(names(n)) for n in nodes),
        "later page": any(int(m[1]) > 1 for m in later),
        "more": any(n.tag in ("a", "button") and _MORE.fullmatch(n.text()) for n in nodes),
    }
    return [k for k, there in signs.items() if there]


def is_posting(href: str) -> bool:
    m = _PATH.search(href)
    return m[1].casefold() not in NO_POSTING if m else _QUERY.search(href) is not None


SCAN = (
    "posting_links int, cards int, json_ld int, payloads array<string>, job_array boolean, visible_chars int, shell array<string>, total int, page_size int, pager array<string>, has_postings boolean"
)


def scan(html: str) -> tuple:
    """The columns of SCAN for one page."""
    page = parse(html)
    nodes = list(page.walk())
    hrefs = {n.get("href").strip() for n in nodes if n.tag == "a" and n.get("href")}
    cards = {id(n) for n in nodes if _CARD.search(f"{n.get('class')} {n.get('id')}") or n.get("data-automation-id") == "jobTitle"}

    def inside(n: Node) -> bool:
        while (n := n.parent) is not None:
            if id(n) in cards:
                return True
        return False

    outer = sum(id(n) in cards and not inside(n) for n in nodes)
    payloads = [p for p in PAYLOADS if p in html]
    shell = ["noscript"] if any(n.tag == "noscript" and _NEEDS_SCRIPT.search(n.text()) for n in nodes) else []
    shell += [f"empty {m}" for m in MOUNTS if any(n.get("id") == m and not n.text() for n in nodes)]
    hidden = sum(len(n.text()) + 1 for n in nodes if n.tag == "noscript" and n.text())
    links, ld, array = sum(map(is_posting, hrefs)), len(_LD.findall(html)), _ARRAY.search(html) is not None
    there = bool(links or outer or ld or payloads and array)
    return links, outer, ld, payloads, array, max(0, len(page.text()) - hidden), shell, *stated_total(page, html), pager_signs(page), there


def scan_pages(pages: DataFrame, *, key: str = "url", html: str = "html") -> DataFrame:
    """(key and the columns of SCAN) for each page; a null page is an empty one."""
    kind = pages.schema[key].dataType.simpleString()

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, *scan(h if isinstance(h, str) else "")) for k, h in zip(pdf["k"], pdf["h"])]
            out = pd.DataFrame(rows, columns=["k", *(x.split()[0] for x in SCAN.split(", "))])
            yield out.astype({"total": "Int32", "page_size": "Int32"})

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(read, f"k {kind}, {SCAN}").withColumnRenamed("k", key)


# What gives away the platform behind a page, and where its boards lie; in the order in which evidence counts.
PLATFORMS = {
    "greenhouse": (r"greenhouse\.io|\bgrnhse", r"(?:job-)?boards(?:-api)?(?:\.eu)?\.greenhouse\.io/(?:v1/boards/|embed/job_board(?:/js)?\?for=)?([A-Za-z0-9][\w.%-]*)"),
    "lever": (r"lever\.co\b", r"(?:api|jobs)(?:\.eu)?\.lever\.co/(?:v0/postings/)?([A-Za-z0-9][\w.%-]*)"),
    "ashby": (r"ashbyhq\.com|window\.__appData", r"jobs\.ashbyhq\.com/([A-Za-z0-9][\w.%-]*)"),
    "workable": (r"workable\.com", r"apply\.workable\.com/(?:api/v\d/accounts/)?([A-Za-z0-9][\w.%-]*)"),
    "smartrecruiters": (r"smartrecruiters\.com", r"(?:careers|jobs|api)\.smartrecruiters\.com/(?:v1/companies/)?([A-Za-z0-9][\w.%-]*)"),
    "workday": (r"myworkdayjobs\.com", r"([\w-]+\.wd\d+\.myworkdayjobs\.com(?:/[a-z]{2}-[A-Z]{2})?/[\w-]+)"),
    "teamtailor": (r"teamtailor", r"([\w-]+)\.teamtailor\.com"),
    "breezy": (r"breezy\.hr", r"([\w-]+)\.breezy\.hr"),
    "personio": (r"personio\.(?:de|com)", r"([\w-]+)\.jobs\.personio\.(?:de|com)"),
    "pinpoint": (r"pinpointhq\.com", r"([\w-]+)\.pinpointhq\.com"),
    "hibob": (r"careers\.hibob\.com", r"([\w-]+)\.careers\.hibob\.com"),
    "jobylon": (r"jobylon\.com", r"emp\.jobylon\.com/companies/(\d+)"),
}
# Parts of addresses that look like a board and are none; and how many boards of a platform are told.
NO_BOARD, MOST_BOARDS = ("embed", "v1", "v0", "api", "js"), 3


def fingerprint(html: Column) -> Column:
    """array<struct<platform, boards>> of the platforms that a page shows, in the order of PLATFORMS; boards are named once, at most MOST_BOARDS."""
    c = F.coalesce(html, F.lit(""))
    parts = []
    for name, (marker, board) in PLATFORMS.items():
        named = F.filter(F.regexp_extract_all(c, F.lit(f"(?i){board}"), 1), lambda x: ~F.lower(x).isin(*NO_BOARD))
        parts.append(F.when(c.rlike(f"(?i){marker}"), F.struct(F.lit(name).alias("platform"), F.slice(F.array_distinct(named), 1, MOST_BOARDS).alias("boards"))))
    return F.array_compact(F.array(*parts))


def probe_verdict(rows: Column, platform: Column, has_postings: Column, shell: Column, total: Column) -> Column:
    """What to do with a listing: reuse a reader that gave all, short when it gave fewer than stated, a new reader, or not feasible; the first that fits."""
    return (
        F.when((rows > 0) & (total.isNull() | (rows >= total)), "reuse").when(rows > 0, "short").when(platform.isNotNull(), "reader fails").when(has_postings, "needs a reader").when(shell, "needs a browser").otherwise("not feasible")
    )
