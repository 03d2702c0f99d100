import json

import pytest
from pyspark.sql import functions as F

from postmill.sources import boards, feeds
from postmill.sources.dom import parse

AT = "https://x.test/careers/"


def rows(name, html, url=AT):
    return [(r["title"], r["department"], r["location"], r["detail_url"]) for r in boards.READERS[name](parse(html), url)]


def test_tree_of_broken_markup():
    page = parse("<div><p>one<p>two</b><ul><li>a<li>b</ul><br>tail</div><td>x")
    assert [p.text() for p in page.all("p")] == ["one", "two"] and [x.text() for x in page.all("li")] == ["a", "b"]
    assert parse(None).text() == "" and parse("<script>x</script>y &amp; z").text() == "y & z"


@pytest.mark.parametrize(
    "html,want",
    [
        ('<a href="/jobs/1-a"><h3>Analyst</h3><p>Data · Oslo</p></a>', ("Analyst", "Data", "Oslo")),
        ('<a href="/jobs/1-a"><div>Analyst</div><div>Data · Oslo · Hybrid</div></a>', ("Analyst", "Data", "Oslo")),
        ('<a href="/jobs/1-a"><span title="Analyst of all">Analyst…</span><div>Oslo</div></a>', ("Analyst of all", "", "Oslo")),
        ('<div><a href="/jobs/1-a">Analyst</a><div><img></div><div><span>Org</span><span>·</span><span>Data</span><span>·</span><span>Oslo</span><span><i></i>Fjärr</span></div></div>', ("Analyst", "Data", "Oslo")),
        ('<div><a href="/jobs/1-a"><h3>Analyst</h3></a><p>Org · Data · Oslo</p></div>', ("Analyst", "Data", "Oslo")),
        ('<a href="/jobs/1-a"><div><img></div><div><span title="Analyst of all">Anal...</span><div>Data · Oslo</div></div></a>', ("Analyst of all", "Data", "Oslo")),
    ],
)
def test_teamtailor_layouts(html, want):
    assert rows("teamtailor", html + '<a href="/jobs/1-a">again</a><a href="/about">x</a>') == [(*want, "https://x.test/jobs/1-a")]


def test_title_in_the_place_of_a_location():
    with pytest.raises(boards.Unreadable):
        rows("teamtailor", '<a href="/jobs/2"><h3>Analyst for water</h3><p>Analyst for…</p></a>')
    assert boards.read_as_place("Lead", "lead.") and not boards.read_as_place("Lead", "") and not boards.read_as_place("Oslo lead", "Oslo")


def test_columns_agree_with_text(spark):
    pairs = [("Lead", "lead."), ("Lead", ""), ("Oslo lead", "Oslo"), ("Analyst for water", "Analyst for…"), ("A", None), (None, "b")]
    got = spark.createDataFrame(pairs, "t string, l string").select(boards.title_read_as_location("t", "l")).collect()
    assert [r[0] for r in got] == [boards.read_as_place(t or "", where or "") for t, where in pairs]


def test_simple_layouts():
    assert rows("bearingpoint", '<a href="/open-roles/offer/?id=1"><div><h3>Owner</h3></div><div class="columns job-info">Stockholm</div></a>') == [("Owner", "", "Stockholm", "https://x.test/open-roles/offer/?id=1")]
    page = '<a href="/careers/lead">Lead</a><a href="/careers/">All</a><a href="/careers-faq">F</a><a href="https://y.test/careers/z">Z</a><a href="/careers/lead">Lead</a>'
    assert rows("gfi_europe", page) == [("Lead", "", "", "https://x.test/careers/lead")]
    page = '<section id="open-roles"><ul><li><a href="/careers/a"><span><span><span>Role</span></span><span>T · F</span></span><span>Team</span></a></li></ul></section>'
    assert rows("giving_what_we_can", page) == [("Role", "Team", "", "https://x.test/careers/a")]
    page = '<tr><td><img></td><td><span class="table-as-list__subtitle"><a href="/Vacancies/7/x">Guide</a></span><span class="table-as-list__subtitle">| Full</span><span class="table-as-list__subtitle">|  Seon</span></td></tr>'
    assert rows("mammut", page) == [("Guide", "", "Seon", "https://x.test/Vacancies/7/x")]
    page = '<h3>Fund Manager - posted 12th March</h3><p>t</p><p><a href="n.aspx?n=1">More</a></p><h3> - posted x</h3>'
    assert rows("against_malaria", page) == [("Fund Manager", "", "", "https://x.test/careers/n.aspx?n=1")]
    for name in ("giving_what_we_can", "pure_earth", "sida"):
        with pytest.raises(boards.Unreadable):
            rows(name, "<p>nothing</p>")


def test_embedded_descriptions_join_cards():
    data = {"a": [{"componentName": "greenhouseJobsList", "jobs": [{"id": 5, "content": "&lt;p&gt;Do it&lt;/p&gt;"}]}]}
    page = f'<script id="__NEXT_DATA__">{json.dumps(data)}</script><a href="/jobs/apply/5"><p>One</p><p>Oslo</p></a><a href="/jobs/apply/6"><p>Two</p></a>'
    assert [(r["title"], r["location"], r["description_text"]) for r in boards.asana(parse(page), AT)] == [("One", "Oslo", "Do it"), ("Two", "", "")]


def test_accordion_cards():
    card = lambda body: f'<div class="card"><div class="card-header"><a>HQ: Chief</a></div><div class="card-body">{body}</div></div>'
    good = '<p><strong>Location</strong>: New York</p><p><a href="https://a.test/1">APPLY NOW</a></p>'
    assert rows("pure_earth", f'<div id="accordion">{card(good)}{card(good)}</div>') == [("Chief", "", "New York", "https://a.test/1")]
    with pytest.raises(boards.Unreadable):
        rows("pure_earth", f'<div id="accordion">{card("<p>no place</p>")}</div>')


def sida_page(total=2, place=True, link="/lediga-tjanster/11-okad-hjalp"):
    flat = ["x", "https://r.test/?rmjob=11", "Ökad hjälp", "Visby", {"projectNr": 0, "url": 1, "title": 2, **({"Area2": 3} if place else {})}, "https://r.test/?rmjob=12", "Chef", {"projectNr": 0, "url": 5, "title": 6, "Area2": 3}]
    return f'<a href="{link}">Ö</a><div class="job-listing__pagination-div"><p>Totalt {total} lediga tjänster</p></div><script id="__NUXT_DATA__">{json.dumps(flat)}</script>'


def test_flat_array():
    at = "https://s.test/lediga-tjanster/"
    assert rows("sida", sida_page(), at) == [("Ökad hjälp", "", "Visby", at + "11-okad-hjalp"), ("Chef", "", "Visby", at + "12-chef")]
    for bad in (sida_page(total=3), sida_page(link="/lediga-tjanster/11-annat"), sida_page(link="/lediga-tjanster/13-x")):
        with pytest.raises(boards.Unreadable):
            rows("sida", bad, at)


def test_a_bad_page_fails_its_source_only(spark):
    pages = [("a", AT, '<a href="/jobs/1"><h3>One</h3><p>Oslo</p></a>', "teamtailor"), ("a", AT + "2", '<a href="/jobs/1"><h3>One</h3><p>Oslo</p></a>', "teamtailor"), ("b", AT, "<p></p>", "sida"), ("c", None, None, "teamtailor"), ("d", AT, "", "none")]
    read = boards.read_pages(spark.createDataFrame(pages, "source_name string, url string, html string, layout string"), "layout")
    assert [(r.source_name, r.title) for r in boards.postings(read).collect()] == [("a", "One")]
    assert {r.source_name: (r.rows_found, r.ok) for r in boards.status(read).collect()} == {"a": (2, True), "b": (0, False), "c": (0, True), "d": (0, False)}


def test_walks_and_required_fields(spark):
    w = [("whole", 1, "t", 2, 3), ("whole", 2, None, 1, 9), ("round", 1, "t", 1, 9), ("round", 2, "t", 1, 9), ("short", 1, None, 1, 2), ("none", 1, None, 1, None)]
    got = feeds.walked(spark.createDataFrame(w, "source_name string, page int, token string, rows int, total int"))
    assert {r.source_name: r.verdict for r in got.collect()} == {"whole": "complete", "round": "round", "short": "short", "none": "unverified"}
    pages = [("ok", '{"data": []}'), ("bad", '{"data": [{"title": "x"}]}'), ("broken", "nope"), ("other", '{"items": []}')]
    s = feeds.source_status(spark.createDataFrame(pages, "source_name string, payload string"), "pinpoint").collect()
    assert {r.source_name: (r.rows_found, r.ok) for r in s} == {"ok": (0, True), "bad": (0, False), "broken": (0, False), "other": (0, False)}
    x = spark.createDataFrame([("s", "<workzag-jobs><position><id>4</id><name> Lead </name></position><position><name>no id</name></position></workzag-jobs>")], "source_name string, payload string")
    assert [r.detail_url for r in feeds.read_payloads(x, "positions", base=F.lit("https://p.test")).collect()] == ["https://p.test/job/4?language=en"]


def test_totals_hold_walks(spark):
    card = lambda n: f'<article><h3><a href="/m/JobDetail/x/{n}">Lead {n}</a></h3><span class="list-item-Duty Station">Oslo</span></article>'
    assert rows("unops", card(1) + "<article><a href='/x'>no</a></article>") == [("Lead 1", "", "Oslo", "https://x.test/m/JobDetail/x/1")]
    page = '<p>Vacant positions: <span class="filter-result-text">2</span></p><a href="/jobs/vacant-positions/cvtp-1-a/"><div><p class="headline">Lead</p><p class="list-tags">Country: <span>Kenya</span></p><p class="list-tags">Employment: x</p></div></a>'
    assert rows("niras", page) == [("Lead", "", "Kenya", "https://x.test/jobs/vacant-positions/cvtp-1-a/")]
    tails = {"whole": "<p>1-6 of 2 results</p>", "short": '<b aria-label="3 results"></b>', "prose": "<p>Search results, 10 results per page</p>"}
    pages = [(s, f"u{i}", card(i) + t, "unops") for s, t in tails.items() for i in (1, 2)] + [("whole", "u3", "<p>1-6 of 9 results</p>", "unops")]
    read = boards.read_pages(spark.createDataFrame(pages, "source_name string, url string, html string, layout string"), "layout")
    assert {r.source_name: (r.rows_found, r.ok, r.error) for r in boards.status(read).collect()} == {"whole": (2, True, None), "short": (0, False, "2 of 3 postings"), "prose": (2, True, None)}


def test_fields_by_role():
    card = lambda n, title, *details: f'<div class="job"><a href="/jobs/{n}"><h3 type="cardTitle">{title}</h3><div class="ip-layout"><div type="bodyEmphasis">Org</div><div class="ip-layout">{"".join(f"<div type=bodyEmphasis>{d}</div>" for d in details)}</div></div></a></div>'
    got = boards.impactpool(parse(card(1, "Lead", "Oslo", "P-3") + card(2, "", "P-3") + card(1, "Lead", "Oslo", "P-3") + '<div class="job"><a href="/about">x</a></div>'), AT)
    assert [(r["title"], r["company"], r["location"]) for r in got] == [("Lead", "Org", "Oslo"), ("", "Org", "")]
    with pytest.raises(boards.Unreadable):
        rows("impactpool", card(1, "Lead", "a", "b", "c"))
