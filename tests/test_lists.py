import pytest
from pyspark.sql import functions as F

from postmill.functions import scoring
from postmill.operators import analytics, curated, droplog, identity, store, yields
from postmill.sources import fetched, labels, probe


def test_labels_with_their_lines(spark, tmp_path):
    f = tmp_path / "gold.csv"
    f.write_text("﻿Title;DEDUPE_KEY;Label;Extra\nA;k1;Review;x\n;k2;review;\nB;k3;maybe;\nC;k1;REVIEW;\nD;k4;discard;\nE;k4;review;\n\n\"F; G\";k5;discard;\n", encoding="utf-8")
    rows = labels.read_labels(spark, str(f))
    assert labels.first_issues(rows, 1) == (["line 3: missing dedupe_key or title"], 1)
    assert {r.dedupe_key: (r.line_no, r.title, r.wanted, r.collapsed) for r in labels.gold_set(rows).collect()} == {"k1": (2, "A", True, 1), "k5": (9, "F; G", False, 0)}
    assert [r.dedupe_key for r in labels.labelled_both_ways(rows).collect()] == ["k4"]
    f.write_text("title,label\nx,y\n")
    with pytest.raises(ValueError):
        labels.read_labels(spark, str(f))
    f.write_text("﻿keyword,match_type\nSales,PREFIX\nVP,\n ,word\nx,odd\n", encoding="utf-8")
    assert labels.read_keywords(spark, str(f)) == [("Sales", "prefix"), ("VP", "word"), ("x", "word")]


def test_curated_lists(spark):
    e = spark.createDataFrame([(1, "Acme", "https://boards.greenhouse.io/acme", "too  far\n away", "2026-01-02", None), (2, "Acme again", "boards.greenhouse.io/en/ACME/", "x", None, "kept"), (3, "Beta", "https://beta.test/jobs", None, "", "r")], "ordinal int, organisation string, url string, reason string, last_checked string, source_of_record string")
    s = spark.createDataFrame([("a", "https://boards.greenhouse.io/acme/jobs/1"), ("b", "https://boards.greenhouse.io/other"), ("c", "http://www.beta.test/x"), ("d", "nothing")], "source_name string, url string")
    assert {tuple(r) for r in curated.on_list(s, e).collect()} == {("a", "Acme", "too far away"), ("c", "Beta", "")}
    assert {r.organisation for r in curated.matches(e, "beta.test", names=("organisation",)).collect()} == {"Beta"} and curated.matches(e, "ACME", names=("organisation",)).count() == 2
    new = spark.createDataFrame([("New", "https://beta.test"), (" beta ", "https://n.test"), ("Fine", "https://fine.test")], "organisation string, url string")
    assert {(r.organisation, r.why) for r in curated.refused(e, new).collect()} == {("New", "board"), (" beta ", "organisation")}
    bad = spark.createDataFrame([("", "x", "2026-02-30"), ("ok", "https://a.test", "2026-02-03")], "organisation string, url string, last_checked string")
    assert [r.faults for r in curated.faults(bad, required=("organisation",), dates=("last_checked",)).collect()] == [["organisation is empty", "last_checked is no date", "url is no link"]]
    fill = lambda *rows: curated.filled(e, spark.createDataFrame(rows, "organisation string, last_checked string, source_of_record string"), ("last_checked",))
    got = {r.organisation: (r.last_checked, r.source_of_record) for r in fill(("Beta", "2026-03-04", "more")).collect()}
    assert got["Beta"] == ("2026-03-04", "r; more") and got["Acme"] == ("2026-01-02", None)
    with pytest.raises(Exception, match="already set"):
        fill(("Acme", "2026-03-04", None)).collect()
    old = spark.createDataFrame([("Acme", "2025-12-31"), ("Beta", "2020-01-01")], "organisation string, last_checked string")
    assert [r.organisation for r in curated.older_checks(e, old).collect()] == ["Acme"]


def test_page_scans(spark):
    html = '<h2>12 open positions</h2><div class="job-card"><div class="job-item"><a href="/jobs/77-x">X</a></div></div><a href="/jobs/search">S</a><a href="?page=3">3</a><button>Load more jobs</button><div id="root"></div><noscript>Please enable JavaScript</noscript>'
    r = probe.scan_pages(spark.createDataFrame([("u", html), ("v", None), ("w", '<p>Showing 1 to 25 of 1,060</p><nav class="pagination"></nav><script>{"jobs": [{}], "@type": "JobPosting"} window.__appData</script>')], "url string, html string"))
    got = {x.url: x for x in r.collect()}
    u, v, w = got["u"], got["v"], got["w"]
    assert (u.posting_links, u.cards, u.total, u.pager, u.shell, u.has_postings) == (1, 1, 12, ["later page", "more"], ["noscript", "empty root"], True)
    assert (v.posting_links, v.total, v.has_postings, v.visible_chars) == (0, None, False, 0)
    assert (w.total, w.page_size, w.pager, w.json_ld, w.payloads, w.job_array) == (1060, 25, ["pager"], 1, ["window.__appData"], True)
    page = "src=https://boards.greenhouse.io/embed/job_board/js?for=acme https://job-boards.greenhouse.io/acme https://jobs.lever.co/zeta"
    found = spark.createDataFrame([(page,)], "h string").select(probe.fingerprint(F.col("h")).alias("f")).first().f
    assert [(x.platform, x.boards) for x in found] == [("greenhouse", ["acme"]), ("lever", ["zeta"])]


def test_robots_and_stored_answers(spark):
    urls = spark.createDataFrame([("https://A.test/jobs",), ("https://a.test/private/x",), ("https://b.test/x",), ("https://c.test/x",), ("https://d.test/private",), (None,)], "url string")
    files = spark.createDataFrame([("https://a.test", 200, "User-agent: *\nDisallow: /private\nCrawl-delay: 3"), ("https://b.test", 404, ""), ("https://c.test", 503, "Disallow: /"), ("https://d.test", 200, "User-agent: *\nDisallow: /")], "origin string, status int, text string")
    got = {r.url: (r.allowed, r.reason, r.crawl_delay) for r in fetched.robots_verdicts(urls, files, "bot", exempt=("https://d.test",)).collect()}
    assert got == {"https://A.test/jobs": (True, "file", 3.0), "https://a.test/private/x": (False, "file", 3.0), "https://b.test/x": (True, "absent", None), "https://c.test/x": (True, "unreadable", None), "https://d.test/private": (True, "exempt", None), None: (True, "no address", None)}
    ages = spark.createDataFrame([(0, "e"), (0, None), (1_700_000_000, "e"), (3_000_000_000, None)], "at long, etag string")
    assert [r[0] for r in ages.select(fetched.cache_state(F.col("at"), F.lit(2_000_000_000), F.col("etag"))).collect()] == ["revalidate", "miss", "hit", "miss"]
    a = spark.createDataFrame([("u", 1, 200, "old"), ("u", 2, 500, "error"), ("v", 1, 404, "x")], "url string, fetched_at int, status int, body string")
    assert [tuple(r) for r in fetched.latest_answers(a).select("url", "body").collect()] == [("u", "old")]
    assert fetched.next_page("https://x/?page=2&q=1", "page", 1) == "https://x/?page=3&q=1" and fetched.next_page("https://x/a", "offset", 6) == "https://x/a?offset=6"


def test_answers_of_a_scorer(spark):
    ok = '{"score": 55, "seniority_fit": "good", "relevance": "high", "reasoning": "fits", "flags": []}'
    texts = [ok, "[]", ok.replace("55", "true"), ok.replace("55", '"55"'), ok.replace("55", "101"), ok.replace("good", "odd"), ok.replace("high", "odd"), ok.replace("fits", " "), ok.replace("[]", "null"), None]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = [r[0] for r in df.select(scoring.answer_fault("p", seniority=("good",), relevance=("high",))).collect()]
    assert got == [None, "no JSON object", "score", "score", "score", "seniority_fit", "relevance", "reasoning", "flags", "no JSON object"]
    row = spark.createDataFrame([("\n  \n a b \nc", "https://x", 'say "a"')], "t string, u string, v string")
    assert tuple(row.select(scoring.first_line("t"), scoring.sheet_link(F.col("u"), F.col("v")), droplog.clipped("t", 3)).first()) == ("a b", '=HYPERLINK("https://x","say ""a""")', "a …")


JOBS = "dedupe_key string, source_name string, company string, title string, location string, detail_url string, apply_url string, first_seen string, last_seen string, last_run_id long, status string, experience_level string, misses int, hybrid_confirmed int, description_text string, description_fetched_at string, score int"


def job(key, status="new", misses=0, level="", text="", hybrid=0, source="s"):
    return (key, source, "c", "t", "l", "", "", "2026", "2026", 1, status, level, misses, hybrid, text, "d" if text else "", 7)


def test_sightings_keep_what_was_decided(spark):
    stored = spark.createDataFrame([job("a", "rejected", 2, "junior", "old", 1), job("b", "delisted", 5), job("c")], JOBS)
    batch = spark.createDataFrame([("a", "T1", "", "new text", "day", 0, 1), ("a", "T2", "", "", "", 0, 2), ("b", "T", "senior", "", "", 1, 3), ("n", "N", "", "x", "day", 0, 4), ("n", "N2", "", "", "", 0, 5), ("", "none", "", "", "", 0, 6)], "dedupe_key string, title string, experience_level string, description_text string, description_fetched_at string, hybrid_confirmed int, ord int")
    got = {r.dedupe_key: r for r in store.merge_sightings(stored, batch, run_id=9, now="now").collect()}
    a, b, c, n = (got[k] for k in "abcn")
    assert (a.title, a.status, a.misses, a.experience_level, a.description_text, a.description_fetched_at, a.hybrid_confirmed, a.first_seen, a.last_seen, a.last_run_id, a.score) == ("T2", "rejected", 0, "junior", "new text", "day", 1, "2026", "now", 9, 7)
    assert (b.status, b.misses, b.experience_level, b.hybrid_confirmed) == ("seen", 0, "senior", 1) and (c.title, c.last_run_id, c.misses) == ("t", 1, 0)
    assert (n.status, n.title, n.description_text, n.first_seen, n.misses, n.score) == ("new", "N2", "x", "now", 0, None) and len(got) == 4
    assert tuple(store.merge_counts(stored, batch).first()) == (1, 4)


def test_delisting(spark):
    stored = spark.createDataFrame([job("a", misses=2), job("b", misses=2), job("c", "rejected", 2), job("d", "delisted", 4), job("e", misses=2, source="off"), job("f", source="gone"), job("g", "seen", 1)], JOBS)
    seen, ok = stored.where("dedupe_key = 'a'"), stored.where("source_name = 's'")
    got = {r.dedupe_key: (r.misses, r.status) for r in store.delist(stored, seen, ok, threshold=3, forced=["gone"]).collect()}
    assert got == {"a": (0, "new"), "b": (3, "delisted"), "c": (3, "rejected"), "d": (4, "delisted"), "e": (2, "new"), "f": (0, "delisted"), "g": (2, "seen")}
    with pytest.raises(ValueError):
        store.delist(stored, seen, ok, threshold=0)


def test_decisions_are_whole_or_none(spark):
    stored = spark.createDataFrame([job("a"), job("b"), job("c", "shortlisted")], JOBS)
    sheet = spark.createDataFrame([(2, "a"), (3, "b"), (4, "c")], "row_number int, dedupe_key string")
    got = {r.dedupe_key: r.status for r in store.decide(stored, sheet, {"rejected": [2]}, sweep="seen").collect()}
    assert got == {"a": "rejected", "b": "seen", "c": "shortlisted"}
    for bad in ({"rejected": [2], "seen": [2]}, {"rejected": [9]}, {"odd": [2]}):
        with pytest.raises(ValueError):
            store.decide(stored, sheet, bad)
    assert store.row_numbers(["4", "9-11"]) == [4, 9, 10, 11]
    for bad in ("x", "5-3", "1-"):
        with pytest.raises(ValueError):
            store.row_numbers([bad])
    with pytest.raises(Exception, match="empty"):
        store.with_changes(stored, spark.createDataFrame([("a", "")], "dedupe_key string, experience_level string"), "experience_level").collect()
    seen = store.import_seen(stored, spark.createDataFrame([(" a ", "x"), ("c", "x"), ("z", "new")], "dedupe_key string, title string"), run_id=3, now="now")
    assert {r.dedupe_key: (r.status, r.title) for r in seen.collect()} == {"a": ("seen", "t"), "b": ("new", "t"), "c": ("shortlisted", "t"), "z": ("seen", "new")}


def test_runs_and_log(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a", "b", "scrape"), (2, "a", None, "refilter")], "run_id long, started_at string, finished_at string, kind string")
    n, more = store.begin_run(runs, kind="scrape", at="now")
    assert n == 3 and store.finish_run(more, 3, "end").where("run_id = 3").first().finished_at == "end"
    rows = spark.createDataFrame([("k", "100% Remote", "s"), (None, "A_b", "s")], "dedupe_key string, title string, source_name string")
    log = droplog.all_drops(*[droplog.exclusions(rows, run_id=r, at="t", layer=x, rule=F.lit("r")) for r, x in ((1, "0-rules"), (3, "refilter/1-seniority"), (3, "1b-language"))])
    path = str(tmp_path / "log")
    for _ in range(2):
        droplog.record(log, path)
    back = spark.read.parquet(path)
    assert back.count() == 6 and droplog.search(back, 1, title="0% r").count() == 1 and droplog.search(back, 1, title="_").count() == 1
    assert [(r.layer, r.n) for r in droplog.rule_counts(back).collect()] == [("0-rules", 2), ("refilter/1-seniority", 2), ("1b-language", 2)]
    names = {r[0] for r in back.select(droplog.shown("layer")).distinct().collect()}
    assert names == {"Layer 1: Location and rules", "Layer 3: Seniority (re-filter)", "1b-language (retired)"}
    assert "1-seniority" in droplog.layer_argument(" 3") and "no rung" in droplog.layer_argument("9") and droplog.layer_argument("1a") is None
    droplog.export_csv(log, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(droplog.FIELDS)


def test_yield_classes(spark):
    sources = spark.createDataFrame([("works",), ("starved",), ("constant",), ("new",), ("elsewhere",), ("silent",), ("stored",)], "source_name string")
    runs = spark.createDataFrame([(r, "scrape") for r in range(1, 7)], "run_id long, kind string")
    h = [(s, r, n, True) for s, rs, n in (("works", 6, 2), ("starved", 6, 1), ("constant", 6, 1), ("new", 2, 1), ("elsewhere", 6, 1), ("silent", 6, 0), ("stored", 6, 1), ("unknown", 6, 9)) for r in range(1, rs + 1)]
    health = spark.createDataFrame(h, "source_name string, run_id long, rows_found long, ok boolean")
    rule = "locations: city not on the list"
    drops = [(r, f"{s}{r}", f"t{r}", s, loc if loc != "*" else f"Town {r}", "0-rules", rule) for s, loc in (("works", "Oslo"), ("starved", "3 Locations"), ("constant", "Bern"), ("new", "*"), ("elsewhere", "*"), ("stored", "*")) for r in range(1, 7) if s != "new" or r < 3]
    log = spark.createDataFrame(drops, "run_id long, dedupe_key string, title string, source_name string, location string, layer string, rule string")
    jobs = spark.createDataFrame([("stored", "2026-01-02T00:00:00")], "source_name string, first_seen string")
    y = yields.yield_class(yields.source_counters(sources, health, log, runs, jobs))
    got = {r.source_name: (r["class"], r.signs) for r in y.collect()}
    assert {k: v[0] for k, v in got.items()} == {"works": "A", "starved": "C", "constant": "C", "new": "D", "elsewhere": "B", "silent": "C", "stored": "A"}
    assert got["starved"][1][0] == "placeholder on 6 of 6 drops" and got["constant"][1] == ["one value on all 6 postings"] and got["silent"][1] == ["nothing listed in the window"]
    gaps = yields.run_gaps(health.where("source_name <> 'new'"), log.unionByName(log.where("source_name = 'constant'")))
    assert {(r.source_name, r.gap) for r in gaps.collect()} == {("new", "not read"), ("constant", "more drops than rows")}


def test_health_details(spark):
    h = spark.createDataFrame([("a", r, 20, True, "scrape") for r in range(1, 6)] + [("b", r, 20, r != 5, "scrape") for r in range(1, 6)] + [("c", r, 21, True, "scrape") for r in range(1, 6)] + [("a", 6, 3, True, "refilter"), ("d", 5, 0, True, "scrape")], "source_name string, run_id long, rows_found long, ok boolean, kind string")
    assert [r.source_name for r in analytics.one_page(h, run=5, kind="scrape").collect()] == ["a"]
    assert [r.source_name for r in analytics.empty_sources(h, 5).collect()] == ["d"] and {r.source_name for r in analytics.good_in(h, 5).collect()} == {"a", "c"}
    fall = spark.createDataFrame([("s", 1, 10, True), ("s", 2, 0, False), ("s", 3, 5, True), ("s", 4, 2, True)], "source_name string, run_id long, rows_found long, ok boolean")
    assert [r.run_id for r in analytics.regressions(fall).collect()] == [4]
    urls = [("https://boards.greenhouse.io/EN-gb/de/Acme/1", "boards.greenhouse.io/acme"), ("boards.greenhouse.io/en", "boards.greenhouse.io/en"), ("x.wd3.myworkdayjobs.com/en-US/Site", "x.wd3.myworkdayjobs.com/site"), ("https://www.Own.test/any", "own.test"), ("word", None), ("", None), (None, None)]
    df = spark.createDataFrame([(u,) for u, _ in urls], "u string")
    assert [r[0] for r in df.select(identity.board_identity("u")).collect()] == [w for _, w in urls]
    assert [r[0] for r in df.select(identity.origin("u")).collect()][:4] == ["https://boards.greenhouse.io", "https://boards.greenhouse.io", "https://x.wd3.myworkdayjobs.com", "https://www.own.test"]
