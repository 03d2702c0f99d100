from pyspark.sql import functions as F

from postmill.operators import analytics, evaluate, identity, matchers, store
from postmill.sources import feeds
from postmill.sources.html import anchors, read_page, visible_text
from postmill.streaming.runs import into_store


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(c).first()[0]


def test_identity(spark):
    assert one(spark, identity.dedupe_key("d", "a"), d=" http://x/1 ", a="y") == "https://x/1"
    assert one(spark, identity.dedupe_key("d", "a"), d="", a="http://y") == "https://y"
    assert one(spark, identity.board_identity("u", ["shared.test"]), u="https://www.Shared.test/en/Acme/1") == "shared.test/acme"
    assert one(spark, identity.board_identity("u", []), u="no link") is None


def test_first_match_attribution(spark):
    k = [("VP", "word"), ("sale", "prefix"), ("ö", "contains")]
    assert one(spark, matchers.first_match("t", k, label="title"), t="Head of Sales, vp") == "title: 'VP' (word)"
    assert one(spark, matchers.first_match("t", k, exact_acronyms=True), t="vp Sales") == "'sale' (prefix)"
    assert one(spark, matchers.first_match("t", k), t="MALMÖ") == "'ö' (contains)"
    assert one(spark, matchers.first_match("t", k), t="nothing") is None


def test_store_merge_and_misses(spark):
    s = spark.createDataFrame([("a", "x", "text", "2025", 3), ("b", "y", "", "2025", 0)], "k string, t string, d string, first string, misses int")
    b = spark.createDataFrame([("a", "new", "", 1), ("a", "newer", "", 2), ("c", "z", "d", 1), ("", "q", "", 1)], "k string, t string, d string, ord int")
    new = store.fold_batch(b, key="k", order="ord", overwrite=["t"], sticky=["d"])
    out = store.upsert(s, new, key="k", overwrite=["t"], sticky=["d"], first={"first": F.lit("2026"), "misses": F.lit(0)}, keep=["first", "misses"])
    assert {tuple(r) for r in out.collect()} == {("a", "newer", "text", "2025", 3), ("b", "y", "", "2025", 0), ("c", "z", "d", "2026", 0)}
    jobs = spark.createDataFrame([("a", "s", 2), ("b", "s", 2), ("c", "off", 2)], "dedupe_key string, source_name string, misses int")
    seen, ok = jobs.where("dedupe_key = 'a'"), jobs.where("source_name = 's'")
    assert {(r.dedupe_key, r.misses) for r in store.count_misses(jobs, seen, ok).collect()} == {("a", 0), ("b", 3), ("c", 2)}


def test_versions_publish_or_not(spark, tmp_path):
    v = store.VersionedStore(str(tmp_path))
    df = spark.range(3)
    assert v.read(spark, "jobs") is None
    v.write({"jobs": df}, dry=True)
    assert v.current() is None
    v.write({"jobs": df}, unique={"jobs": "id"})
    assert v.current() == 1 and v.read(spark, "jobs").count() == 3
    try:
        v.write({"jobs": df.union(df)}, unique={"jobs": "id"})
        raise AssertionError
    except ValueError:
        assert v.current() == 1


def test_stream_into_store(spark, tmp_path):
    src = tmp_path / "in"
    schema = "dedupe_key string, title string, company string, location string, last_seen string, description_text string, ord int"
    spark.createDataFrame([("a", "t1", "c", "l", "2026-01-01", "text", 1), ("b", "t", "c", "l", "2026-01-01", "", 1)], schema).write.parquet(str(src))
    v = store.VersionedStore(str(tmp_path / "store"))
    for title in ("t1", "t2"):
        if title == "t2":
            spark.createDataFrame([("a", title, "c", "l", "2026-01-02", "", 1)], schema).write.mode("append").parquet(str(src))
        into_store(spark.readStream.schema(schema).parquet(str(src)), v, str(tmp_path / "cp")).awaitTermination()
    got = {r.dedupe_key: (r.title, r.description_text, r.first_seen, r.last_seen) for r in v.read(spark, "jobs").collect()}
    assert got["a"] == ("t2", "text", "2026-01-01", "2026-01-02") and len(got) == 2


def test_evaluation(spark):
    rows = [(True, 3)] * 4 + [(False, 3)] * 4 + [(True, 1), (True, 2), (True, 2)] + [(False, 1)] * 3
    v = spark.createDataFrame(rows, "wanted boolean, depth int").withColumn("kept", F.col("depth") == 3)
    c = evaluate.confusion(v).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (4, 4, 3, 3) and c.precision == 0.5 and abs(c.f2 - 5 / 9) < 1e-6
    assert [tuple(r) for r in evaluate.layer_report(v, 2).orderBy("layer").collect()] == [(1, 14, 4, 1), (2, 10, 2, 2)]
    empty = evaluate.confusion(v.limit(0)).first()
    assert empty.tp == 0 and empty.precision is None


def test_health(spark):
    rows = [("s", 1, 100, True), ("s", 2, 0, False), ("s", 3, 49, True), ("s", 4, 25, True), ("o", 1, 20, True), ("o", 2, 20, True)]
    h = spark.createDataFrame(rows, "source_name string, run_id int, rows_found int, ok boolean")
    assert [(r.source_name, r.run_id) for r in analytics.regressions(h).collect()] == [("s", 3)]
    assert {r.source_name: r.counts for r in analytics.last_counts(h, 2).collect()} == {"s": [25, 49], "o": [20, 20]}
    assert [r.source_name for r in analytics.one_page(h, n=2).collect()] == ["o"]


def test_readers_take_bad_payloads(spark):
    pages = spark.createDataFrame([("s", '{"jobs":[{"id":1,"title":" A ","location":{"name":"Oslo"}},{"id":2,"title":" "}]}'), ("s", "no json"), ("s", None)], "source_name string, payload string")
    assert [(r.posting_id, r.title, r.location) for r in feeds.read_payloads(pages, "greenhouse").collect()] == [("1", "A", "Oslo")]
    assert feeds.bad_payloads(pages, "greenhouse").first()["bad"] == 2
    lever = spark.createDataFrame([("s", '[{"id":"x","text":"T","categories":{"team":"Ops","location":"Rome"}}]')], "source_name string, payload string")
    assert feeds.read_payloads(lever, "lever").first().department == "Ops"


def test_html():
    text, links = read_page("<nav>menu</nav><p>One <b>two</b></p><a href='/j/1'>Job <i>1</i></a><footer>x</footer><script>y</script>")
    assert text == "One two Job 1" and links == [{"href": "/j/1", "text": "Job 1"}]
    assert read_page(None) == ("", [])


def test_html_columns(spark):
    df = spark.createDataFrame([("<p>a</p><a href='/x'>b</a>",), (None,)], "h string")
    assert [r[0] for r in df.select(visible_text("h")).collect()] == ["a b", ""]
    assert df.select(F.size(anchors("h"))).first()[0] == 1


def test_first_occurrence(spark):
    df = spark.createDataFrame([("u", 2, 1, "late"), ("u", 1, 9, "first"), ("v", 1, 1, "only")], "url string, page int, pos int, title string")
    got = {r.url: r.title for r in analytics.first_seen_per_walk(df, keys=["url"], order=["page", "pos"]).collect()}
    assert got == {"u": "first", "v": "only"}


def test_replayed_batches_are_passed_over(spark, tmp_path):
    schema = "dedupe_key string, title string, company string, location string, last_seen string, description_text string, ord int"
    src, v = tmp_path / "in", store.VersionedStore(str(tmp_path / "store"))
    spark.createDataFrame([("a", "t1", "c", "l", "2026-01-01", "", 1)], schema).write.parquet(str(src))
    for checkpoint in ("one", "one", "two"):
        into_store(spark.readStream.schema(schema).parquet(str(src)), v, str(tmp_path / checkpoint)).awaitTermination()
    # The second start finds nothing new; another checkpoint reads the files as its own first batch.
    assert v.current() == 2 and v.read(spark, "jobs").count() == 1
    assert {(r.checkpoint, r.batch) for r in v.read(spark, "batches").collect()} == {(str(tmp_path / c), 0) for c in ("one", "two")}
    import shutil

    shutil.rmtree(tmp_path / "one" / "commits")
    into_store(spark.readStream.schema(schema).parquet(str(src)), v, str(tmp_path / "one")).awaitTermination()
    assert v.current() == 2 and v.read(spark, "none") is None
