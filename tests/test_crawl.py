from datetime import datetime

from pyspark.sql import functions as F

from crawlmill.__main__ import main
from crawlmill.config import CrawlConfig
from crawlmill.functions import udtf
from crawlmill.operators import search
from crawlmill.plans import crawl
from crawlmill.sources.store import SnapshotStore
from crawlmill.streaming import crawl_stream, events, heartbeat
from tests_schemas import CORPUS, PAGES, QUEUE, RULES

def ts():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")

BODY = "A paragraph that is surely long enough. "


def page(*hrefs, text=BODY):
    return f"<title>t</title><main><p>{text}</p>" + "".join(f"<a href='{h}'>x</a>" for h in hrefs) + "</main>"


def site(spark):
    rows = [
        ("https://a.example/", 200, "text/html", None, page("/b", "/c", "https://x.com/no", "#f", "http://[bad", "https://a.example/", "https://z.example/p")),
        ("https://a.example/b", 200, "text/html", None, page("/c", "/private/x")),
        ("https://a.example/c", 404, "text/html", None, None),
        ("https://z.example/p", 200, "text/html", None, page(text="short")),
    ]
    return spark.createDataFrame(rows, CORPUS)


def fresh_store(spark, path):
    store = SnapshotStore(spark, str(path))
    rules = spark.createDataFrame([("a.example", False, 100, None, "User-agent: *\nDisallow: /private/")], RULES)
    store.commit(
        {
            "crawler_queue": spark.createDataFrame([(1, "https://a.example/", "a.example", 5, 0, "pending", 0, None, datetime(2025, 1, 1), None)], QUEUE),
            "pages": spark.createDataFrame([], PAGES),
            "page_links": spark.createDataFrame([], "source_url string, target_url string"),
            "domain_rules": rules,
        }
    )
    return store


def test_epochs(spark, tmp_path):
    store = fresh_store(spark, tmp_path)
    seeds = spark.createDataFrame([("https://a.example/", "a.example", 9)], "url string, domain string, priority int")
    assert crawl.crawl(store, site(spark), seeds, ts(), 3) == 3
    queue = {r.url: (r.status, r.depth, r.needs_js) for r in store.read("crawler_queue").collect()}
    assert queue == {
        "https://a.example/": ("done", 0, None),
        "https://a.example/b": ("done", 1, False),
        "https://a.example/c": ("failed", 1, False),
        "https://z.example/p": ("pending", 1, True),
        "https://a.example/private/x": ("failed", 2, False),
    }
    assert sorted(r.url for r in store.read("pages").collect()) == ["https://a.example/", "https://a.example/b"]
    edges = {(r.source_url, r.target_url) for r in store.read("page_links").collect()}
    assert ("https://a.example/b", "https://a.example/c") in edges and len(edges) == 5
    assert {r.domain: r.last_crawled_at is not None for r in store.read("domain_rules").collect()} == {"a.example": True, "z.example": False}


def test_browser_takes_what_needs_scripts(spark, tmp_path):
    store = fresh_store(spark, tmp_path)
    crawl.crawl(store, site(spark), spark.createDataFrame([], "url string, domain string, priority int"), ts(), 2)
    long = site(spark).withColumn("html", F.when(F.col("url") == "https://z.example/p", F.lit(page())).otherwise(F.col("html")))
    tables = {n: store.read(n) for n in ("crawler_queue", "pages", "page_links", "domain_rules")}
    out = crawl.epoch(tables, long, ts(), CrawlConfig(), browser=True)
    assert out["crawler_queue"].where("url = 'https://z.example/p'").first().status == "done"


def test_robots_of_new_hosts(spark, tmp_path):
    store = fresh_store(spark, tmp_path)
    rows = [(i, f"https://{h}/", h, 5, 0, "pending", 0, None, datetime(2025, 1, 1), None) for i, h in enumerate("abcde")]
    store.commit({"crawler_queue": spark.createDataFrame(rows, QUEUE), "domain_rules": spark.createDataFrame([("b", False, 1, None, ""), ("c", False, 1, None, "User-agent: *\nDisallow:")], RULES)})
    corpus = spark.createDataFrame([(f"https://{h}/", 200, "text/html", None, page()) for h in "abcde"], CORPUS)
    stop = "User-agent: *\nDisallow: /"
    robots = spark.createDataFrame([("a", 200, stop), ("b", 200, stop), ("c", 200, stop), ("d", 404, stop), ("z", 200, stop)], "domain string, status int, text string")
    crawl.crawl(store, corpus, rows_of_seeds(spark), ts(), 1, robots=robots)
    assert {r.url: r.status for r in store.read("crawler_queue").collect()} == {f"https://{h}/": "failed" if h in "ab" else "done" for h in "abcde"}
    assert {r.domain: r.robots_txt for r in store.read("domain_rules").collect()} == {"a": stop, "b": stop, "c": "User-agent: *\nDisallow:", "d": None, "e": None}
    assert {r.domain for r in store.read("pages").collect()} == {"c", "d", "e"}


def rows_of_seeds(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, domain string, priority int")


def test_seeds_of_full_hosts_stay_out(spark, tmp_path):
    store = fresh_store(spark, tmp_path)
    crawl.crawl(store, site(spark), rows_of_seeds(spark), ts(), 1)
    store.commit({"crawler_queue": spark.createDataFrame([], QUEUE)})
    seeds = rows_of_seeds(spark, ("https://a.example/", "a.example", 9), ("https://n.example/", "n.example", 9), ("nothing", "", 9))
    crawl.crawl(store, site(spark), seeds, ts(), 1, CrawlConfig(max_pages_per_domain=1))
    assert [r.url for r in store.read("crawler_queue").collect()] == ["https://n.example/"]


def test_seeds_of_the_given_table(spark, tmp_path):
    store = fresh_store(spark, tmp_path)
    store.commit({"crawler_queue": spark.createDataFrame([], QUEUE)})
    crawl.crawl(store, site(spark), spark.read.parquet("/root/testdata/sf0.001/crawler_seeds.parquet"), ts(), 1)
    assert store.read("crawler_queue").where("status = 'pending' and domain <> ''").count() > 30


def test_browser_falls_back_to_pending(spark, tmp_path):
    store = fresh_store(spark, tmp_path)
    crawl.crawl(store, site(spark), rows_of_seeds(spark), ts(), 1, CrawlConfig.from_env({"PLAYWRIGHT_FALLBACK_TO_PENDING": "true"}), browser=True)
    assert store.read("crawler_queue").where("id = 1").first().status == "done"


def test_rendered_fallbacks(spark):
    rows = [
        ("a", 500, None, None, page(), None, None, None, "html"),
        ("b", 200, None, None, "<p>x", "the body text", None, None, "body_text"),
        ("c", 200, None, None, "<p>x", None, page(), None, "scroll_retry"),
        ("e", 200, None, None, None, None, None, None, None),
    ]
    corpus = spark.createDataFrame([r[:-1] for r in rows], CORPUS + ", body_text string, retry_html string, retry_body_text string")
    claimed = spark.createDataFrame([(i, r[0], "d", 0) for i, r in enumerate(rows)], "id long, url string, domain string, depth int")
    got = crawl.fetched(claimed, spark.createDataFrame([("d", True, None, None, None)], RULES), corpus, browser=True).orderBy("item_id").collect()
    assert [r.extraction_mode for r in got] == [r[-1] for r in rows] and not any(r.blocked for r in got)


def test_sql_functions(spark):
    udtf.register(spark)
    spark.createDataFrame([(page("/b", "/b", "#x", "http://[bad"), "https://h.example/a")], "h string, u string").createOrReplaceTempView("one_page")
    got = spark.sql("select l.pos, l.url, canonical_url(u) as c from one_page, lateral extract_links(h, u) l").collect()
    assert [tuple(r) for r in got] == [(0, "https://h.example/b", "https://h.example/a")]


def test_heartbeat(spark):
    now = [0.0]
    beat = heartbeat.Heartbeat(5, lambda: now[0])
    spark.streams.addListener(beat)
    q = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load().writeStream.format("noop").trigger(once=True).start()
    q.awaitTermination(60)
    spark.streams.removeListener(beat)
    beat.last["other"] = -301.0
    assert beat.stalled() == ["other"] and heartbeat.Heartbeat(0).stalled() == []


def test_command_line(spark, tmp_path):
    store = fresh_store(spark, tmp_path / "store")
    site(spark).write.parquet(str(tmp_path / "corpus"))
    spark.createDataFrame([("https://a.example/", "a.example", 9)], "url string, domain string, priority int").write.parquet(str(tmp_path / "seeds"))
    main(["crawl", str(tmp_path / "store"), str(tmp_path / "corpus"), str(tmp_path / "seeds")], spark)
    main(["backfill", str(tmp_path / "store")], spark)
    assert [len(r.embedding) for r in store.read("pages").collect()] == [64]
    main(["query", "status_histogram", "/root/testdata/sf0.001", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 1


def test_stream_of_addresses(spark, tmp_path):
    store = fresh_store(spark, tmp_path / "s")
    spark.createDataFrame([("HTTPS://A.example/b", 3, datetime(2026, 1, 1)), (None, 1, datetime(2026, 1, 1))], "url string, priority int, ts timestamp").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("url string, priority int, ts timestamp").parquet(str(tmp_path / "in"))
    q = crawl_stream.start(rows, site(spark), store, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.url for r in store.read("pages").collect()} == {"https://a.example/", "https://a.example/b"}
    # the batch runs again after its tables were stored: nothing is claimed a second time
    before = store.version()
    assert store.batch(str(tmp_path / "ck")) == 0 and store.batch("another") == -1
    for commit in (tmp_path / "ck" / "commits").iterdir():
        commit.unlink()
    crawl_stream.start(rows, site(spark), store, str(tmp_path / "ck")).awaitTermination(120)
    assert store.version() == before


def test_event_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    for f in (events.windowed, events.session_windows, events.once):
        mode = "complete" if f is events.windowed else "append"
        name = f"stream_{f.__name__}"
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {tuple(r) for r in spark.table(name).select(*f(source).columns).collect()}
        want = {tuple(r) for r in f(source).collect()}
        assert got == want if mode == "complete" else got <= want


def test_sessions_over_spans_of_time(spark):
    from datetime import timedelta

    start = datetime(2026, 1, 1)
    minutes = [0, 10, 39, 40, 69, 70, 99, 130, 200, 200, 229, 260, 1000]
    rows = [(1, k, start + timedelta(minutes=m)) for k, m in enumerate(minutes)] + [(None, 99, start), (2, 100, None)]
    events_ = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    want, last = [], None
    for m in minutes:
        if last is None or m - last > 30:
            want.append(0)
        want[-1] += 1
        last = m
    for span in (60, 3600, 86_400):
        got = search.sessions(events_, 1800, span).orderBy("session").collect()
        assert [r.n for r in got if r.user_id == 1] == want
        assert [(r.session, r.n) for r in got if r.user_id is None] == [(1, 1)] and not [r for r in got if r.user_id == 2]
    assert search.sessions(events_.limit(0)).count() == 0


def test_search_forms(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.top_k(v, [1.0, 0.1], 2).collect()] == [1, 3]
    assert [r.vec_id for r in search.top_k(v, [1.0, 1.0], 2, "l2").collect()] == [3, 1]
    assert [r.vec_id for r in search.top_k(v, [0.0, 1.0], 1, "inner").collect()] == [2]
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in search.bm25(docs, ["a"], 5).collect()] == [1]
    assert {(r.term, r.tf) for r in search.term_index(docs).where("doc_id = 1").collect()} == {("a", 2), ("b", 1)}
