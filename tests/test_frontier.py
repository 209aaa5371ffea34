from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawlmill.config import CrawlConfig
from crawlmill.operators import embed, frontier, links, metrics, records


def ts():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


NOW = datetime(2026, 1, 1)
QUEUE = "id long, url string, domain string, priority int, depth int, status string, attempts int, needs_js boolean, queued_at timestamp, last_attempt_at timestamp"


def queue_of(spark, *rows):
    base = {"id": 1, "url": "u", "domain": "d", "priority": 0, "depth": 1, "status": "pending", "attempts": 0, "needs_js": None, "queued_at": None, "last_attempt_at": None}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], QUEUE)


def incoming_of(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, domain string, priority int, depth int, needs_js boolean")


def test_link_upsert_transitions(spark):
    queue = queue_of(
        spark,
        {"id": 1, "url": "a", "priority": 5, "depth": 1, "needs_js": None},
        {"id": 2, "url": "b", "status": "failed", "priority": -1, "depth": 3, "needs_js": True, "attempts": 4},
        {"id": 3, "url": "c", "status": "done", "priority": 2},
        {"id": 4, "url": "e", "status": "processing", "priority": 2},
        {"id": 5, "url": "f", "status": None, "priority": 2},
    )
    new = incoming_of(spark, *[(u, "n", 2, 2 if u == "a" else 1, False) for u in "abcefzy"])
    got = {r.url: r for r in frontier.upserted(queue, new, ts()).collect()}
    assert (got["a"].status, got["a"].priority, got["a"].depth, got["a"].needs_js, got["a"].queued_at) == ("pending", 5, 1, False, NOW)
    assert (got["b"].status, got["b"].priority, got["b"].depth, got["b"].needs_js, got["b"].attempts) == ("pending", 2, 1, True, 4)
    assert got["a"].domain == "n"
    for u, status in (("c", "done"), ("e", "processing"), ("f", None)):
        assert (got[u].status, got[u].domain, got[u].queued_at) == (status, "d", None)
    assert (got["y"].id, got["z"].id, got["y"].attempts, got["y"].needs_js) == (6, 7, 0, False)
    assert len(got) == 7


def test_upsert_is_idempotent_and_takes_empty_tables(spark):
    empty = queue_of(spark).limit(0)
    new = incoming_of(spark, ("b", "d", 1, 1, None), ("a", "d", 1, 1, True))
    once = frontier.upserted(empty, new, ts())
    assert [(r.id, r.url, r.needs_js) for r in once.orderBy("id").collect()] == [(1, "a", True), (2, "b", False)]
    assert sorted(frontier.upserted(once, new, ts()).collect()) == sorted(once.collect())
    assert frontier.upserted(once, new.limit(0), ts()).count() == 2


def test_reactivation(spark):
    seeds = spark.createDataFrame([("a", "d", 9), ("n", "d", None), ("n", "d", None)], "url string, domain string, priority int")
    idle = queue_of(spark, {"url": "a", "status": "done", "priority": 2, "depth": 2, "needs_js": True})
    got = {r.url: r for r in frontier.reactivated(idle, seeds, ts()).collect()}
    assert (got["a"].status, got["a"].priority, got["a"].depth, got["a"].needs_js) == ("pending", 9, 0, True)
    assert (got["n"].priority, got["n"].id) == (0, 2) and len(got) == 2
    busy = queue_of(spark, {"url": "a", "status": "processing"})
    assert frontier.reactivated(busy, seeds, ts()).collect() == busy.collect()


def test_claims(spark):
    queue = queue_of(
        spark,
        {"id": 1, "url": "a", "priority": 9},
        {"id": 2, "url": "b", "priority": None},
        {"id": 3, "url": "c", "priority": 9, "queued_at": NOW},
        {"id": 4, "url": "e", "priority": 9, "needs_js": True},
        {"id": 5, "url": "f", "priority": 9, "status": "done"},
    )
    assert [r.id for r in frontier.claim(queue, 3).collect()] == [2, 3, 1]
    assert [r.id for r in frontier.claim(queue, 3, browser=True).collect()] == [4]
    leased = frontier.leased(queue, frontier.claim(queue, 1), ts())
    assert {r.id: r.status for r in leased.collect()}[2] == "processing"
    assert sorted(r.status for r in frontier.rolled_back(leased, leased).collect()) == ["done"] + ["pending"] * 4
    assert [(r.id, r.worker) for r in frontier.by_worker(queue, 2, 3).orderBy("turn").collect()] == [(2, 0), (3, 1), (1, 0)]


def test_results(spark):
    queue = queue_of(spark, *[{"id": i, "url": str(i), "status": "processing", "attempts": a} for i, a in ((1, 0), (2, 1), (3, None), (4, 0))])
    results = spark.createDataFrame([(1, True, None), (2, False, "sem_conteudo"), (3, False, "http_500")], "item_id long, ok boolean, error string")
    got = {r.id: (r.status, r.attempts, r.needs_js) for r in frontier.after_results(queue, results).collect()}
    assert got == {1: ("done", 0, None), 2: ("pending", 2, True), 3: ("failed", None, None), 4: ("processing", 0, None)}


def test_gates_in_order(spark):
    schema = "item_id long, blocked boolean, robots_blocked boolean, fetch_error string, http_status int, content_type string, summary string"
    rows = [
        (1, True, True, "timeout", 404, None, None, "dominio_bloqueado"),
        (2, False, True, "timeout", 404, None, None, "bloqueado_robots"),
        (3, None, None, "timeout", 404, None, None, "timeout"),
        (4, False, False, None, 404, None, None, "http_404"),
        (5, False, False, None, 200, "Text/HTML", "x", "nao_html"),
        (6, False, False, None, 200, "text/html; charset=x", "", "sem_conteudo"),
        (7, False, False, None, 200, "text/html", "x", None),
    ]
    got = frontier.classified(spark.createDataFrame([r[:-1] for r in rows], schema)).orderBy("item_id").collect()
    assert [r.error for r in got] == [r[-1] for r in rows]
    assert [r.ok for r in got] == [False] * 6 + [True] and [r.needs_js for r in got] == [False] * 5 + [True, False]


def links_of(spark, rows):
    return spark.createDataFrame(rows, "source_url string, source_domain string, depth int, pos long, target_url string, target_domain string")


def test_link_caps(spark):
    rows = [("s", "h", 0, i, f"in{i:02}", "h") for i in range(14)] + [("s", "h", 0, 20 + i, f"out{i}", "x") for i in range(5)]
    rows += [("s", "h", 0, 30, "s", "h"), ("s", "h", 0, 31, "nohost", ""), ("deep", "h", 3, 1, "in00", "h"), ("t", "h", None, 1, "in00", "h")]
    plan = links.planned(links_of(spark, rows)).collect()
    assert sorted(r.url for r in plan if r.source_url == "s") == [f"in{i:02}" for i in range(10)] + ["out0", "out1", "out2"]
    assert {(r.priority, r.depth) for r in plan} == {(-1, 1), (2, 1)} and not [r for r in plan if r.source_url == "deep"]
    merged = {r.url: r for r in links.merged_batch(links.planned(links_of(spark, rows))).collect()}
    assert merged["in00"].priority == -1 and len(merged) == 13
    assert links.tallies(links.planned(links_of(spark, rows))).where("source_url = 's'").first()[1:] == (10, 3)
    pages = spark.createDataFrame([("x",), ("x",), (None,)], "domain string")
    assert not links.under_cap(links.planned(links_of(spark, rows)), pages, 2).where("domain = 'x'").count()
    assert links.planned(links_of(spark, rows).limit(0), CrawlConfig()).count() == 0


def test_records(spark):
    schema = "id long, url string, domain string, title string, summary string, embedding array<float>, language string, status string, indexed_at timestamp, created_at timestamp, updated_at timestamp"
    old = datetime(2025, 1, 1)
    pages = spark.createDataFrame([(3, "a", "d", "t", "s", [1.0], "pt", "pending", None, old, None), (4, "b", "d", "t", "s", None, None, "indexed", None, old, None)], schema)
    crawled = spark.createDataFrame([("a", "new", "T", "S"), ("c", "h", None, "S")], "url string, domain string, title string, summary string")
    got = {r.url: r for r in records.pages_upserted(pages, crawled, ts()).collect()}
    assert (got["a"].id, got["a"].domain, got["a"].embedding, got["a"].language, got["a"].status, got["a"].created_at) == (3, "new", None, None, "indexed", old)
    assert (got["c"].id, got["c"].created_at) == (5, NOW) and got["b"].updated_at is None
    assert {r.url: r.domain for r in records.pages_upserted(pages, crawled, ts(), rendered=True).collect()}["a"] == "d"
    pending = records.pending_embeddings(pages)
    vectors = embed.embedded(pending)
    done = {r.id: r for r in records.embeddings_written(pages, vectors, ts()).collect()}
    assert len(done[4].embedding) == 64 and done[4].updated_at == NOW and done[3].embedding == [1.0] and done[3].language == "pt"
    rules = spark.createDataFrame([("d", None, None, None, "")], "domain string, blocked boolean, crawl_delay_ms int, last_crawled_at timestamp, robots_txt string")
    full = records.rules_completed(rules, spark.createDataFrame([("d",), ("e",), ("e",), (None,)], "domain string"))
    assert sorted((r.domain, r.crawl_delay_ms) for r in full.collect()) == [("d", None), ("e", 1000)]
    fetched = spark.createDataFrame([("d", None)], "domain string, text string")
    assert records.rules_with_robots(rules, fetched).first().robots_txt is None
    assert records.rules_touched(full, crawled.withColumn("domain", F.lit("e")), ts()).where("last_crawled_at is not null").count() == 1


def test_embedder_parts():
    def small(texts):
        if len(texts) > 20:
            raise MemoryError
        return embed.hashing_embedder(8)(texts)

    assert embed.in_shrinking_batches(small, 64)(["a b"] * 70).shape == (70, 8)

    def broken():
        raise OSError("no model")

    assert embed.first_that_loads([broken, embed.hashing_embedder])(["x"]).shape == (1, 64)

    tried = []

    def failing():
        tried.append(1)
        raise OSError("no model")

    with pytest.raises(RuntimeError):
        embed.first_that_loads([failing, failing])
    assert len(tried) == 1


def test_figures(spark):
    row = spark.range(1).select(
        metrics.watchdog_minutes(F.lit(40), F.lit(20), F.lit(15), F.lit(1000)).alias("a"),
        metrics.backoff_seconds(F.lit(3)).alias("b"),
        metrics.backoff_seconds(F.lit(9)).alias("c"),
        *metrics.progress(F.lit(0.0), F.lit(0), F.lit(0.0)),
    ).first()
    assert (row.a, row.b, row.c, row.pct, row.eta_s) == (2, 1.0, 5.0, 100.0, 0.0)


def test_chunks_of_groups(spark):
    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"d{i % 7}"), f"u{(i * 37) % 101}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, domain string, url string").withColumn("_x", F.lit(1))
    got = {r.id: r.chunk for r in frontier.in_chunks(df, "domain", ["url", "id"], 7).collect()}
    want = {}
    for d in {r[1] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[1] == d), key=lambda r: (r[2], r[0]))):
            want[r[0]] = k // 7
    assert got == want
    assert frontier.in_chunks(df.limit(0), "domain", ["url", "id"], 7).count() == 0


def test_stuck_rows_fail_after_too_many_attempts(spark):
    old = spark.createDataFrame([(1, "processing", 1), (2, "processing", 5), (3, "processing", None), (4, "done", 9)], "id long, status string, attempts int")
    old = old.withColumn("last_attempt_at", F.timestamp_seconds(F.lit(0)))
    now = F.timestamp_seconds(F.lit(10))
    assert {r.id: r.status for r in frontier.reclaimed(old, now, 5).collect()} == {1: "pending", 2: "failed", 3: "pending", 4: "done"}
    assert {r.id: r.status for r in frontier.reclaimed(old, now).collect()} == {1: "pending", 2: "pending", 3: "pending", 4: "done"}


def test_settings_by_their_names():
    from crawlmill.config import CrawlConfig

    c = CrawlConfig.from_env({"EXCLUDED_QUEUE_DOMAINS": "A.b, c", "MAX_QUEUE_URL_LENGTH": "9", "MAX_LINKS_PER_DOMAIN_PER_PAGE": "4", "MAX_INTERNAL_LINKS_PER_PAGE": "5", "CONCURRENT_REQUESTS": "50"})
    assert (c.excluded_domains, c.max_url_length, c.max_external_per_domain, c.max_internal_links, c.concurrency, c.batch_size) == (("a.b", "c"), 9, 4, 5, 50, 100)
    assert CrawlConfig.from_env({}).batch_size == 40 and CrawlConfig.from_env({"CRAWLER_BATCH_SIZE": "7"}).batch_size == 7
