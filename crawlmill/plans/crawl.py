"""One crawl epoch, and the loop over epochs.

Fetching is a join with a corpus (url, http_status, content_type, fetch_error,
html). An epoch is a function from tables to tables; the loop writes each
version before the next begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.config import CrawlConfig
from crawlmill.functions.html import parse_html, rendered_summary, summary_of, title_of
from crawlmill.functions.robots import robots_blocked
from crawlmill.functions.urls import domain_of, is_skipped_href, path_of, resolve_udf
from crawlmill.operators import frontier, links, records
from crawlmill.session import cut
from crawlmill.sources.store import SnapshotStore


RENDERED = ("body_text", "retry_html", "retry_body_text")


def fetched(claimed: DataFrame, rules: DataFrame, corpus: DataFrame, config: CrawlConfig = CrawlConfig(), browser: bool = False) -> DataFrame:
    """Claimed rows with gates, page text, links and the way the text was got.

    Only the claimed rows meet the corpus, and a page is parsed once. The browser
    knows no host rules and no status gate; it falls back on the rendered text,
    and once on a second reading of the page, columns ``RENDERED`` of the corpus.
    """
    work = records.ruled(claimed.select("id", "url", "domain", "depth"), rules, config.crawl_delay_ms)
    got = work.join(corpus, "url", "left")
    for c in RENDERED:
        if c not in corpus.columns:
            got = got.withColumn(c, F.lit(None).cast("string"))
    got = got.withColumn("page", parse_html("html"))
    page = F.col("page")
    first = summary_of(page, config, browser)
    if browser:
        got = got.withColumn("again", parse_html("retry_html"))
        described = rendered_summary(page, F.lit(None).cast("string"), config)
        bodied = rendered_summary(page, F.col("body_text"), config)
        second = rendered_summary(F.col("again"), F.col("retry_body_text"), config)
        text = F.coalesce(bodied, second)
        mode = F.when(described.isNotNull(), "html").when(bodied.isNotNull(), "body_text").when(second.isNotNull(), "scroll_retry")
    else:
        text, mode = first, F.when(first.isNotNull(), "html")
    open_ = F.lit(browser)
    status = F.when(F.col("http_status").isNotNull(), 200) if browser else F.col("http_status")
    return got.select(
        F.col("id").alias("item_id"), "url", "domain", "depth",
        (F.col("blocked") & ~open_).alias("blocked"),
        (robots_blocked(F.col("robots_txt"), path_of(F.col("url"))) & ~open_).alias("robots_blocked"),
        F.when(F.col("http_status").isNull() & F.col("fetch_error").isNull(), "timeout").otherwise(F.col("fetch_error")).alias("fetch_error"),
        status.alias("http_status"), (F.lit("text/html") if browser else F.col("content_type")).alias("content_type"),
        title_of(page, browser).alias("title"), text.alias("summary"), mode.alias("extraction_mode"), F.col("page.links").alias("hrefs"),
    )


def found_links(ok_pages: DataFrame) -> DataFrame:
    """Links of fetched pages as ``links.planned`` reads them, in document order, each address once per page."""
    raw = ok_pages.select("url", "domain", "depth", F.posexplode("hrefs").alias("pos", "href")).where(~is_skipped_href(F.col("href")))
    resolved = raw.withColumn("target_url", resolve_udf(F.trim("href"), "url")).where("target_url is not null")
    return resolved.groupBy(F.col("url").alias("source_url"), F.col("domain").alias("source_domain"), "depth", "target_url").agg(
        F.min("pos").alias("pos")
    ).withColumn("target_domain", domain_of(F.col("target_url")))


def epoch(tables: dict[str, DataFrame], corpus: DataFrame, batch_ts: Column, config: CrawlConfig = CrawlConfig(), browser: bool = False, robots: DataFrame | None = None) -> dict[str, DataFrame]:
    """Queue, pages, page_links and domain_rules after one batch.

    In order: pages, rules, found links into the queue, edges, states of the
    claimed rows. Hosts over the page cap count pages of this batch too. Claimed
    hosts without a stored robots text get that of ``robots`` (domain, status,
    text) before the gates; the browser fetches none. A browser without rows of
    its own takes any pending ones if the configuration says so.
    """
    claimed = cut(frontier.claim(tables["crawler_queue"], config.batch_size, browser))
    if browser and config.playwright_fallback_to_pending and claimed.limit(1).count() == 0:
        claimed = cut(frontier.claim(tables["crawler_queue"], config.batch_size))
    queue = frontier.leased(tables["crawler_queue"], claimed, batch_ts)
    rules = records.rules_completed(tables["domain_rules"], claimed, config.crawl_delay_ms)
    if robots is not None and not browser:
        rules = cut(records.rules_with_robots(rules, records.robots_fetched(claimed, robots)))
    got = cut(fetched(claimed, rules, corpus, config, browser))
    results = frontier.classified(got)
    good = got.join(results.where("ok").select("item_id"), "item_id", "left_semi")
    pages = records.pages_upserted(tables["pages"], good.dropDuplicates(["url"]), batch_ts, browser)
    plan = cut(links.under_cap(links.planned(found_links(good), config), pages, config.max_pages_per_domain))
    queue = frontier.upserted(queue, links.merged_batch(plan), batch_ts)
    return {
        "crawler_queue": frontier.after_results(queue, results),
        "pages": pages,
        "page_links": records.inserted(tables["page_links"], links.edges(plan), ["source_url", "target_url"]),
        "domain_rules": records.rules_touched(rules, good, batch_ts),
    }


def crawl(store: SnapshotStore, corpus: DataFrame, seeds: DataFrame, batch_ts: Column, epochs: int, config: CrawlConfig = CrawlConfig(), browser: bool = False, robots: DataFrame | None = None) -> int:
    """Runs epochs until nothing is pending or ``epochs`` is reached; an idle queue is seeded once. Epochs run.

    Seeds get the host of their address where they have no column for it. Seeds
    without a host or of a host at the page cap are left out.
    """
    if "domain" not in seeds.columns:
        seeds = seeds.withColumn("domain", domain_of(F.col("url")))
    names, seeded = ("crawler_queue", "pages", "page_links", "domain_rules"), False
    for done in range(epochs):
        tables = {n: store.read(n) for n in names}
        wanted = frontier.rendered() if browser else frontier.light()
        if browser and config.playwright_fallback_to_pending:
            wanted = F.col("status") == "pending"
        if tables["crawler_queue"].where(wanted).limit(1).count() == 0:
            if seeded:
                return done
            open_seeds = links.under_cap(seeds.where("domain <> ''"), tables["pages"], config.max_pages_per_domain)
            store.commit({"crawler_queue": frontier.reactivated(tables["crawler_queue"], open_seeds, batch_ts)})
            seeded = True
            continue
        store.commit(epoch(tables, corpus, batch_ts, config, browser, robots))
    return epochs
