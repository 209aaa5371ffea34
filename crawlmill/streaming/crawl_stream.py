"""The crawl as a stream: each micro-batch of new addresses runs one epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from crawlmill.config import CrawlConfig
from crawlmill.functions.urls import canonical, domain_of
from crawlmill.operators import frontier
from crawlmill.plans.crawl import epoch
from crawlmill.session import cut
from crawlmill.sources.store import SnapshotStore


def start(addresses: DataFrame, corpus: DataFrame, store: SnapshotStore, checkpoint: str, config: CrawlConfig = CrawlConfig(), robots: DataFrame | None = None) -> StreamingQuery:
    """Adds streamed (url, priority, ts) rows to the queue and crawls a batch after each micro-batch.

    The time of a batch is the latest ``ts`` in it. The store's manifest is swapped
    once per step and holds the number of the batch, so a batch that runs again
    after a failure is passed over if its tables are there already.
    """

    def step(rows: DataFrame, number: int) -> None:
        if number <= store.batch(checkpoint):
            return
        at = rows.agg(F.max("ts")).first()[0]
        if at is None:
            return
        ts = F.lit(at).cast("timestamp")
        new = rows.select(canonical(F.col("url")).alias("url"), "priority").where("url is not null").groupBy("url").agg(F.max("priority").alias("priority"))
        incoming = new.select("url", domain_of(F.col("url")).alias("domain"), "priority", F.lit(0).alias("depth"), F.lit(False).alias("needs_js"))
        tables = {n: store.read(n) for n in ("crawler_queue", "pages", "page_links", "domain_rules")}
        tables["crawler_queue"] = cut(frontier.upserted(tables["crawler_queue"], incoming, ts))
        store.commit(epoch(tables, corpus, ts, config, robots=robots), (checkpoint, number))

    return addresses.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
