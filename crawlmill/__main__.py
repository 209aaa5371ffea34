"""python -m crawlmill query NAME ROOT OUT | crawl STORE CORPUS SEEDS [--browser] [--epochs N] [--robots CORPUS] | backfill STORE"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crawlmill.config import CrawlConfig
from crawlmill.operators import embed, records
from crawlmill.plans import catalogue, crawl
from crawlmill.sources.store import SnapshotStore


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="crawlmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="writes a query's result as Parquet")
    for name in ("name", "root", "out"):
        query.add_argument(name)
    run = commands.add_parser("crawl", help="runs crawl epochs over a corpus")
    for name in ("store", "corpus", "seeds"):
        run.add_argument(name)
    run.add_argument("--browser", action="store_true")
    run.add_argument("--epochs", type=int, default=1)
    run.add_argument("--robots", help="robots corpus (domain, status, text)")
    fill = commands.add_parser("backfill", help="embeds indexed pages without an embedding")
    fill.add_argument("store")
    args = parser.parse_args(argv)

    spark = spark or SparkSession.builder.appName("crawlmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = F.lit(datetime.now(timezone.utc)).cast("timestamp")
    if args.command == "query":
        catalogue.QUERIES[args.name](spark, args.root).write.mode("errorifexists").parquet(args.out)
    elif args.command == "crawl":
        store = SnapshotStore(spark, args.store)
        seeds = spark.read.parquet(args.seeds)
        robots = spark.read.parquet(args.robots) if args.robots else None
        crawl.crawl(store, spark.read.parquet(args.corpus), seeds, now, args.epochs, CrawlConfig.from_env(), args.browser, robots)
    else:
        store = SnapshotStore(spark, args.store)
        pages = store.read("pages")
        store.commit({"pages": records.embeddings_written(pages, embed.embedded(records.pending_embeddings(pages)), now)})


if __name__ == "__main__":
    main()
