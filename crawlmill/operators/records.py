"""Upserts of pages, host rules, edges and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions.text import sanitized
from crawlmill.operators.frontier import numbered

PAGE_COLUMNS = (
    "id", "url", "domain", "title", "summary", "embedding", "language", "status", "indexed_at", "created_at", "updated_at",
)


def inserted(known: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``known`` and the rows of ``incoming`` whose key it lacks, each key once."""
    return known.unionByName(incoming.dropDuplicates(key).join(known.select(*key), key, "left_anti").select(*known.columns))


def pages_upserted(pages: DataFrame, crawled: DataFrame, batch_ts: Column, rendered: bool = False) -> DataFrame:
    """Pages after a crawl: (url, domain, title, summary) of fetched pages, distinct on url.

    A known page takes the new text, loses embedding and language and is indexed
    anew; its created_at stays, and its host too if the page was rendered.
    """
    fresh = crawled.select("url", *[F.col(c).alias(f"_{c}") for c in ("domain", "title", "summary")]).withColumn("_in", F.lit(True))
    both = pages.withColumn("_old", F.lit(True)).join(fresh, "url", "full_outer")
    came, old = F.col("_in").isNotNull(), F.col("_old").isNotNull()
    host = F.when(came & ~(old & F.lit(rendered)), F.col("_domain")).otherwise(F.col("domain"))
    out = both.select(
        "id", "url", host.alias("domain"), "_old",
        F.when(came, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(came, F.col("_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(~came, F.col("embedding")).alias("embedding"),
        F.when(~came, F.col("language")).alias("language"),
        F.when(came, "indexed").otherwise(F.col("status")).alias("status"),
        F.when(came, batch_ts).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(old, F.col("created_at")).otherwise(batch_ts).alias("created_at"),
        F.when(came, batch_ts).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return numbered(out, "id", "url", "_old").select(*PAGE_COLUMNS)


def rules_completed(rules: DataFrame, domains: DataFrame, delay_ms: int = 1000) -> DataFrame:
    """Host rules with a default rule for each host of ``domains`` that has none."""
    fresh = domains.select("domain").where("domain is not null").select(
        "domain", F.lit(False).alias("blocked"), F.lit(delay_ms).alias("crawl_delay_ms"),
        F.lit(None).cast("timestamp").alias("last_crawled_at"), F.lit(None).cast("string").alias("robots_txt"),
    )
    return inserted(rules, fresh, ["domain"])


def rules_with_robots(rules: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rules after a robots fetch (domain, text): where no text was stored, what was fetched, null if that failed."""
    both = rules.join(fetched.select("domain", F.col("text").alias("_text"), F.lit(True).alias("_in")), "domain", "left")
    missing = F.col("_in").isNotNull() & (F.coalesce("robots_txt", F.lit("")) == "")
    text = F.when(missing, F.col("_text")).otherwise(F.col("robots_txt")).alias("robots_txt")
    return both.select(*[text if c == "robots_txt" else F.col(c) for c in rules.columns])


def robots_fetched(claimed: DataFrame, robots: DataFrame) -> DataFrame:
    """(domain, text) of the hosts of ``claimed`` by a robots corpus (domain, status, text): null unless the status is 200."""
    text = F.max(F.when(F.col("status") == 200, sanitized(F.col("text")))).alias("text")
    return claimed.select("domain").where("domain is not null").distinct().join(robots.groupBy("domain").agg(text), "domain", "left")


def rules_touched(rules: DataFrame, crawled: DataFrame, batch_ts: Column) -> DataFrame:
    """Rules with last_crawled_at set for the hosts of ``crawled``; hosts without a rule stay without."""
    hit = crawled.select("domain").where("domain is not null").distinct().withColumn("_in", F.lit(True))
    at = F.when(F.col("_in").isNotNull(), batch_ts).otherwise(F.col("last_crawled_at")).alias("last_crawled_at")
    return rules.join(hit, "domain", "left").select(*[at if c == "last_crawled_at" else F.col(c) for c in rules.columns])


def ruled(rows: DataFrame, rules: DataFrame, delay_ms: int = 1000) -> DataFrame:
    """``rows`` with their host's blocked, crawl_delay_ms and robots_txt; defaults where there is no rule."""
    some = rules.select("domain", "blocked", "crawl_delay_ms", "robots_txt")
    return rows.join(some, "domain", "left").select(
        *rows.columns,
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.coalesce("crawl_delay_ms", F.lit(delay_ms)).alias("crawl_delay_ms"),
        "robots_txt",
    )


def pending_embeddings(pages: DataFrame) -> DataFrame:
    """Indexed pages with a summary and no embedding."""
    return pages.where("status = 'indexed' and embedding is null and summary is not null and summary <> ''")


def embeddings_written(pages: DataFrame, vectors: DataFrame, batch_ts: Column) -> DataFrame:
    """Pages with the vectors (id, vector) where they had none; their language is reset."""
    both = pages.join(vectors.select("id", F.col("vector").alias("_v")), "id", "left")
    hit = F.col("_v").isNotNull() & F.col("embedding").isNull()
    new = {
        "embedding": F.when(hit, F.col("_v")).otherwise(F.col("embedding")),
        "language": F.when(~hit, F.col("language")),
        "updated_at": F.when(hit, batch_ts).otherwise(F.col("updated_at")),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in pages.columns])
