"""Planning of found links: filters, caps per page, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.config import CrawlConfig


def candidates(links: DataFrame, config: CrawlConfig = CrawlConfig(), domain: str = "target_domain") -> DataFrame:
    """Links worth planning: source not too deep, target not the source itself, target with a host.

    ``links`` is (source_url, source_domain, depth, pos, target_url, target_domain).
    """
    return links.where(
        (F.coalesce(F.col("depth"), F.lit(0)) < config.max_depth)
        & (F.col("target_url") != F.col("source_url"))
        & (F.col(domain) != "")
    )


def planned(links: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Queue rows of found links: (source_url, pos, url, domain, priority, depth, status, needs_js, is_internal).

    Of each page the first internal links and the first external ones per
    target host count, in document order, ties by address; one window serves
    both caps, as all internal links of a page share their host.
    """
    inside = F.col("target_domain") == F.col("source_domain")
    order = Window.partitionBy("source_url", "target_domain").orderBy("pos", "target_url")
    cap = F.when(F.col("is_internal"), config.max_internal_links).otherwise(config.max_external_per_domain)
    ranked = candidates(links, config).withColumn("is_internal", inside).withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= cap).select(
        "source_url",
        "pos",
        F.col("target_url").alias("url"),
        F.col("target_domain").alias("domain"),
        F.when(F.col("is_internal"), config.internal_priority).otherwise(config.external_priority).alias("priority"),
        (F.coalesce(F.col("depth"), F.lit(0)) + 1).cast("int").alias("depth"),
        F.lit("pending").alias("status"),
        F.lit(False).alias("needs_js"),
        "is_internal",
    )


def under_cap(plan: DataFrame, pages: DataFrame, cap: int, domain: str = "domain") -> DataFrame:
    """``plan`` without rows of hosts that have ``cap`` pages or more; freed places are not refilled.

    Counting reduces in the scan; only saturated hosts meet the plan. How many
    there are is bounded by pages / cap, and their size decides on a broadcast.
    """
    full = pages.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap)
    return plan.join(full.select(F.col("domain").alias(domain)), domain, "left_anti").select(*plan.columns)


def merged_batch(plan: DataFrame) -> DataFrame:
    """One row per address: highest priority, least depth, any needs_js, host and status of the first mention."""
    first = F.struct("source_url", "pos")
    return plan.groupBy("url").agg(
        F.min_by("domain", first).alias("domain"),
        F.max("priority").alias("priority"),
        F.min("depth").alias("depth"),
        F.min_by("status", first).alias("status"),
        F.bool_or(F.coalesce("needs_js", F.lit(False))).alias("needs_js"),
    )


def edges(plan: DataFrame) -> DataFrame:
    """Distinct (source_url, target_url) of planned links."""
    return plan.select("source_url", F.col("url").alias("target_url")).distinct()


def tallies(plan: DataFrame) -> DataFrame:
    """Internal and external planned links per page."""
    return plan.groupBy("source_url").agg(
        F.count_if("is_internal").alias("internal"), F.count_if(~F.col("is_internal")).alias("external")
    )
