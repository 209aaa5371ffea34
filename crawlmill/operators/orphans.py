"""References to records that do not exist, per field and month of finding.

Distinct (address, month) keys of the links are left-anti-joined with the
addresses that had a live page by the end of that month; the orphan keys join
back to the links, or to their pre-aggregated counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions.urls import canonical
from crawlmill.operators.skew import salted_semi_join

FIELDS = ("source_url", "target_url")


def month_of(at: Column) -> Column:
    """Month of a timestamp in UTC as yyyy-MM, whatever the session's zone."""
    days = F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_from_unix_date(days), "yyyy-MM")


def references(links: DataFrame) -> DataFrame:
    """One row per link and field: ref_field, found_month, address, source_url, target_url.

    ``address`` is the canonical form; an address without one stands for itself.
    Links without found_at, and null addresses, are left out.
    """
    both = links.where(F.col("found_at").isNotNull()).select(
        month_of(F.col("found_at")).alias("found_month"),
        *FIELDS,
        *[F.coalesce(canonical(F.col(f)), F.col(f)).alias(f"_{f}") for f in FIELDS],
    )
    refs = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f"_{f}").alias("address")) for f in FIELDS])
    return both.select("found_month", *FIELDS, F.inline(refs)).where("address is not null")


def live_since(pages: DataFrame) -> DataFrame:
    """(address, first_month): month in which the first page not deleted was created under an address."""
    return (
        pages.where(
            (F.coalesce(F.col("status"), F.lit("")) != "deleted")
            & F.col("url").isNotNull()
            & F.col("created_at").isNotNull()
        )
        .select(F.coalesce(canonical(F.col("url")), F.col("url")).alias("address"), month_of(F.col("created_at")).alias("m"))
        .groupBy("address")
        .agg(F.min("m").alias("first_month"))
    )


def orphan_keys(refs: DataFrame, pages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (address, found_month, *by) without a live page by that month's end, and ``refs``, their count."""
    keys = refs.groupBy("address", "found_month", *by).agg(F.count(F.lit(1)).alias("refs"))
    live = live_since(pages)
    return keys.join(
        live, (keys["address"] == live["address"]) & (live["first_month"] <= keys["found_month"]), "left_anti"
    )


def orphan_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(ref_field, found_month, source_url, target_url) of every link with an orphan address, each once.

    Repeated links give one row; empty inputs give none; without pages every
    reference is an orphan. Other columns of the inputs play no part.
    """
    refs = references(links)
    hits = salted_semi_join(refs, orphan_keys(refs, pages), ["address", "found_month"], "refs")
    return hits.select("ref_field", "found_month", *FIELDS).distinct()


def orphan_report(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Per field and month: orphan addresses, orphan references, and all references.

    Works on counts per key alone; no link is shuffled back.
    """
    refs = references(links)
    lost = orphan_keys(refs, pages, ("ref_field",)).groupBy("ref_field", "found_month").agg(
        F.count(F.lit(1)).alias("orphan_addresses"), F.sum("refs").alias("orphan_refs")
    )
    every = refs.groupBy("ref_field", "found_month").agg(F.count(F.lit(1)).alias("all_refs"))
    return every.join(lost, ["ref_field", "found_month"], "left").select(
        "ref_field",
        "found_month",
        F.coalesce("orphan_addresses", F.lit(0)).cast("bigint").alias("orphan_addresses"),
        F.coalesce("orphan_refs", F.lit(0)).cast("bigint").alias("orphan_refs"),
        "all_refs",
    )
