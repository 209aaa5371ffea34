"""Queries of the general problems 1 and 4, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.functions.urls import host_of
from crawlmill.operators.heavy_keys import heavy_keys, join_states, joined_results, key_states, rank_by_count
from crawlmill.operators.orphans import orphan_links, orphan_report
from crawlmill.plans.sql import canon_sql
from crawlmill.sources.tables import table

HEAVY_SHARE = 0.03


def host_states(pages: DataFrame, queue: DataFrame) -> DataFrame:
    host = host_of(F.col("_raw"))
    return join_states(
        key_states(pages, "domain", host, "pages"),
        key_states(queue, "domain", host, "queue", {"attempts": F.col("attempts"), "priority": F.col("priority")}),
    )


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    pages, queue = table(spark, root, "pages"), table(spark, root, "crawler_queue")
    totals = pages.agg(F.count(F.lit(1)).alias("pages_rows")).crossJoin(queue.agg(F.count(F.lit(1)).alias("queue_rows")))
    found = heavy_keys(
        host_states(pages, queue), {"pages": "pages_rows", "crawler_queue": "queue_rows"}, totals, HEAVY_SHARE
    )
    return found.select("table_name", F.col("key").alias("host"))


def p1_host_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals, joined totals and rank of every host."""
    states = host_states(table(spark, root, "pages"), table(spark, root, "crawler_queue"))
    return rank_by_count(joined_results(states, "pages", "queue"), "pages_rows", "pages_rank").select(
        F.col("key").alias("host"),
        "pages_rows",
        "queue_rows",
        "queue_attempts",
        "queue_priority",
        F.col("pairs").cast("double").alias("pairs"),
        F.col("joined_queue_attempts").cast("double").alias("joined_queue_attempts"),
        "pages_rank",
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return orphan_links(table(spark, root, "page_links"), table(spark, root, "pages"))


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(table(spark, root, "page_links"), table(spark, root, "pages"))


_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(domain)), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')"

_REFS = " union all ".join(
    f"""select '{f}' as ref_field, strftime(found_at at time zone 'UTC', '%Y-%m') as found_month, source_url, target_url, {canon_sql(f)} as a
    from page_links where found_at is not null"""
    for f in ("source_url", "target_url")
)
_ORPHANS = f"""
        with live as (select {canon_sql('url')} as a, min(strftime(created_at at time zone 'UTC', '%Y-%m')) as m from pages
          where coalesce(status, '') <> 'deleted' and created_at is not null group by 1),
        refs as ({_REFS}),
        marked as (select refs.*, live.a is null as orphan from refs left join live on live.a = refs.a and live.m <= refs.found_month)"""

QUERIES = {"p1_found": p1_found, "p1_host_totals": p1_host_totals, "p4_found": p4_found, "p4_report": p4_report}

SQL = {
    "p1_found": f"""
        with h as (
          select 'pages' as table_name, {_HOST} as host from pages
          union all
          select 'crawler_queue', {_HOST} from crawler_queue),
        t as (select table_name, count(*) as n from h group by 1)
        select h.table_name, h.host from h join t using (table_name)
        where h.host is not null
        group by h.table_name, h.host, t.n having count(*) >= 0.03 * t.n""",
    "p1_host_totals": f"""
        with p as (select {_HOST} as host, count(*) as n from pages where domain is not null group by 1),
        q as (select {_HOST} as host, count(*) as n, sum(attempts) as a, sum(priority) as y
              from crawler_queue where domain is not null group by 1),
        b as (select coalesce(p.host, q.host) as host, coalesce(p.n, 0) as pn, coalesce(q.n, 0) as qn,
                     coalesce(q.a, 0) as a, coalesce(q.y, 0) as y
              from p full join q on p.host = q.host)
        select host, cast(pn as bigint) as pages_rows, cast(qn as bigint) as queue_rows,
               cast(a as bigint) as queue_attempts, cast(y as bigint) as queue_priority,
               cast(pn as double) * qn as pairs, cast(pn as double) * cast(a as double) as joined_queue_attempts,
               cast(rank() over (order by pn desc) as bigint) as pages_rank
        from b""",
    "p4_found": f"{_ORPHANS} select distinct ref_field, found_month, source_url, target_url from marked where orphan",
    "p4_report": f"""{_ORPHANS} select ref_field, found_month, count(distinct a) filter (orphan) as orphan_addresses,
          count(*) filter (orphan) as orphan_refs, count(*) as all_refs from marked group by 1, 2""",
}
