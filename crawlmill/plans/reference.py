"""Queries of the crawl pipeline's operators over the crawl index, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlmill.config import CrawlConfig
from crawlmill.functions import html, robots, text, urls
from crawlmill.operators import embed, frontier, links, metrics, records, search
from crawlmill.plans import crawl
from crawlmill.sources.tables import table
from crawlmill.plans.sql import KEYS as _KEYS, canon_sql
from crawlmill.streaming import events as event_time

BATCH_TS = "2026-01-01 00:00:00"
CONFIG = CrawlConfig()
LOW_CAP = 40
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ts() -> Column:
    return F.lit(BATCH_TS).cast("timestamp")


def _queue(spark: SparkSession, root: str) -> DataFrame:
    return frontier.delivered_once(table(spark, root, "crawler_queue"))


def _latest_pages(spark: SparkSession, root: str) -> DataFrame:
    """Of each address the page with the highest id, as the index holds an address once."""
    pages = table(spark, root, "pages")
    last = pages.groupBy("url").agg(F.max("id").alias("id"))
    return pages.join(last.select("id"), "id", "left_semi")


def _found(spark: SparkSession, root: str) -> DataFrame:
    """Links of pages in the queue, in order of address, as the planner reads them."""
    queue = _queue(spark, root).select(F.col("url").alias("source_url"), F.col("domain").alias("d"), "depth")
    found = table(spark, root, "page_links").select("source_url", "target_url").distinct()
    order = Window.partitionBy("source_url").orderBy("target_url")
    return found.join(queue, "source_url").select(
        "source_url", F.lower("d").alias("source_domain"), "depth",
        F.row_number().over(order).cast("bigint").alias("pos"), "target_url", urls.domain_of(F.col("target_url")).alias("target_domain"),
    )


def _seeds(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "crawler_seeds")


# SQL of the relations above
_Q = "(select distinct id, url, domain, priority, depth, status, attempts, needs_js, queued_at, last_attempt_at from crawler_queue)"
_P = "(select * from pages where id in (select max(id) from pages group by url))"
_DOM = "lower(regexp_extract({}, '(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1))"
_FOUND = f"""(select l.source_url, lower(q.domain) as source_domain, q.depth,
    row_number() over (partition by l.source_url order by l.target_url) as pos, l.target_url, {_DOM.format('l.target_url')} as target_domain
  from (select distinct source_url, target_url from page_links) l join {_Q} q on q.url = l.source_url)"""
_CAND = f"(select * from {_FOUND} where coalesce(depth, 0) < 3 and target_url <> source_url and target_domain <> '')"
_PLAN = f"""(select source_url, pos, target_url as url, target_domain as domain,
    case when i then -1 else 2 end as priority, cast(coalesce(depth, 0) + 1 as int) as depth, 'pending' as status, false as needs_js, i as is_internal
  from (select *, target_domain = source_domain as i,
               row_number() over (partition by source_url, target_domain order by pos, target_url) as n from {_CAND})
  where n <= case when i then 10 else 3 end)"""
_MERGED = f"""(select url, arg_min(domain, (source_url, pos)) as domain, max(priority) as priority, min(depth) as depth,
    'pending' as status, bool_or(needs_js) as needs_js from {_PLAN} group by url)"""
_TS = f"timestamptz '{BATCH_TS}+00'"
_LIGHT = "status = 'pending' and not coalesce(needs_js, false)"
_JS = "status = 'pending' and coalesce(needs_js, false)"


# --- addresses


@query("select domain, count(*) as n from pages group by 1 order by n desc, domain nulls first limit 20")
def top_domains(spark, root):
    return metrics.top(table(spark, root, "pages"), "domain", 20)


@query(f"select id, {_DOM.format('url')} as host from pages")
def domain_of_urls(spark, root):
    return table(spark, root, "pages").select("id", urls.domain_of(F.col("url")).alias("host"))


@query(r"select id, regexp_replace(url, '^https?://([^/]+).*$', '\1') as host from crawler_seeds")
def seed_domain_regex(spark, root):
    return _seeds(spark, root).select("id", urls.seed_domain(F.col("url")).alias("host"))


@query(f"select distinct target_url, {canon_sql('target_url')} as canonical from page_links")
def canonicalize_urls(spark, root):
    found = table(spark, root, "page_links").select("target_url").distinct()
    return found.select("target_url", urls.canonical(F.col("target_url")).alias("canonical"))


@query(
    f"""select distinct target_url, regexp_extract(target_url, '^([^?#]*)', 1) ||
      case when len(p) > 0 then '?' || array_to_string(p, '&') else '' end as bare
    from (select target_url, list_filter(string_split(regexp_extract(target_url, '\\?([^#]*)', 1), '&'),
      lambda x: regexp_matches(x, '^[^=]+=.+') and not regexp_matches(lower(x), '^(utm_[^=]*|{_KEYS})=')) as p from page_links)"""
)
def drop_tracking_params(spark, root):
    found = table(spark, root, "page_links").select("target_url").distinct()
    return found.select("target_url", urls.without_tracking(F.col("target_url")).alias("bare"))


@query(
    f"""select distinct target_url, h in ('boreka.example','penari.example') or h like '%.boreka.example' or h like '%.penari.example' as excluded,
      h in ('www.mipame.example') as tracker,
      (h = 'facebook.com' or h like '%.facebook.com') and (p like '/dialog/share%' or p like '/sharer.php%') as share,
      length(target_url) <= 60 as fits, false as skipped
    from (select target_url, {_DOM.format('target_url')} as h, lower(regexp_extract(target_url, '^https?://[^/?#]*([^?#]*)', 1)) as p from page_links)"""
)
def link_filters(spark, root):
    found = table(spark, root, "page_links").select("target_url").distinct()
    u = F.col("target_url")
    host = urls.domain_of(u)
    return found.select(
        u,
        urls.is_excluded(host, ("boreka.example", "penari.example")).alias("excluded"),
        urls.is_tracker(host, ("www.mipame.example",)).alias("tracker"),
        urls.is_share_link(host, urls.path_of(u)).alias("share"),
        urls.fits_queue(u, 60).alias("fits"),
        urls.is_skipped_href(u).alias("skipped"),
    )


@query(
    """select id, case id % 6 when 0 then 'a' || id || '.example' when 1 then 'b' || id || '.example' when 2 then '2001:db8::' || id when 3 then ':81' when 4 then '' else 'c@' end as host,
      case id % 6 when 0 then null when 1 then 'https://u:p@b' || id || '.example:8080/x' when 2 then 'http://[2001:db8::' || id || ']:80/' when 3 then 'http://:81/' when 5 then 'http://c@/y' end as canonical
    from pages"""
)
def odd_addresses(spark, root):
    """Host and canonical form of addresses made from ids: over-long, with user info, in capitals, IPv6, without host, of another scheme."""
    i = F.col("id")
    forms = (
        F.concat(F.format_string("https://a%d.example/", i), F.repeat(F.lit("y"), 1800)),
        F.format_string("HTTPS://U:p@B%d.Example:8080/x?utm_id=1#f", i),
        F.format_string("http://[2001:db8::%d]:80", i),
        F.lit("http://:81/"),
        F.format_string("ftp://d%d.example/", i),
        F.lit("http://c@/y;v?a="),
    )
    made = F.element_at(F.array(*forms), (i % 6 + 1).cast("int"))
    rows = table(spark, root, "pages").select("id", made.alias("url"))
    return rows.select("id", urls.domain_of(F.col("url")).alias("host"), urls.canonical(F.col("url")).alias("canonical"))


_INNER = "'https://in' || id || '.example/x'"


@query(
    f"""select id, case id % 4 when 0 then {_INNER} when 1 then null when 2 then null else 'https://notyoutube.example/redirect?q=' || id end as canonical from pages"""
)
def redirects(spark, root):
    """Canonical form of redirects made from ids: followed, without target, with an excluded host around it, of another host."""
    i = F.col("id")
    forms = (
        F.format_string("https://notyoutube.com/redirect?z=1&q=https%%3A%%2F%%2Fin%d.example%%2Fx%%3Futm_id%%3D1", i),
        F.lit("https://notyoutube.com/redirect?q="),
        F.format_string("https://www.youtube.com/redirect?q=https%%3A%%2F%%2Fin%d.example", i),
        F.format_string("https://notyoutube.example/redirect?q=%d", i),
    )
    made = F.element_at(F.array(*forms), (i % 4 + 1).cast("int"))
    return table(spark, root, "pages").select("id", urls.canonical(made).alias("canonical"))


# --- queue


@query(f"select id, url, priority, queued_at from {_Q} where {_LIGHT} order by priority desc nulls first, queued_at asc nulls last, id limit 40")
def queue_claim_light(spark, root):
    return frontier.claim(_queue(spark, root), 40).select("id", "url", "priority", "queued_at")


@query(f"select id, url, priority, queued_at from {_Q} where {_JS} order by priority desc nulls first, queued_at asc nulls last, id limit 1")
def queue_claim_js(spark, root):
    return frontier.claim(_queue(spark, root), 1, browser=True).select("id", "url", "priority", "queued_at")


@query(
    f"""select id, url, cast(t as int) as turn, cast((t - 1) % 4 as int) as worker from (select *, row_number() over
      (order by priority desc nulls first, queued_at asc nulls last, id) as t from {_Q} where {_LIGHT}) where t <= 40"""
)
def worker_assignment(spark, root):
    return frontier.by_worker(_queue(spark, root), 4, 40)


@query(f"select count(*) filter ({_LIGHT}) as pending, count(*) filter ({_JS}) as pending_js, count(*) filter (status = 'processing') as processing from {_Q}")
def queue_snapshot(spark, root):
    return frontier.snapshot(_queue(spark, root))


@query(f"select count(*) filter (status = 'pending') as pending, count(*) filter ({_JS}) as pending_js, count(*) filter (status = 'processing') as processing from {_Q}")
def queue_snapshot_js(spark, root):
    return frontier.snapshot(_queue(spark, root), browser=True)


@query(f"select status, count(*) as n from {_Q} group by 1")
def status_histogram(spark, root):
    return metrics.counts_by(_queue(spark, root), "status")


@query(f"select count(*) as n from {_Q} where status in ('pending', 'processing')")
def active_count(spark, root):
    return _queue(spark, root).where(F.col("status").isin("pending", "processing")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n from pages where status = 'indexed'")
def indexed_count(spark, root):
    return table(spark, root, "pages").where("status = 'indexed'").agg(F.count(F.lit(1)).alias("n"))


@query(f"select count(distinct domain) as n from {_Q}")
def distinct_domains(spark, root):
    return _queue(spark, root).select("domain").where("domain is not null").distinct().agg(F.count(F.lit(1)).alias("n"))


# --- links


@query(f"select source_url, url, domain, priority, depth from {_PLAN}")
def plan_links(spark, root):
    return links.planned(_found(spark, root)).select("source_url", "url", "domain", "priority", "depth")


@query(f"select source_url, url from {_PLAN} where is_internal")
def plan_internal(spark, root):
    return links.planned(_found(spark, root)).where("is_internal").select("source_url", "url")


@query(f"select source_url, url from {_PLAN} where not is_internal")
def plan_external(spark, root):
    return links.planned(_found(spark, root)).where("not is_internal").select("source_url", "url")


@query(f"select source_url, count(*) as n from {_CAND} group by 1")
def link_candidates(spark, root):
    return metrics.counts_by(links.candidates(_found(spark, root)), "source_url")


@query(f"select source_url, url from {_PLAN} where domain not in (select domain from pages where domain is not null group by 1 having count(*) >= {LOW_CAP})")
def domain_cap(spark, root):
    plan = links.planned(_found(spark, root))
    return links.under_cap(plan, table(spark, root, "pages"), LOW_CAP).select("source_url", "url")


@query(f"select url, domain, priority, depth, status, needs_js from {_MERGED}")
def merge_batch(spark, root):
    return links.merged_batch(links.planned(_found(spark, root)))


@query(f"select distinct source_url, url as target_url from {_PLAN}")
def edge_dedupe(spark, root):
    return links.edges(links.planned(_found(spark, root)))


@query("select source_url, target_url from page_links group by 1, 2")
def edge_insert_ignore(spark, root):
    found = table(spark, root, "page_links")
    known = found.where("found_at is null").select("source_url", "target_url").distinct()
    return records.inserted(known, found.select("source_url", "target_url"), ["source_url", "target_url"])


@query(f"select source_url, count(*) filter (is_internal) as internal, count(*) filter (not is_internal) as external from {_PLAN} group by 1")
def link_tallies(spark, root):
    return links.tallies(links.planned(_found(spark, root)))


# --- upserts and states

_UP = f"""(select coalesce(q.url, m.url) as url, q.id, q.url is null as fresh,
    m.url is not null and q.status in ('pending', 'failed') as again, q.* exclude (id, url),
    m.domain as md, m.priority as mp, m.depth as mdep from {_Q} q full join {_MERGED} m on q.url = m.url)"""


@query(
    f"""select url, case when fresh then 1 else 0 end as is_new, case when fresh or again then md else domain end as domain,
      case when fresh then mp when again then greatest(priority, mp) else priority end as priority,
      case when fresh then mdep when again then least(depth, mdep) else depth end as depth,
      case when fresh or again then 'pending' else status end as status,
      case when fresh then 0 else attempts end as attempts,
      case when fresh then false when again then coalesce(needs_js, false) else needs_js end as needs_js,
      case when fresh or again then {_TS} else queued_at end as queued_at
    from {_UP}"""
)
def queue_upsert(spark, root):
    queue = _queue(spark, root)
    top = queue.agg(F.max("id").alias("top"))
    out = frontier.upserted(queue, links.merged_batch(links.planned(_found(spark, root))), _ts())
    return out.crossJoin(F.broadcast(top)).select(
        "url", (F.col("id") > F.col("top")).cast("int").alias("is_new"), "domain", "priority", "depth", "status", "attempts", "needs_js", "queued_at"
    )


@query(
    f"""select url, (select max(id) from {_Q}) + row_number() over (order by url) as id from {_MERGED} where url not in (select url from {_Q})"""
)
def queue_new_ids(spark, root):
    queue = _queue(spark, root)
    out = frontier.upserted(queue, links.merged_batch(links.planned(_found(spark, root))), _ts())
    return out.join(queue.select("url"), "url", "left_anti").select("url", "id")


@query(
    f"""select coalesce(p.url, q.url) as url, coalesce(q.domain, p.domain) as domain,
      case when q.url is null then p.summary else 'text ' || q.id end as summary,
      case when q.url is null then p.language end as language, case when q.url is null then p.status else 'indexed' end as status,
      case when p.url is null then {_TS} else p.created_at end as created_at, case when q.url is null then p.updated_at else {_TS} end as updated_at
    from {_P} p full join (select * from {_Q} where status = 'done') q on p.url = q.url"""
)
def pages_upsert(spark, root):
    done = _queue(spark, root).where("status = 'done'")
    crawled = done.select("url", "domain", F.lit(None).cast("string").alias("title"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("summary"))
    out = records.pages_upserted(_latest_pages(spark, root), crawled, _ts())
    return out.select("url", "domain", "summary", "language", "status", "created_at", "updated_at")


@query(f"select url, domain, priority from {_Q} union all select url, regexp_replace(url, '^https?://([^/]+).*$', '\\1'), priority from crawler_seeds where url not in (select url from {_Q})")
def seed_insert_ignore(spark, root):
    known = _queue(spark, root).select("url", "domain", "priority")
    return records.inserted(known, _seeds(spark, root).select("url", urls.seed_domain(F.col("url")).alias("domain"), "priority"), ["url"])


_IDLE = "(select * replace (case when status in ('pending', 'processing') then 'failed' else status end as status) from {})".format(_Q)


@query(
    f"""select coalesce(q.url, s.url) as url, case when s.url is null then q.status else 'pending' end as status,
      case when s.url is null then q.priority else coalesce(s.priority, 0) end as priority,
      case when s.url is null then q.depth else 0 end as depth
    from {_IDLE} q full join crawler_seeds s on q.url = s.url"""
)
def seed_reactivation(spark, root):
    active = F.col("status").isin("pending", "processing")
    idle = _queue(spark, root).withColumn("status", F.when(active, "failed").otherwise(F.col("status")))
    seeds = _seeds(spark, root).select("url", urls.domain_of(F.col("url")).alias("domain"), "priority")
    return frontier.reactivated(idle, seeds, _ts()).select("url", "status", "priority", "depth")


@query(f"select id, status from {_Q}")
def seed_reactivation_busy(spark, root):
    seeds = _seeds(spark, root).select("url", urls.domain_of(F.col("url")).alias("domain"), "priority")
    return frontier.reactivated(_queue(spark, root), seeds, _ts()).select("id", "status")


@query(
    "select domain, blocked, crawl_delay_ms from domain_rules union all "
    "select distinct domain, false, 1000 from pages where domain is not null and domain not in (select domain from domain_rules)"
)
def rules_get_or_create(spark, root):
    return records.rules_completed(table(spark, root, "domain_rules"), table(spark, root, "pages")).select("domain", "blocked", "crawl_delay_ms")


@query(f"select domain, case when domain in (select domain from {_Q} where status = 'done') then {_TS} else last_crawled_at end as last_crawled_at from domain_rules")
def rules_touch(spark, root):
    done = _queue(spark, root).where("status = 'done'")
    return records.rules_touched(table(spark, root, "domain_rules"), done, _ts()).select("domain", "last_crawled_at")


@query("select domain, case when coalesce(robots_txt, '') = '' and blocked then 'User-agent: *' else robots_txt end as robots_txt from domain_rules")
def rules_robots_update(spark, root):
    rules = table(spark, root, "domain_rules")
    return records.rules_with_robots(rules, rules.where("blocked").select("domain", F.lit("User-agent: *").alias("text"))).select("domain", "robots_txt")


@query(f"select q.id, coalesce(r.blocked, false) as blocked, coalesce(r.crawl_delay_ms, 1000) as crawl_delay_ms from {_Q} q left join domain_rules r using (domain)")
def rules_default_join(spark, root):
    return records.ruled(_queue(spark, root), table(spark, root, "domain_rules")).select("id", "blocked", "crawl_delay_ms")


_RULES = """(select domain, unnest(list_filter(list_transform(string_split(robots_txt, chr(10)), lambda x: trim(regexp_extract(x, '(?i)^disallow:(.*)$', 1))),
    lambda x: x <> '')) as rule from domain_rules where regexp_matches(robots_txt, '^User-agent: (\\*|Googlebot)\\n'))"""


@query(
    f"""select q.id, exists (select 1 from {_RULES} r where r.domain = q.domain
      and starts_with(regexp_extract(q.url, '^https?://[^/?#]*([^?#]*)', 1), r.rule)) as blocked from {_Q} q"""
)
def robots_blocked(spark, root):
    joined = records.ruled(_queue(spark, root), table(spark, root, "domain_rules"))
    return joined.select("id", robots.robots_blocked(F.col("robots_txt"), urls.path_of(F.col("url"))).alias("blocked"))


def _attempts(spark, root) -> DataFrame:
    """Attempts on all queue rows: what is fetched is the latest page of the address.

    Without a page the row is not found if it is marked as failed, else it times
    out; a deleted page is gone, a pending one is no HTML.
    """
    rows = records.ruled(_queue(spark, root), table(spark, root, "domain_rules"))
    page = _latest_pages(spark, root).select("url", F.col("status").alias("_status"), "summary", F.lit(True).alias("_page"))
    got, lost = rows.join(page, "url", "left"), F.col("_page").isNull()
    return got.select(
        F.col("id").alias("item_id"), "blocked", robots.robots_blocked(F.col("robots_txt"), urls.path_of(F.col("url"))).alias("robots_blocked"),
        F.when(lost & (F.coalesce("status", F.lit("")) != "failed"), "timeout").alias("fetch_error"),
        F.when(lost, 404).when(F.col("_status") == "deleted", 410).otherwise(200).alias("http_status"),
        F.when(F.col("_status") == "pending", "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
        "summary",
    )


_RESULT = f"""(select id as item_id, case when blocked then 'dominio_bloqueado' when rb then 'bloqueado_robots'
    when lost and coalesce(qs, '') <> 'failed' then 'timeout' when lost then 'http_404' when ps = 'deleted' then 'http_410'
    when ps = 'pending' then 'nao_html' when coalesce(summary, '') = '' then 'sem_conteudo' end as error
  from (select q.id, q.status as qs, p.url is null as lost, p.status as ps, p.summary, coalesce(d.blocked, false) as blocked,
      exists (select 1 from {_RULES} r where r.domain = q.domain and starts_with(regexp_extract(q.url, '^https?://[^/?#]*([^?#]*)', 1), r.rule)) as rb
    from {_Q} q left join domain_rules d on d.domain = q.domain left join {_P} p on p.url = q.url))"""


@query(f"select item_id, error is null as ok, error, coalesce(error = 'sem_conteudo', false) as needs_js from {_RESULT}")
def gate_classification(spark, root):
    return frontier.classified(_attempts(spark, root))


@query(f"select count(*) filter (error is null) as success, count(*) filter (error is not null) as failed from {_RESULT}")
def batch_summary(spark, root):
    return metrics.batch_summary(frontier.classified(_attempts(spark, root)))


@query(f"select error, cast(nullif(regexp_extract(error, '^http_([0-9]+)$', 1), '') as int) as code, count(*) as n from {_RESULT} group by 1")
def error_codes(spark, root):
    out = frontier.classified(_attempts(spark, root)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    return out.select("error", text.error_code(F.col("error")).alias("code"), "n")


@query(
    f"""select q.id, case when r.error is null then 'done' when r.error = 'sem_conteudo' then 'pending' else 'failed' end as status,
      case when r.error is null then attempts else attempts + 1 end as attempts, case when r.error = 'sem_conteudo' then true else needs_js end as needs_js
    from {_Q} q join {_RESULT} r on r.item_id = q.id"""
)
def transition_results(spark, root):
    return frontier.after_results(_queue(spark, root), frontier.classified(_attempts(spark, root))).select("id", "status", "attempts", "needs_js")


@query(f"select id, case when id in (select id from {_Q} where {_LIGHT} order by priority desc nulls first, queued_at asc nulls last, id limit 40) then 'processing' else status end as status from {_Q}")
def lease(spark, root):
    queue = _queue(spark, root)
    return frontier.leased(queue, frontier.claim(queue, 40), _ts()).select("id", "status")


@query(f"select id, case when status = 'processing' then 'pending' else status end as status from {_Q}")
def rollback(spark, root):
    queue = _queue(spark, root)
    return frontier.rolled_back(queue, queue).select("id", "status")


@query(f"select id, case when status = 'processing' and last_attempt_at < timestamptz '2025-01-01 00:00:00+00' then 'pending' else status end as status from {_Q}")
def reclaim_stuck(spark, root):
    return frontier.reclaimed(_queue(spark, root), F.lit("2025-01-01 00:00:00").cast("timestamp")).select("id", "status")


# --- texts and pages

_WS = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("select doc_id, replace(text, chr(0), '') as clean from documents")
def sanitize(spark, root):
    return table(spark, root, "documents").select("doc_id", text.sanitized(F.col("text")).alias("clean"))


@query(f"select doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) as clean from documents")
def collapse_ws(spark, root):
    return table(spark, root, "documents").select("doc_id", text.collapsed(F.col("text")).alias("clean"))


@query("select doc_id, array_to_string(list_slice(regexp_extract_all(text, '(?s).'), 1, 1000), '') as cut from documents where text is not null union all select doc_id, null from documents where text is null")
def truncate_text(spark, root):
    return table(spark, root, "documents").select("doc_id", text.truncated(F.col("text"), 1000).alias("cut"))


@query("select id, cast((row_number() over (partition by domain order by url, id) - 1) // 250 as bigint) as chunk from pages")
def chunk_rows(spark, root):
    return frontier.in_chunks(table(spark, root, "pages").select("id", "domain", "url"), "domain", ["url", "id"], 250).select("id", "chunk")


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _as_html(title: Column, summary: Column) -> Column:
    """A page's stored text as HTML: one paragraph per line in an article, a link in a nav, a footer."""
    lines = F.transform(F.split(F.coalesce(summary, F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>")))
    head = F.concat(F.lit("<html><head><title>"), _escaped(F.coalesce(title, F.lit(""))), F.lit("</title></head><body><nav><a href=\"/\">x</a></nav>"))
    return F.concat(head, F.lit("<article>"), F.array_join(lines, ""), F.lit("</article><footer><p>© a footer that is long enough</p></footer></body></html>"))


_LINES = f"""(select id, title, list_filter(list_transform(string_split(coalesce(summary, ''), chr(10)),
    lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')), lambda x: length(x) >= 30) as l from pages)"""


@query(
    f"""select id, nullif(array_to_string(list_slice(regexp_extract_all(trim(regexp_replace(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' '),
      '{_WS}', ' ', 'g')), '(?s).'), 1, 1000), ''), '') as summary from {_LINES}"""
)
def page_summary(spark, root):
    pages = table(spark, root, "pages").select("id", _as_html(F.col("title"), F.col("summary")).alias("html"))
    return pages.select("id", html.parse_html("html").alias("page")).select("id", html.summary_of(F.col("page"), CONFIG).alias("summary"))


@query(f"select id, nullif(regexp_replace(title, '^{_WS}|{_WS}$', '', 'g'), '') as title from pages")
def page_title(spark, root):
    pages = table(spark, root, "pages").select("id", _as_html(F.col("title"), F.col("summary")).alias("html"))
    parsed = pages.select("id", html.parse_html("html").alias("page"))
    title = html.title_of(F.col("page"))
    return parsed.select("id", F.when(title != "", title).alias("title"))


def _shaped() -> Column:
    """Pages in other shapes: lines as paragraph, list item, heading and aside in turn, some without title or text, with meta tags for those."""
    i = F.col("id")

    def tag(name: str, x: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))

    def shaped(x: Column, n: Column) -> Column:
        text, turn = _escaped(x), (n + 1) % 4
        return F.when(turn == 1, tag("p", text)).when(turn == 2, tag("li", text)).when(turn == 3, tag("h2", text)).otherwise(tag("aside", tag("p", text)))

    def meta(test: Column, kind: str, name: str, text: str) -> Column:
        return F.when(test, F.format_string(f'<meta {kind}="{name}" content="{text} %d">', i)).otherwise("")

    lines = F.when(i % 6 != 0, F.array_join(F.transform(F.split(F.coalesce("summary", F.lit("")), "\n"), shaped), "")).otherwise("")
    return F.concat(
        F.lit("<html><head>"), tag("title", F.when(i % 3 != 0, _escaped(F.coalesce("title", F.lit("")))).otherwise("")),
        meta(i % 2 == 0, "property", "og:title", "og"), meta(i % 5 == 0, "name", "twitter:title", "tw"),
        meta(i % 4 == 0, "name", "description", "about"), meta(i % 4 < 2, "property", "og:description", "og about"),
        F.lit("</head><body><article>"), lines, F.lit("</article></body></html>"),
    )


_SHAPED = f"""(select id, title, list_filter(list_transform(string_split(coalesce(summary, ''), chr(10)), lambda x: trim(regexp_replace(x, '{_WS}', ' ', 'g'))),
    lambda x, i: i % 4 <> 0 and length(x) >= case when i % 4 = 3 then {CONFIG.min_heading} else {CONFIG.min_text} end) as l from pages)"""


@query(
    f"""select id, coalesce(case when id % 3 <> 0 then nullif(regexp_replace(title, '^{_WS}|{_WS}$', '', 'g'), '') end,
        case when id % 2 = 0 then 'og ' || id when id % 5 = 0 then 'tw ' || id end) as title,
      coalesce(case when id % 6 <> 0 then nullif(array_to_string(list_slice(regexp_extract_all(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' '),
        '(?s).'), 1, {CONFIG.summary_rendered}), ''), '') end, case id % 4 when 0 then 'about ' || id when 1 then 'og about ' || id end,
        case when id % 10 <> 0 then 'body ' || id end) as summary from {_SHAPED}"""
)
def rendered_page(spark, root):
    """Title and text of rendered pages, with what stands in for them."""
    body = F.when(F.col("id") % 10 != 0, F.format_string("body %d", "id"))
    parsed = table(spark, root, "pages").select("id", body.alias("body"), html.parse_html(_shaped()).alias("page"))
    page = F.col("page")
    return parsed.select("id", html.title_of(page, True).alias("title"), html.rendered_summary(page, F.col("body"), CONFIG).alias("summary"))


_BASE = "'https://site' || id % 7 || '.example'"


@query(
    f"""select {_BASE} || '/a/' || id as source_url, 0 as pos, {_BASE} || '/p/' || id as target_url, 'site' || id % 7 || '.example' as target_domain from pages
      union all select {_BASE} || '/a/' || id, 4, 'https://other' || id % 5 || '.example/q?b=1', 'other' || id % 5 || '.example' from pages
      union all select {_BASE} || '/a/' || id, 5, 'https://h' || id % 3 || '.example/z', 'h' || id % 3 || '.example' from pages"""
)
def page_hrefs(spark, root):
    """Links of pages made from their ids: noise, repeats once resolved, tracking, parameters, fragments, mail."""
    i = F.col("id")
    made = F.format_string(
        '<nav><a href="/nav">x</a></nav><article><a href="/p/%d?utm_source=x">a</a><a href="#top">b</a><a href=" /p/%d ">c</a><a href="mailto:x@y">d</a>'
        '<a href="https://other%d.example/q?b=1&amp;a=">e</a><a href="//H%d.Example/z;v">f</a></article>', i, i, i % 5, i % 3,
    )
    pages = table(spark, root, "pages").select(F.format_string("https://site%d.example/a/%d", i % 7, i).alias("url"), html.parse_html(made).alias("page"))
    ok = pages.select("url", urls.domain_of(F.col("url")).alias("domain"), F.lit(0).alias("depth"), F.col("page.links").alias("hrefs"))
    return crawl.found_links(ok).select("source_url", "pos", "target_url", "target_domain")


@query(f"select id, 'search_document: ' || summary as text from {_P} where status = 'indexed' and embedding is null and summary is not null and summary <> ''")
def pending_embeddings(spark, root):
    return records.pending_embeddings(_latest_pages(spark, root)).select("id", text.embedding_text(F.col("summary")).alias("text"))


@query("select id from pages where id > 100 and status = 'indexed' and embedding is null and summary is not null and summary <> '' order by id limit 4096")
def keyset_page(spark, root):
    return records.pending_embeddings(table(spark, root, "pages").where("id > 100")).orderBy("id").limit(4096).select("id")


@query()
def embed_backfill(spark, root):
    pages = _latest_pages(spark, root)
    vectors = embed.embedded(records.pending_embeddings(pages))
    return records.embeddings_written(pages, vectors, _ts()).select("id", "embedding", "language", "updated_at")


_PENDING = "(status = 'indexed' and embedding is null and summary is not null and summary <> '')"


@query(
    f"""select id, embedding is not null or coalesce({_PENDING}, false) as embedded, case when not coalesce({_PENDING}, false) then language end as language,
      case when {_PENDING} then timestamptz '{BATCH_TS}+00' else updated_at end as updated_at from {_P}"""
)
def embed_backfill_fields(spark, root):
    """What a backfill changes beside the vectors."""
    return embed_backfill(spark, root).select("id", F.col("embedding").isNotNull().alias("embedded"), "language", "updated_at")


@query(
    """select doc_id, case when n_chars / 10 < 60 then printf('%.1fs', n_chars / 10)
      else printf('%dm%02ds', (n_chars // 600)::bigint, (n_chars % 600 // 10)::bigint) end as took from documents"""
)
def durations(spark, root):
    """Tenths of a second as the progress report writes them; lengths of texts stand in for times."""
    return table(spark, root, "documents").select("doc_id", text.duration(F.col("n_chars") / 10).alias("took"))


_SHARED = [(d, p) for d, p in urls.SHARE_PATHS]
_SHARE_HOST = "list_extract([{}], (id % {} + 1)::int)".format(", ".join(f"'{d}'" for d, _ in _SHARED), len(_SHARED))
_SHARE_PATH = "list_extract([{}], (id // 3 % {} + 1)::int)".format(", ".join(f"'{p}'" for _, p in _SHARED), len(_SHARED))
_IS_SHARED = " or ".join(f"((host = '{d}' or host like '%.{d}') and starts_with(lower(path), '{p}'))" for d, p in _SHARED)


@query(
    f"""select id, coalesce({_IS_SHARED}, false) as share from (select id, case id % 5 when 0 then domain when 1 then 'www.' || {_SHARE_HOST} when 2 then 'x' || {_SHARE_HOST}
        else {_SHARE_HOST} end as host, (case id % 2 when 0 then upper({_SHARE_PATH}) else {_SHARE_PATH} end) || id as path from pages) t"""
)
def share_links(spark, root):
    """Share links by host and path; hosts and paths of the list are mixed by the page's id, so that some fit and some do not."""
    n, i = len(_SHARED), F.col("id")
    host = F.element_at(F.array(*[F.lit(d) for d, _ in _SHARED]), (i % n + 1).cast("int"))
    path = F.element_at(F.array(*[F.lit(p) for _, p in _SHARED]), (F.floor(i / 3) % n + 1).cast("int"))
    own = F.when(i % 5 == 0, F.col("domain")).when(i % 5 == 1, F.concat(F.lit("www."), host)).when(i % 5 == 2, F.concat(F.lit("x"), host)).otherwise(host)
    made = table(spark, root, "pages").select("id", own.alias("host"), F.concat(F.when(i % 2 == 0, F.upper(path)).otherwise(path), i.cast("string")).alias("path"))
    return made.select("id", F.coalesce(urls.is_share_link(F.col("host"), F.col("path")), F.lit(False)).alias("share"))


_HREF_HEADS = ("", "#", "mailto:", "MAILTO:", "javascript:", "tel:", " #", "  tel:", "/", "ftp:")
_SKIPPED = " or ".join(f"starts_with(trim(href), '{p}')" for p in urls.SKIPPED_HREFS)


@query(
    "select id, coalesce(trim(href) = '' or {}, true) as skipped from (select id, case when id % 11 = 0 then '  ' else list_extract([{}], (id % {} + 1)::int) || url end as href from pages) t".format(
        _SKIPPED, ", ".join(f"'{h}'" for h in _HREF_HEADS), len(_HREF_HEADS)
    )
)
def skipped_hrefs(spark, root):
    """Links skipped by their beginning, which is put before each page's address by its id."""
    i = F.col("id")
    head = F.element_at(F.array(*[F.lit(h) for h in _HREF_HEADS]), (i % len(_HREF_HEADS) + 1).cast("int"))
    made = table(spark, root, "pages").select("id", F.when(i % 11 == 0, "  ").otherwise(F.concat(head, "url")).alias("href"))
    return made.select("id", urls.is_skipped_href(F.col("href")).alias("skipped"))


@query(
    """select 100.0::double * done / total as pct, done / 12.5 as rate, total - done as remaining, (total - done) / (done / 12.5) as eta_s
    from (select count(*) as total, cast(count(embedding) as double) as done from pages)"""
)
def backfill_progress(spark, root):
    counted = table(spark, root, "pages").agg(F.count(F.lit(1)).alias("total"), F.count("embedding").cast("double").alias("done"))
    return counted.select(*metrics.progress(F.col("done"), F.col("total"), F.lit(12.5))).select("pct", "rate", "remaining", "eta_s")


@query(
    """select domain, cast(greatest(1, ceil(greatest(120, floor((greatest(1, ceil(40 / 20.0)) * (15 + coalesce(crawl_delay_ms, 1000) / 1000.0) + 20) * 2)) / 60.0)) as int) as minutes
    from domain_rules"""
)
def watchdog_budget(spark, root):
    delay = F.coalesce("crawl_delay_ms", F.lit(CONFIG.crawl_delay_ms))
    minutes = metrics.watchdog_minutes(F.lit(CONFIG.batch_size), F.lit(CONFIG.concurrency), F.lit(CONFIG.request_timeout), delay)
    return table(spark, root, "domain_rules").select("domain", minutes.alias("minutes"))


@query(f"select id, least(5.0::double, 0.25::double * power(2.0::double, attempts - 1)) as wait_s from {_Q} where attempts >= 1")
def backoff_schedule(spark, root):
    return _queue(spark, root).where("attempts >= 1").select("id", metrics.backoff_seconds(F.col("attempts")).alias("wait_s"))


# --- extensions


@query(
    """select vec_id, round(n, 5) as norm from (select vec_id, sqrt(list_sum(list_transform(list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y)))), lambda z: z * z))) as n from embeddings)"""
)
def l2_normalize(spark, root):
    v = text.unit(F.col("embedding"))
    return table(spark, root, "embeddings").select("vec_id", F.round(F.sqrt(text.dot(v, v)), 5).alias("norm"))


def _first_vector(spark, root) -> list[float]:
    return table(spark, root, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


@query(
    """select vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::double * x[2])), 5) as score
    from embeddings, (select embedding as q from embeddings order by vec_id limit 1) order by score desc, vec_id limit 10"""
)
def vector_topk(spark, root):
    return search.top_k(table(spark, root, "embeddings"), _first_vector(spark, root), 10, "inner").select("vec_id", F.round("score", 5).alias("score"))


_EDGE = "(select distinct source_url, target_url from page_links)"


@query(
    f"""select coalesce(i.url, o.url) as url, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree
    from (select target_url as url, count(*) as n from {_EDGE} group by 1) i full join (select source_url as url, count(*) as n from {_EDGE} group by 1) o on i.url = o.url"""
)
def degree(spark, root):
    return search.degrees(table(spark, root, "page_links"))


def _rank_sql(rounds: int) -> str:
    out = f"with e as (select l.*, n from {_EDGE} l join (select source_url, count(*) as n from {_EDGE} group by 1) using (source_url)), r0 as (select url, 1.0::double as rank from (select source_url as url from e union select target_url from e))"
    for i in range(1, rounds + 1):
        out += f", r{i} as (select r.url, 0.15 + 0.85 * coalesce(g, 0) as rank from r{i - 1} r left join (select target_url, sum(rank / n) as g from e join r{i - 1} on url = source_url group by 1) on url = target_url)"
    return out + f" select url, rank::float::double as rank from r{rounds}"


@query(_rank_sql(3))
def pagerank(spark, root):
    return search.pagerank(table(spark, root, "page_links"), 3).select("url", F.col("rank").cast("float").cast("double").alias("rank"))


@query(
    r"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from documents where text is not null),
    c as (select count(*) as d, avg(len(words)) as m from w),
    t as (select doc_id, len(words) as l, u.term, len(list_filter(words, lambda x: x = u.term)) as tf from w, (select unnest(['browser', 'library', 'rede']) as term) u),
    f as (select term, count(*) as df from t where tf > 0 group by 1)
    select doc_id, round(sum(ln(1 + (d - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / m))), 5) as score
    from t join f using (term), c where tf > 0 group by 1 order by score desc, doc_id limit 20"""
)
def bm25_search(spark, root):
    found = search.bm25(table(spark, root, "documents"), ["browser", "library", "rede"], 20)
    return found.select("doc_id", F.round("score", 5).alias("score"))


@query("select date_trunc('day', ts)::timestamptz as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, root):
    return event_time.windowed(table(spark, root, "events")).withColumn("total", F.round("total", 4))


@query(
    """select user_id, cast(s as bigint) as session, count(*) as n from (select *, sum(b) over (partition by user_id order by ts, event_id) as s from
      (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as b from events where ts is not null)) group by 1, 2"""
)
def event_sessions(spark, root):
    return search.sessions(table(spark, root, "events")).select("user_id", "session", "n")
