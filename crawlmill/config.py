"""Settings of the crawl pipeline, with the defaults its operators use."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Hosts never queued, tracking keys and hosts, share links.
EXCLUDED_DOMAINS = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "api.whatsapp.com",
    "wa.me", "web.whatsapp.com", "github.com", "youtube.com", "youtu.be",
)
TRACKING_KEYS = (
    "fbclid", "gclid", "dclid", "yclid", "msclkid", "mc_cid", "mc_eid",
    "_hsenc", "_hsmi", "mkt_tok", "igshid", "ref_src",
)
TRACKING_HOSTS = ("www.googleadservices.com", "googleads.g.doubleclick.net", "ad.doubleclick.net")
SHARE_PATHS = (
    ("facebook.com", "/dialog/share"),
    ("facebook.com", "/sharer.php"),
    ("twitter.com", "/intent/"),
    ("x.com", "/intent/"),
    ("linkedin.com", "/shareArticle"),
    ("api.whatsapp.com", "/send"),
)
NOISE_TAGS = ("nav", "footer", "aside", "header")
BLOCK_TAGS = ("h1", "h2", "h3", "p", "li")
ROBOT_AGENTS = ("*", "Googlebot")


# Names of settings in the environment that are not those of the fields.
ENVIRONMENT = {
    "excluded_domains": ("EXCLUDED_QUEUE_DOMAINS",),
    "max_url_length": ("MAX_QUEUE_URL_LENGTH",),
    "max_external_per_domain": ("MAX_LINKS_PER_DOMAIN_PER_PAGE",),
    "max_internal_links": ("MAX_INTERNAL_LINKS_PER_PAGE",),
    "external_priority": ("EXTERNAL_LINK_PRIORITY",),
    "internal_priority": ("INTERNAL_LINK_PRIORITY",),
    "concurrency": ("CONCURRENT_REQUESTS", "CRAWLER_CONCURRENCY"),
    "batch_size": ("CRAWLER_BATCH_SIZE",),
}


@dataclass(frozen=True)
class CrawlConfig:
    """Frozen settings; ``from_env`` reads ``ENVIRONMENT`` and else the upper-case names of the fields."""

    max_depth: int = 3
    max_url_length: int = 1800
    max_internal_links: int = 10
    max_external_per_domain: int = 3
    internal_priority: int = -1
    external_priority: int = 2
    max_pages_per_domain: int = 30000
    batch_size: int = 40
    concurrency: int = 20
    request_timeout: int = 15
    crawl_delay_ms: int = 1000
    summary_light: int = 1000
    summary_rendered: int = 1200
    min_heading: int = 6
    min_text: int = 30
    embedding_dim: int = 768
    playwright_fallback_to_pending: bool = False
    excluded_domains: tuple[str, ...] = EXCLUDED_DOMAINS
    tracking_hosts: tuple[str, ...] = TRACKING_HOSTS

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "CrawlConfig":
        env = dict(os.environ) if env is None else env
        given: dict = {}
        for f in fields(cls):
            names = (*ENVIRONMENT.get(f.name, ()), f.name.upper())
            raw = next((env[n] for n in names if n in env), None)
            if raw is None:
                continue
            read = csv_set if f.name in ("excluded_domains", "tracking_hosts") else truthy if f.name.startswith("playwright") else int
            given[f.name] = read(raw)
        given.setdefault("batch_size", max(cls.batch_size, 2 * given.get("concurrency", cls.concurrency)))
        return cls(**given)


def csv_set(raw: str) -> tuple[str, ...]:
    """Comma-separated names, trimmed, in lower case, without blanks and repeats."""
    return tuple(dict.fromkeys(x.strip().lower() for x in raw.split(",") if x.strip()))


def truthy(raw: str | None) -> bool:
    return (raw or "").strip().lower() in ("1", "true", "yes", "on")
