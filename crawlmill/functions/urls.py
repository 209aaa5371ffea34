"""Addresses: hosts, canonical forms and the filters on them.

``canonical_url`` follows the rules exactly, in Python. ``canonical`` is the
column form: addresses that a regular expression proves to be canonical but for
an empty path never leave the JVM; only the others pass through an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlmill.config import EXCLUDED_DOMAINS, SHARE_PATHS, TRACKING_HOSTS, TRACKING_KEYS

SCHEMES = ("http", "https")
SKIPPED_HREFS = ("#", "mailto:", "javascript:", "tel:")


def _under(host: str, domain: str) -> bool:
    return host == domain or host.endswith("." + domain)


def _unwanted(host: str, path: str, excluded: tuple[str, ...], trackers: tuple[str, ...]) -> bool:
    if host in trackers or any(_under(host, d) for d in excluded):
        return True
    lowered = path.lower()
    return any(_under(host, d) and lowered.startswith(prefix) for d, prefix in SHARE_PATHS)


def canonical_url(
    raw: str | None,
    base: str | None = None,
    excluded: tuple[str, ...] = EXCLUDED_DOMAINS,
    trackers: tuple[str, ...] = TRACKING_HOSTS,
    max_length: int = 1800,
) -> str | None:
    """The canonical form of ``raw`` as found on ``base``; None where it is not to be followed.

    Null and malformed addresses give None.
    """
    if raw is None:
        return None
    try:
        parts = urlsplit(urljoin(base or "", raw).replace("\0", ""))
        host = (parts.hostname or "").lower()
        if parts.scheme not in SCHEMES or _unwanted(host, parts.path, excluded, trackers):
            return None
        if host.endswith("youtube.com") and parts.path == "/redirect":
            inner = next((v for k, v in parse_qsl(parts.query) if k == "q" and v), None)
            if not inner:
                return None
            parts = urlsplit(unquote(inner))
            host = (parts.hostname or "").lower()
            if parts.scheme not in SCHEMES or _unwanted(host, parts.path, excluded, trackers):
                return None
        kept = [
            (k, v)
            for k, v in parse_qsl(parts.query)
            if not k.lower().startswith("utm_") and k.lower() not in TRACKING_KEYS
        ]
        folder, slash, last = (parts.path or "/").rpartition("/")
        path = folder + slash + last.partition(";")[0]
        out = urlunsplit((parts.scheme, parts.netloc.lower(), path, urlencode(kept), ""))
        if parts.netloc == "" and not out.startswith(f"{parts.scheme}://"):
            out = f"{parts.scheme}://{path}" + (f"?{urlencode(kept)}" if kept else "")
    except ValueError:
        return None
    out = out.replace("\0", "")
    return out if out and len(out) <= max_length else None


@F.pandas_udf(T.StringType())
def canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``canonical_url`` of absolute addresses, each distinct one of a batch worked out once."""
    for urls in batches:
        known = {u: canonical_url(u) for u in urls.dropna().unique()}
        yield urls.map(known).astype(object).where(urls.notna(), None)


@F.pandas_udf(T.StringType())
def resolve_udf(raw: pd.Series, base: pd.Series) -> pd.Series:
    """``canonical_url`` of links as found on their page."""
    return pd.Series([canonical_url(r, b) for r, b in zip(raw, base)], dtype=object)


_WORD = r"[A-Za-z0-9._-]+"
#: Lower-case host, plain path, query of plain non-empty pairs: only an empty path is left to fill.
PLAIN_URL = rf"^https?://[a-z0-9.-]+(/[\p{{L}}0-9._~/-]*)?(\?{_WORD}={_WORD}(&{_WORD}={_WORD})*)?$"
_TRACKED = r"(?i)[?&](utm_[^=]*|" + "|".join(map(re.escape, TRACKING_KEYS)) + ")="


def _host_pattern(domains: tuple[str, ...]) -> str:
    return r"^https?://([^/?#]*\.)?(" + "|".join(map(re.escape, domains)) + ")([:/?#]|$)"


def is_plain(url: Column) -> Column:
    """Whether the JVM form of ``canonical`` is exact for ``url``."""
    hosts = (*EXCLUDED_DOMAINS, *TRACKING_HOSTS)
    return (
        url.rlike(PLAIN_URL)
        & ~url.rlike(_TRACKED)
        & ~url.rlike(_host_pattern(hosts))
        & ~url.contains("youtube.com/")
        & (F.length(url) < 1800)
    )


def canonical(url: Column) -> Column:
    """Canonical form of an absolute address; null where there is none."""
    plain = F.coalesce(is_plain(url), F.lit(False))
    with_path = F.regexp_replace(url, r"^(https?://[^/?]+)(\?.*)?$", "$1/$2")
    return F.when(plain, with_path).otherwise(canonical_udf(F.when(~plain, url)))


def host_of(domain: Column) -> Column:
    """A stored domain in lower case, without user info, port and final dot."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.$", "")


def domain_of(url: Column) -> Column:
    """Host of an http(s) address in lower case, without user info, port and the brackets of IPv6.

    Where the host is empty, what stands between scheme and path; '' without a scheme of the two.
    """
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#]*@)?\[?((?<=\[)[^\]/?#]*|[^/:?#]*)", 1))
    return F.when(host != "", host).otherwise(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)))


def seed_domain(url: Column) -> Column:
    """The part between scheme and first slash as it stands: port, user info and case stay."""
    return F.regexp_replace(url, r"^https?://([^/]+).*$", "$1")


def is_excluded(host: Column, domains: tuple[str, ...] = EXCLUDED_DOMAINS) -> Column:
    """Host equal to, or below, one of ``domains``."""
    out = host.isin(*domains)
    for d in domains:
        out = out | host.endswith("." + d)
    return out


def is_tracker(host: Column, hosts: tuple[str, ...] = TRACKING_HOSTS) -> Column:
    return host.isin(*hosts)


def is_share_link(host: Column, path: Column) -> Column:
    """Share links by host suffix and path prefix; the path is lowered, the prefixes are not."""
    out = F.lit(False)
    for d, prefix in SHARE_PATHS:
        out = out | ((host == d) | host.endswith("." + d)) & F.lower(path).startswith(prefix)
    return out


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)


def is_skipped_href(href: Column) -> Column:
    """Empty links, fragments, mail, script and telephone links, by case-sensitive prefix."""
    bare = F.trim(href)
    out = (bare == "") | bare.isNull()
    for prefix in SKIPPED_HREFS:
        out = out | bare.startswith(prefix)
    return out


def fits_queue(url: Column, limit: int = 1800) -> Column:
    return F.length(url) <= limit


def query_pairs(url: Column) -> Column:
    """``array<struct<k,v>>`` of the query in order, repeats kept, blank values dropped; undecoded."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(
        F.split(query, "&"),
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("k"),
            F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("")).alias("v"),
        ),
    )
    return F.filter(pairs, lambda x: x["v"] != "")


def without_tracking(url: Column) -> Column:
    """``url`` without tracking pairs, blank values and fragment; the rest stays as written."""
    kept = F.filter(
        query_pairs(url),
        lambda x: ~F.lower(x["k"]).startswith("utm_") & ~F.lower(x["k"]).isin(*TRACKING_KEYS),
    )
    text = F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.concat(bare, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))
