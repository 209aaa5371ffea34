"""SQL fragments the queries' SQL shares."""

from crawlmill.config import TRACKING_KEYS

KEYS = "|".join(TRACKING_KEYS)


def canon_sql(u: str) -> str:
    """Canonical form of the tables' addresses; their paths and queries need no encoding."""
    head = f"lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1))"
    path = f"coalesce(nullif(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
    pairs = f"list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]+=.+') and not regexp_matches(lower(x), '^(utm_[^=]*|{KEYS})='))"
    return f"({head} || {path} || case when len({pairs}) > 0 then '?' || array_to_string({pairs}, '&') else '' end)"
