import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlmill.config import CrawlConfig, csv_set, truthy
from crawlmill.functions import urls

BASE = "https://site.example.com/a/b?x=1#f"
GOLDEN = [
    ("../c", "https://site.example.com/c"),
    ("?p=2", "https://site.example.com/a/b?p=2"),
    ("//CDN.Example.ORG", "https://cdn.example.org/"),
    ("HTTP://Ex.COM:8080/P;v=1/Q;w?b=2&a=1&a=3#z", "http://ex.com:8080/P;v=1/Q?b=2&a=1&a=3"),
    ("/p?utm_source=x&UTM_Medium=y&id=7", "https://site.example.com/p?id=7"),
    ("/p?GCLID=1&ref=x", "https://site.example.com/p?ref=x"),
    ("/p?empty=&flag&k=v", "https://site.example.com/p?k=v"),
    ("/p?q=a%20b~c*", "https://site.example.com/p?q=a+b~c%2A"),
    ("/p/", "https://site.example.com/p/"),
    ("/á b", "https://site.example.com/á b"),
    ("http://u:P@H.com/", "http://u:p@h.com/"),
    ("http:///nohost", "http:///nohost"),
    ("https://m.facebook.com/z", None),
    ("https://notfacebook.com/z", "https://notfacebook.com/z"),
    ("https://www.youtube.com/redirect?q=https%3A%2F%2Fok.example", None),
    ("https://notyoutube.com/redirect?q=https%3A%2F%2Fok.example%2Fx%3Futm_id%3D1", "https://ok.example/x"),
    ("https://notyoutube.com/redirect?q=", None),
    ("https://ad.doubleclick.net/c", None),
    ("https://www.linkedin.com/shareArticle?x", None),
    ("ftp://h/x", None),
    ("data:text/plain,x", None),
    ("https://h.com/" + "a" * 1800, None),
    ("http://[bad/x", None),
    (None, None),
]


@pytest.mark.parametrize("raw,expected", GOLDEN)
def test_canonical_golden(raw, expected):
    assert urls.canonical_url(raw, BASE) == expected


def test_dead_share_prefix():
    assert urls.canonical_url("https://www.linkedin.com/shareArticle?x=1", None, excluded=()) == "https://www.linkedin.com/shareArticle?x=1"


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,8}\.(com|example)(/[A-Za-z0-9;._~ é%*-]{0,12}){0,3}(\?[a-z]{1,4}=[A-Za-z0-9%+&=*]{0,8})?(#x)?", fullmatch=True))
def test_canonical_is_idempotent(url):
    once = urls.canonical_url(url)
    assert once is None or urls.canonical_url(once) == once


def test_column_form_equals_exact_form(spark):
    raw = [u for u, _ in GOLDEN] + [
        "https://h.example", "https://h.example?a=1", "https://h.example/x?a=1&b=2", "https://h.example/x?a=1#f", "https://H.example/x",
        "https://h.example/x;p", "https://h.example/x?utm_x=1", "https://h.example/x?a=", "https://h.example/seção/a", "https://x.com/a", "", " ",
    ]
    rows = spark.createDataFrame([(u,) for u in raw], "u string").select("u", urls.canonical(F.col("u")).alias("c")).collect()
    assert [r.c for r in rows] == [urls.canonical_url(u) for u in raw]


def test_host_of(spark):
    cases = [("WWW.A.Example:443", "www.a.example"), ("u:p@A.example", "a.example"), ("a.example.", "a.example"), ("x@A.example.:80", "a.example"), (None, None), ("", "")]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "d string").select(urls.host_of(F.col("d")).alias("h")).collect()
    assert [r.h for r in rows] == [b for _, b in cases]


def test_domain_of(spark):
    cases = [
        ("HTTPS://u:p@A.Example:8/x", "a.example"), ("http://[2001:DB8::1]:80/", "2001:db8::1"), ("http://[::1]", "::1"), ("http://:81/x", ":81"),
        ("http://u@/x", "u@"), ("http://a@b@h.example?q=@z", "h.example"), ("ftp://h/x", ""), ("http://", ""), ("", ""), (None, None),
    ]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "u string").select(urls.domain_of(F.col("u")).alias("h")).collect()
    assert [r.h for r in rows] == [b for _, b in cases]


def test_filters(spark):
    row = spark.range(1).select(
        urls.is_excluded(F.lit("m.x.com")).alias("a"),
        urls.is_excluded(F.lit("max.com")).alias("b"),
        urls.is_tracker(F.lit("ad.doubleclick.net")).alias("c"),
        urls.is_share_link(F.lit("www.twitter.com"), F.lit("/Intent/post")).alias("d"),
        urls.is_share_link(F.lit("linkedin.com"), F.lit("/shareArticle")).alias("e"),
        urls.is_skipped_href(F.lit("  #x")).alias("f"),
        urls.is_skipped_href(F.lit("JavaScript:x")).alias("g"),
        urls.seed_domain(F.lit("https://U@H.com:8/x")).alias("h"),
        urls.without_tracking(F.lit("https://h/p?a=1&utm_x=2&b=&a=3#f")).alias("i"),
    ).first()
    assert tuple(row) == (True, False, True, True, False, True, False, "U@H.com:8", "https://h/p?a=1&a=3")


def test_settings():
    assert csv_set(" A.com, b.com ,,a.com") == ("a.com", "b.com")
    assert truthy(" Yes ") and not truthy("no") and not truthy(None)
    assert CrawlConfig.from_env({"MAX_DEPTH": "5", "EXCLUDED_DOMAINS": "q.com"}) == CrawlConfig(max_depth=5, excluded_domains=("q.com",))
