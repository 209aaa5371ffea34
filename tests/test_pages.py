import pytest
from pyspark.sql import functions as F

from crawlmill.functions import html, robots, text

ROBOTS = [
    (None, "/x", False),
    ("", "/x", False),
    ("User-agent: *\nDisallow: /en/", "/en/1", True),
    ("User-agent: *\nDisallow: /en/", "", False),
    ("User-agent: *\nDisallow: /", "", False),
    ("User-agent: *\nDisallow: /", "/", True),
    ("User-agent: *\nUser-agent: other\nDisallow: /", "/x", False),
    ("User-agent: other\nUser-agent: *\nDisallow: /", "/x", True),
    ("User-agent: googlebot\nDisallow: /", "/x", False),
    ("User-agent: Googlebot\r\nDisallow: /fr/\r\nAllow: /fr/ok", "/fr/ok", True),
    ("USER-AGENT: *\nDISALLOW: /a", "/abc", True),
    ("User-agent: *\nDisallow: /a # note", "/a", False),
    ("User-agent: *\nDisallow: /*.pdf", "/x.pdf", False),
    ("User-agent: *\nDisallow:", "/x", False),
    ("Disallow: /", "/x", False),
]


def test_robots_golden(spark):
    rows = spark.createDataFrame(ROBOTS, "t string, p string, want boolean")
    got = rows.select(robots.robots_blocked(F.col("t"), F.col("p")).alias("b")).collect()
    assert [r.b for r in got] == [w for *_, w in ROBOTS]


L30, L29 = "x" * 30, "x" * 29
HTML = [
    ("<main><h1>Short</h1></main>", None),
    ("<main><h2>Titles</h2></main>", "Titles"),
    (f"<main><p>{L29}</p><p>{L30}</p></main>", L30),
    (f"<header><main><p>{L30}</p></main></header>", None),
    (f"<main><p>a{L30}</p><article><p>{L30}</p></article></main>", f"a{L30} {L30}"),
    (f"<article><p>A{L30}</p></article><main><p>B{L30}</p></main>", f"B{L30} A{L30}"),
    (f"<main><li><p>{L30}</p></li></main>", L30),
    (f"<main><p><b>{L30}<br><p>y{L30}", f"{L30} y{L30}"),
    ("", None),
]


@pytest.mark.parametrize("rendered", [False, True])
def test_summaries(spark, rendered):
    rows = spark.createDataFrame([(h,) for h, _ in HTML], "h string").select(html.parse_html("h").alias("p"))
    got = rows.select(html.summary_of(F.col("p"), rendered=rendered).alias("s")).collect()
    assert [r.s for r in got] == [w for _, w in HTML]


def test_rendered_counts_collapsed_text(spark):
    page = spark.createDataFrame([("<main><p>" + "x " * 14 + "\n\n\n</p><p>" + "x\n \n" * 8 + "</p></main>",)], "h string")
    parsed = page.select(html.parse_html("h").alias("p"))
    assert parsed.select(html.summary_of(F.col("p"), rendered=True).alias("s")).first().s is None


def test_titles_and_fallbacks(spark):
    pages = [
        ("<title> A </title>", "A", "A"),
        ("<meta property='og:title' content=''><meta name='twitter:title' content='T'>", None, None),
        ("<meta name='twitter:title' content='T'>", None, "T"),
        ("<title></title><meta property='og:title' content='O'>", None, "O"),
    ]
    rows = spark.createDataFrame([(h,) for h, *_ in pages], "h string").select(html.parse_html("h").alias("p"))
    got = rows.select(html.title_of(F.col("p")).alias("a"), html.title_of(F.col("p"), True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in pages]
    d = spark.createDataFrame([("<meta name='description' content=' d  e '>", "body"), ("<p>x", " the \n body ")], "h string, t string")
    rows = d.select(html.rendered_summary(html.parse_html("h"), F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == ["d e", "the body"]


def test_links():
    page = "<main><p>x</p></main><nav><a href='/n'>n</a></nav><div><a href='/a'>a</a><a href='/a'>a</a><a>no</a></div>"
    assert html.parse(page)["links"] == ["/a"]
    assert html.parse("<main><a href='/in'>x</a></main><div><a href='/out'>y</a></div>")["links"] == ["/in"]
    assert html.parse("<nav><a href='/n'>n</a></nav>")["links"] == []
    assert html.parse(None) is None


def test_texts(spark):
    row = spark.range(1).select(
        text.sanitized(F.lit("a\0b")).alias("a"),
        text.collapsed(F.lit(" a \t b　\x1cc ")).alias("b"),
        text.truncated(F.lit("😀é1"), 2).alias("c"),
        text.error_code(F.lit("http_404")).alias("d"),
        text.error_code(F.lit("timeout")).alias("e"),
        text.duration(F.lit(59.94)).alias("f"),
        text.duration(F.lit(125.0)).alias("g"),
        text.unit(F.array(F.lit(0.0))).alias("h"),
    ).first()
    assert tuple(row) == ("ab", "a b c", "😀é", 404, None, "59.9s", "2m05s", None)
