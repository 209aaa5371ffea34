"""Titles, text blocks and links of HTML pages.

``parse_html`` is an Arrow UDF over the standard library's parser: a page is
parsed once into a struct, all that follows are column expressions on it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlmill.config import BLOCK_TAGS, NOISE_TAGS, CrawlConfig
from crawlmill.functions.text import collapsed, sanitized, truncated

# Void tags; tags whose opening closes an open paragraph with the inline
# tags in it; tags kept at the top level, below which everything is kept.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CLOSES_P = (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "div", "main", "article", "nav", "footer", "aside",
    "header", "section", "table",
)
KEPT = (
    "title", "meta", "main", "article", "div", "a", "h1", "h2", "h3", "p", "li", "nav", "footer", "aside", "header",
)

SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("links", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: "Node | None" = None
    children: list = field(default_factory=list)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def texts(self):
        for c in self.children:
            if isinstance(c, str):
                if c.strip():
                    yield c.strip()
            elif c.tag not in ("script", "style"):
                yield from c.texts()

    @property
    def noisy(self) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in NOISE_TAGS:
                return True
            node = node.parent
        return False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in within:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close("p", ("div", "article", "main", "nav", "footer", "aside", "header", "td", "li"))
        if tag == "li":
            self._close("li", ("ul", "ol"))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.at

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _kept(root: Node) -> list[Node]:
    """The topmost kept tags of the document."""
    out = []
    for c in root.children:
        if isinstance(c, Node):
            out += [c] if c.tag in KEPT else _kept(c)
    return out


def _roots(nodes: list[Node]) -> list[Node]:
    def chosen(test):
        return [n for n in nodes if test(n)]

    found = (
        chosen(lambda n: n.tag == "main")
        + chosen(lambda n: n.tag == "article")
        + chosen(lambda n: n.tag == "div" and n.attrs.get("id") == "content")
        + chosen(lambda n: n.tag == "div" and n.attrs.get("role") == "main")
    )
    return list({id(n): n for n in found}.values())


def parse(html: str | None) -> dict | None:
    """Title, meta texts, candidate blocks in order, and hrefs in document order; None for a null page."""
    if html is None:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = [n for top in _kept(tree.root) for n in (top, *top.walk())]
    title = next((n for n in nodes if n.tag == "title"), None)
    single = title is not None and len(title.children) == 1 and isinstance(title.children[0], str)
    meta: dict[str, str] = {}
    for n in nodes:
        if n.tag == "meta":
            meta.setdefault(n.attrs.get("property") or n.attrs.get("name") or "", n.attrs.get("content", ""))
    roots = _roots(nodes)
    scopes = [list(r.walk()) for r in roots] or [nodes]
    blocks = [{"tag": n.tag, "text": " ".join(n.texts())} for scope in scopes for n in scope if n.tag in BLOCK_TAGS and not n.noisy]

    def hrefs(scope):
        return [n.attrs["href"] for n in scope if n.tag == "a" and "href" in n.attrs and not n.noisy]

    links = [h for scope in scopes for h in hrefs(scope)] or hrefs(nodes)
    meta.pop("", None)
    return {"title": title.children[0].strip() if single else None, "meta": meta, "blocks": blocks, "links": list(dict.fromkeys(links))}


@F.pandas_udf(SCHEMA)
def parse_html(pages: pd.Series) -> pd.DataFrame:
    rows = [parse(x) or {} for x in pages]
    return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in ("title", "meta", "blocks", "links")})


def summary_of(parsed: Column, config: CrawlConfig = CrawlConfig(), rendered: bool = False) -> Column:
    """Text of the blocks that are long enough, each text once, joined and cut; null if nothing is left.

    Rendered pages count collapsed text, others the text as it stands.
    """
    blocks = F.transform(
        parsed["blocks"],
        lambda b: F.struct(b["tag"].alias("tag"), (collapsed(sanitized(b["text"])) if rendered else sanitized(b["text"])).alias("text")),
    )
    least = lambda b: F.when(b["tag"].startswith("h"), config.min_heading).otherwise(config.min_text)
    long = F.filter(blocks, lambda b: F.length(b["text"]) >= least(b))
    text = collapsed(F.array_join(F.array_distinct(F.transform(long, lambda b: b["text"])), " "))
    cut = truncated(text, config.summary_rendered if rendered else config.summary_light)
    return F.when(cut != "", cut)


def title_of(parsed: Column, rendered: bool = False) -> Column:
    """The title; rendered pages fall back on og:title, or on twitter:title where there is no og:title tag."""
    title = sanitized(parsed["title"])
    if not rendered:
        return title
    meta = parsed["meta"]
    og = F.when(F.map_contains_key(meta, "og:title"), meta["og:title"]).otherwise(meta["twitter:title"])
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.when(F.trim(og) != "", F.trim(og)))


def rendered_summary(parsed: Column, body_text: Column, config: CrawlConfig = CrawlConfig()) -> Column:
    """Blocks, else a description tag, else the rendered text."""
    meta = parsed["meta"]
    described = F.coalesce(meta["description"], meta["og:description"])
    fallback = [truncated(collapsed(sanitized(x)), config.summary_rendered) for x in (described, body_text)]
    return F.coalesce(summary_of(parsed, config, True), *[F.when(x != "", x) for x in fallback])
