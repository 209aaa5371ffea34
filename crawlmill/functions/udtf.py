"""Table function form of the link extraction, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from crawlmill.functions.html import parse
from crawlmill.functions.urls import SKIPPED_HREFS, canonical_url


@udtf(returnType="pos int, url string")
class ExtractLinks:
    """Canonical links of a page in document order, each once: ``extract_links(html, base_url)``."""

    def eval(self, html: str, base: str):
        seen = set()
        for pos, href in enumerate((parse(html) or {"links": []})["links"]):
            href = href.strip()
            if not href or href.startswith(SKIPPED_HREFS):
                continue
            url = canonical_url(href, base)
            if url and url not in seen:
                seen.add(url)
                yield pos, url


def register(spark: SparkSession) -> None:
    """Makes the functions of this library callable from SQL."""
    from crawlmill.functions.html import parse_html
    from crawlmill.functions.urls import canonical_udf, resolve_udf

    spark.udtf.register("extract_links", ExtractLinks)
    spark.udf.register("canonical_url", canonical_udf)
    spark.udf.register("resolve_url", resolve_udf)
    spark.udf.register("parse_html", parse_html)
