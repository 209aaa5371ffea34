"""Lines of page summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions.urls import host_of

_OTHER = r"\t\r\f\u000b\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space within a line, no-break and other typographic spaces included; a lone space is left alone.
SPACES = rf" [ {_OTHER}]+|[{_OTHER}][ {_OTHER}]*"


def squeezed(text: Column) -> Column:
    """``text`` with runs of white space within lines made one space."""
    return F.regexp_replace(text, SPACES, " ")


def folded(line: Column) -> Column:
    """A line without differences of case, white space and digit runs."""
    lower = F.replace(F.lower(F.trim(squeezed(line))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(lower, "[0-9]+", "0")


def summary_lines(pages: DataFrame, *keep: str | Column) -> DataFrame:
    """(id, *keep, line_no, line) of non-blank lines; numbers start at 1 and count blank lines too."""
    lines = F.split("summary", "\n")
    return (
        pages.where(F.col("summary").isNotNull())
        .select("id", *keep, F.posexplode(lines).alias("line_no", "line"))
        .where(F.trim(squeezed(F.col("line"))) != "")
        .withColumn("line_no", F.col("line_no") + 1)
    )


def with_host(pages: DataFrame) -> DataFrame:
    """``domain`` made a host; a page without one is a host of its own address, so it matches no other."""
    return pages.withColumn("host", F.coalesce(host_of(F.col("domain")), F.concat(F.lit("?"), F.col("url"))))
