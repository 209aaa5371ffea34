"""Text expressions of the extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(text: Column) -> Column:
    """Without U+0000; null stays null."""
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def collapsed(text: Column) -> Column:
    """White space runs of any kind made one space, outer ones dropped."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def truncated(text: Column, size: int) -> Column:
    """The first ``size`` code points."""
    return F.substring(text, 1, size)


def embedding_text(summary: Column) -> Column:
    """What the embedder reads for a document."""
    return F.concat(F.lit("search_document: "), summary)


def error_code(error: Column) -> Column:
    """The status of an ``http_<status>`` error; null for others."""
    code = F.regexp_extract(error, "^http_([0-9]+)$", 1)
    return F.when(code != "", code.cast("int"))


def duration(seconds: Column) -> Column:
    """``12.3s`` below a minute, ``2m05s`` from there on; null for null."""
    minutes = F.floor(seconds / 60).cast("long")
    rest = F.floor(seconds % 60).cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).when(seconds >= 60, F.format_string("%dm%02ds", minutes, rest))


def unit(vector: Column) -> Column:
    """The vector at length 1; null for an all-zero vector."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
