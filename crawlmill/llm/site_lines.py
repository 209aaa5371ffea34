"""Lines repeated over the documents of one site.

Names, numbers and dates of a line are masked and its words hashed to MinHash bands.
Lines of a host that share a bucket come together, and only those of buckets with
enough documents go on. Texts that are like a leader, by sketches of their masked
words, form clusters, and clusters with enough documents hold the lines that repeat,
with changing names too, as bylines do. Among the texts of such clusters an exact count
of addresses finds repeated lines, texts being equal but for case, white space and
digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.flat import Flat, steps
from crawlmill.llm.lines import with_host
from crawlmill.llm.signs import line_keys, mix
from crawlmill.operators.skew import salted_join, salted_semi_join
from crawlmill.session import cut

LEAST_PAGES = 10
#: Least similarity of a text to its cluster's leader.
SIMILAR = 0.8
#: Keys of removed texts that a scan gets by broadcast at most (16 bytes each); more are joined to the lines.
BROADCAST_KEYS = 2_000_000
TEXT = ["host", "k1", "k2"]


def crowded(lines: DataFrame, band: str, least: int = LEAST_PAGES) -> DataFrame:
    """The lines whose bucket of ``band`` holds lines of at least ``least`` documents (different url) of their host; titles take no part.

    Counts are reduced per bucket and address before anything else moves, so a bucket
    of a third of all pages costs one row per task and address.
    """
    rows = lines.where("line_no > 0")
    by_address = rows.groupBy("host", band, "url_hash").agg(F.count(F.lit(1)).alias("n"))
    buckets = by_address.groupBy("host", band).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))
    return salted_semi_join(rows, buckets.where(F.col("documents") >= least), ["host", band], "n")


def repeated_lines(lines: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(id, line_no) of the lines, as ``line_signs``, whose text stands on at least ``least`` pages (different url) of their host.

    The rows come from ``clusters``: of the texts of each the exact count of addresses
    tells those that repeat as they are from those that repeat with changing names
    only. Equal lines within a page count once. A page without a domain is compared
    with no other. Empty inputs give no row.
    """
    found = clusters(lines, least).where(F.col("pages") >= least).select(*TEXT, "lines").distinct()
    return salted_semi_join(lines.where("line_no > 0").select("id", "line_no", *TEXT), found, TEXT, "lines").select("id", "line_no")


def _alike(a: str, b: str) -> Column:
    """Similarity of two sketches: bins with equal least values, of the bins that either fills; equal parities by chance taken off."""
    both, odd = f"({a}.bins & {b}.bins)", f"({a}.parity ^ {b}.parity)"
    agree, differ = f"bit_count({both} & ~{odd})", f"bit_count({both} & {odd})"
    return F.expr(f"greatest(0, {agree} - {differ}) / greatest(1, bit_count({a}.bins | {b}.bins))")


def clusters(lines: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(host, k1, k2, l1, l2, pages, lines, documents): texts of each cluster with at least ``least`` documents, with their own pages, and the text that leads it.

    In every bucket the text on most pages leads, and texts at least ``SIMILAR`` to it
    join its cluster; so a text may be in a cluster of each band. A text on ``least``
    pages leads a cluster in any case, whatever else its buckets hold. Documents are
    different addresses.
    """
    sketch = ("b0", "b1", "bins", "parity")
    rows = lines.select("url_hash", *TEXT, "line_no", *sketch)
    least_of = [F.min(c).alias(c) for c in sketch]
    dense = crowded(rows, "b0", least).unionByName(crowded(rows, "b1", least)).groupBy(*TEXT).agg(F.count(F.lit(1)).alias("n"), *least_of)
    # such a text counts with all its lines, those too that other case has brought to other buckets
    met = salted_join(rows.where("line_no > 0").select("url_hash", *TEXT), dense, TEXT, "n")
    near = cut(met.groupBy(*TEXT, "url_hash").agg(F.count(F.lit(1)).alias("n"), *least_of))
    texts = cut(near.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("lines"), *least_of))
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("bucket")) for i in (0, 1)])).alias("x")
    member = texts.select(*TEXT, "pages", "lines", F.struct("bins", "parity").alias("own"), bands).select(*TEXT, "pages", "lines", "own", "x.*")
    bucket = ["host", "band", "bucket"]
    lead = F.max_by(F.struct("k1", "k2", "own"), F.struct("pages", "k1", "k2")).alias("lead")
    elected = member.groupBy(*bucket).agg(F.sum("pages").alias("documents"), F.count(F.lit(1)).alias("n"), lead)
    met = salted_join(member, elected.where(F.col("documents") >= least).drop("documents"), bucket, "n").where(_alike("own", "lead.own") >= SIMILAR)
    joined = met.select(*TEXT, F.col("lead.k1").alias("l1"), F.col("lead.k2").alias("l2"), "pages", "lines")
    frequent = texts.where(F.col("pages") >= least).select(*TEXT, F.col("k1").alias("l1"), F.col("k2").alias("l2"), "pages", "lines")
    joined = cut(joined.unionByName(frequent).distinct())
    # addresses of each cluster, each once; a text has at most three leaders
    leads = joined.groupBy(*TEXT).agg(F.first("pages").alias("pages"), F.collect_set(F.struct("l1", "l2")).alias("leads"))
    led = salted_join(near.select(*TEXT, "url_hash"), leads, TEXT, "pages").select("host", "url_hash", F.explode("leads").alias("x"))
    documents = led.select("host", "x.*", "url_hash").distinct().groupBy("host", "l1", "l2").agg(F.count(F.lit(1)).alias("documents"))
    return joined.join(documents.where(F.col("documents") >= least), ["host", "l1", "l2"]).select(*TEXT, "l1", "l2", "pages", "lines", "documents")


def cluster_report(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(host, id, line_no, texts, lines, documents) of each of ``clusters``: a line that shows its leading text, and its size."""
    sizes = found.groupBy("host", "l1", "l2").agg(F.count(F.lit(1)).alias("texts"), F.sum("lines").alias("lines"), F.max("documents").alias("documents"))
    shown = lines.where("line_no > 0").groupBy(*TEXT).agg(F.min(F.struct("id", "line_no")).alias("at"))
    named = sizes.withColumnsRenamed({"l1": "k1", "l2": "k2"}).join(shown, TEXT)
    return named.select("host", "at.id", "at.line_no", "texts", "lines", "documents")


def without_texts(pages: DataFrame, lines: DataFrame, texts: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(id, kept): summaries without the lines whose (host, k1, k2) is in ``texts``; null stays null.

    As long as ``texts`` has at most ``broadcast_keys`` rows their keys go to the scan
    that filters the summaries, which then move nowhere; else line numbers are joined.
    """
    keys = cut(texts.groupBy(*TEXT).agg(F.sum("lines").alias("lines")))
    if keys.count() > broadcast_keys:
        return without_lines(pages, salted_semi_join(lines.select("id", "line_no", *TEXT), keys, TEXT, "lines"))
    rows = keys.select(F.xxhash64("host"), "k1", "k2").toPandas().to_numpy(np.int64).reshape(-1, 3).view(np.uint64)
    first = mix(rows[:, 0], 41) ^ rows[:, 1]
    order = np.argsort(first)
    shared = pages.sparkSession.sparkContext.broadcast((first[order], rows[order, 2]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, second = shared.value
        for batch in batches:
            for part in steps(batch, 2):
                texts = part.column(2).to_pylist()
                flat = Flat(texts)
                k1, k2 = line_keys(flat)
                host = part.column(1).to_numpy().view(np.uint64)[flat.text]
                one = mix(host, 41) ^ k1
                at = np.minimum(np.searchsorted(known, one), max(0, len(known) - 1))
                gone = (known[at] == one) & (second[at] == k2) & (flat.size > 0) if len(known) else np.zeros(flat.n, bool)
                hit = np.bincount(flat.text[gone], minlength=len(texts)) > 0
                start = np.searchsorted(flat.text, np.arange(len(texts)))
                kept = [
                    t if t is None or not hit[i] else "\n".join(x for j, x in enumerate(t.split("\n")) if not gone[start[i] + j]) for i, t in enumerate(texts)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string())], ["id", "kept"])

    return with_host(pages).select("id", F.xxhash64(F.coalesce("host", F.lit("?"))).alias("host"), "summary").mapInArrow(read, "id long, kept string")


def without_lines(pages: DataFrame, dropped: DataFrame, out: str = "kept") -> DataFrame:
    """(id, ``out``): summaries without the lines (id, line_no) of ``dropped``; null stays null."""
    numbers = dropped.groupBy("id").agg(F.collect_set("line_no").alias("_numbers"))
    texts = pages.select("id", "summary").join(numbers, "id", "left")
    left = F.filter(
        F.transform(F.split("summary", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("t"))),
        lambda x: ~F.array_contains(F.col("_numbers"), x["n"]),
    )
    kept = F.array_join(F.transform(left, lambda x: x["t"]), "\n")
    return texts.select("id", F.when(F.col("_numbers").isNull(), F.col("summary")).otherwise(kept).alias(out))
