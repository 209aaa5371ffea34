"""Template residue, filler, error pages and script notices in titles and summaries.

Nothing here knows a phrase. A page is silent if no line of its body informs: every
sentence in it, with function words, stands on several addresses. Responses given in
place of content leave pages silent, while menus and notices stand beside content on
nearly all of their pages; so the share of silent pages among those that open a line
in the same way tells responses, as soon as it is sure for their number and comes from
more than one host, or is far above what is usual on the one. What has terms in common
with the page's slug and title needs more evidence, a page that the crawler noted to
need scripts less. Placeholders are told by their marks, filler by its lack of
function words or by the same few words over and over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.signs import FILLER, PLACEHOLDER, RELATED, SENTENCE
from crawlmill.operators.skew import salted_join, salted_semi_join
from crawlmill.session import cut

#: Addresses from which on a sentence is a notice or response and informs no more.
REPEATED = 3
#: Least silent share of an opening, at the lower end of its 95 % interval; more is asked where terms are related, less where scripts are needed.
LEAST_SHARE, RELATED_MORE, SCRIPTS_LESS = 0.5, 0.3, 0.1
#: An opening of one host needs so many pages, and a silent share so much above the host's.
ONE_HOST_PAGES, ONE_HOST_MORE = 10, 0.3


def _has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(flag) != 0


def sure_share(k: Column, n: Column) -> Column:
    """Lower end of Wilson's 95 % interval of k in n."""
    z2 = 1.96**2
    return (k + z2 / 2 - 1.96 * F.sqrt(k * (n - k) / n + z2 / 4)) / (n + z2)


def page_states(lines: DataFrame) -> DataFrame:
    """(id, host, url_hash, body, silent, placeholder, filler) of pages with a line; ``body`` if one is not the title."""
    sentences = lines.where(_has(SENTENCE) & ~_has(FILLER) & (F.col("line_no") > 0)).select("id", "body", "url_hash")
    by_address = sentences.groupBy("body", "url_hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = by_address.groupBy("body").agg(F.count(F.lit(1)).alias("addresses"), F.sum("n").alias("n"))
    again = salted_semi_join(sentences, repeated.where(F.col("addresses") >= REPEATED), ["body"], "n")
    known = again.groupBy("id").agg(F.count(F.lit(1)).alias("known"))
    told = _has(SENTENCE) & ~_has(FILLER) & (F.col("line_no") > 0)
    pages = lines.groupBy("id").agg(
        F.min("host").alias("host"),
        F.min("url_hash").alias("url_hash"),
        (F.max("line_no") > 0).alias("body"),
        F.sum(told.cast("int")).alias("sentences"),
        F.max(_has(PLACEHOLDER)).alias("placeholder"),
        F.max(_has(FILLER)).alias("filler"),
    )
    silent = F.col("sentences") == F.coalesce("known", F.lit(0))
    return pages.join(known, "id", "left").withColumn("silent", silent).drop("sentences", "known")


def responses(lines: DataFrame, quiet: DataFrame, states: DataFrame) -> DataFrame:
    """(opening, n, share): how sure the silent share of an opening is, of those that are more than usual.

    ``quiet`` holds the lines of silent pages that have a body.
    """
    seen = quiet.groupBy("opening").agg(
        F.count(F.lit(1)).alias("k"), F.min("host").alias("host"), (F.min("host") != F.max("host")).alias("hosts")
    )
    total = lines.groupBy("opening").agg(F.count(F.lit(1)).alias("n"))
    # lines of pages without a body are titles and prove nothing
    rated = seen.join(total, "opening").withColumn("share", sure_share(F.col("k"), F.greatest("n", "k")))
    rated = rated.where(F.col("share") >= LEAST_SHARE - SCRIPTS_LESS)
    usual = states.where("body").groupBy("host").agg(F.avg(F.col("silent").cast("int")).alias("usual"))
    single = rated.where(~F.col("hosts") & (F.col("n") >= ONE_HOST_PAGES)).join(usual, "host")
    single = single.where(F.col("share") - F.col("usual") >= ONE_HOST_MORE)
    return rated.where("hosts").select("opening", "k", "share").unionByName(single.select("opening", "k", "share"))


def evidence(lines: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """(id, kind, score) for each kind of evidence against a page, from ``line_signs``.

    ``placeholder`` and ``filler`` score 1; the score of ``response`` is the surest
    silent share of its lines. A placeholder counts in a title or beside content too,
    the others only on silent pages. Null and blank texts are no residue; empty
    tables give no row.
    """
    states = cut(page_states(lines))
    quiet = states.where("silent")
    marked = states.where("placeholder").select("id", F.lit("placeholder").alias("kind"), F.lit(1.0).alias("score"))
    filled = quiet.where("filler").select("id", F.lit("filler").alias("kind"), F.lit(1.0).alias("score"))

    own = cut(lines.select("id", "host", "opening", "line_no", "flags").join(quiet.select("id", "body", "url_hash"), "id"))
    rated = responses(lines.where("line_no > 0").unionByName(_titles(lines, states)), own.where("body"), states)
    said = salted_join(own.select("id", "line_no", "flags", "opening"), rated, ["opening"], "k").withColumn("related", _has(RELATED))
    title = F.max(F.when(F.col("line_no") == 0, F.col("share")))
    apart = F.max(F.when((F.col("line_no") > 0) & ~F.col("related"), F.col("share")))
    near = F.max(F.when((F.col("line_no") > 0) & F.col("related"), F.col("share")))
    pages = said.groupBy("id").agg(*[F.coalesce(x, F.lit(0.0)).alias(n) for x, n in ((title, "title"), (apart, "apart"), (near, "near"))])
    if queue is None:
        least = F.lit(LEAST_SHARE)
    else:
        addresses = quiet.groupBy("url_hash").agg(F.count(F.lit(1)).alias("n"))
        wanted = queue.where("needs_js").select(F.xxhash64("url").alias("url_hash")).distinct()
        scripts = salted_semi_join(quiet.select("id", "url_hash"), addresses.join(wanted, "url_hash", "left_semi"), ["url_hash"], "n")
        pages = pages.join(scripts.select("id", F.lit(SCRIPTS_LESS).alias("less")), "id", "left")
        least = F.lit(LEAST_SHARE) - F.coalesce("less", F.lit(0.0))
    # where the title itself is a response, terms in common with it speak for no content
    related = F.when(F.col("title") >= least, F.col("near")).otherwise(F.col("near") - RELATED_MORE)
    score = F.greatest("title", "apart", related)
    flagged = pages.where(score >= least).select("id", F.lit("response").alias("kind"), score.alias("score"))
    return marked.unionByName(filled).unionByName(flagged)


def _titles(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Titles of the pages that have a body."""
    return lines.where("line_no = 0").join(states.where("body").select("id"), "id", "left_semi")


def residue_pages(lines: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Ids of the pages with residue, each once."""
    return evidence(lines, queue).select("id").distinct()


def without_residue(rows: DataFrame, residue: DataFrame) -> DataFrame:
    """``rows``, which have a page's id, without those of pages with residue; ``rows`` should be narrow, not carry texts.

    The ids are written first, so that their measured size decides how the anti-join runs.
    """
    return rows.join(cut(residue), "id", "left_anti")
