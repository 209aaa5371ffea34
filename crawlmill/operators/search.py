"""Extensions over vectors, terms, links and events that the tables allow."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.functions.text import dot, unit
from crawlmill.session import cut


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """The ``k`` vectors nearest to one query vector, exactly; ties by key. One pass, a top-k per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("embedding")
    if metric == "cosine":
        norm = math.sqrt(sum(x * x for x in query)) or 1.0
        score = dot(unit(v), q) / F.lit(norm)
    elif metric == "inner":
        score = dot(v, q)
    else:
        gaps = F.zip_with(v, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
        score = -F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))
    fit = vectors.where((F.size(v) == len(query)) & F.forall(v, lambda x: x.isNotNull()))
    return fit.select(key, score.alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def term_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): lower-case words of letters and digits."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    return docs.select(key, F.explode(words).alias("term")).where("term <> ''").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, terms: list[str], k: int, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` documents that fit ``terms`` best, ties by key.

    Only the query's terms are exploded; lengths are counted in place.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    wanted = F.array(*[F.lit(t) for t in terms])
    sized = docs.where(F.col(text).isNotNull()).select(key, F.size(words).alias("length"), F.filter(words, lambda w: F.array_contains(wanted, w)).alias("hits"))
    corpus = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    tf = sized.where(F.size("hits") > 0).select(key, "length", F.explode("hits").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most one row per query term
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.groupBy(key).agg(F.sum(idf * weight).alias("score")).orderBy(F.desc("score"), key).limit(k)


def degrees(links: DataFrame) -> DataFrame:
    """(url, in_degree, out_degree) over distinct edges; counts reduce before they meet."""
    edges = links.select("source_url", "target_url").distinct()
    out = edges.groupBy(F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("target_url").alias("url")).agg(F.count(F.lit(1)).alias("in_degree"))
    return into.join(out, "url", "full_outer").select(
        "url", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree")
    )


def pagerank(links: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(url, rank) after ``rounds`` rounds from rank 1; pages without links pass nothing on.

    A round is one join on the source and one partial sum by target, so a target
    of a tenth of all links costs one row per task. Ranks are written each round.
    """
    edges = links.select("source_url", "target_url").distinct()
    out = edges.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"))
    edges = cut(edges.join(out, "source_url"))
    nodes = cut(edges.select(F.col("source_url").alias("url")).union(edges.select("target_url")).distinct())
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        given = edges.join(ranks, edges["source_url"] == ranks["url"]).groupBy("target_url").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        ranks = cut(
            nodes.join(given, nodes["url"] == given["target_url"], "left").select(
                "url", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank")
            )
        )
    return ranks


def sessions(events: DataFrame, gap_seconds: int = 1800, span_seconds: int = 3600) -> DataFrame:
    """(user_id, session, started, ended, n): runs of a user's events with no longer gap.

    Events first become runs within spans of time, then the runs of a user are
    strung together, so a user with a third of all events is one task per span and
    few rows after it. Events without a time take no part.
    """
    micros = 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = events.where("ts is not null").select("user_id", "event_id", "ts", at.alias("_at"), F.floor(at / F.lit(span_seconds * micros)).alias("_span"))
    within = Window.partitionBy("user_id", "_span").orderBy("_at", "event_id")
    new = F.coalesce((F.col("_at") - F.lag("_at").over(within) > gap_seconds * micros).cast("int"), F.lit(0))
    marked = timed.withColumn("_new", new).withColumn("_run", F.sum("_new").over(within))
    runs = marked.groupBy("user_id", "_span", "_run").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("n")
    )
    along = Window.partitionBy("user_id").orderBy("_span", "_run")
    apart = F.coalesce((F.col("_first") - F.lag("_last").over(along) > gap_seconds * micros).cast("int"), F.lit(1))
    strung = runs.withColumn("_apart", apart).withColumn("session", F.sum("_apart").over(along))
    return strung.groupBy("user_id", "session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n"))
