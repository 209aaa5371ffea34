"""Items of varying length into containers of fixed capacity: bulk-synchronous best fit.

All items and containers act in rounds. A container offers its room as gaps, as
many as hold the longest item left and at least one. A round scans lengths from the
largest down: a gap opens a bracket, an item closes the last one open, which is
its successor, the smallest free gap that holds it. Which bracket a row opens or
closes follows from its nesting level, and levels follow from counts per length
and the row's rank among equal lengths; so brackets are matched all over the
cluster, level by level, and no gap is given twice. Rooms shrink, what was not placed
goes to the next round, and containers are opened when no gap holds any item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.session import cut

CAPACITY = 2_048
#: Rows of one length that are ranked in one window, about.
ROWS_PER_RUN = 50_000
#: Counts that are broadcast at most (24 bytes each); there are 2 x capacity + rows / ROWS_PER_RUN of them.
BROADCAST_ROWS = 200_000
GAP, ITEM = 0, 1
ITEM_KEY = ("doc_id", "piece", "start")


def pieces(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length): items longer than the capacity are cut at its multiples, others whole.

    Items of length null or 0 have no piece.
    """
    last = ((F.col("tokens") - 1) / capacity).cast("int")
    rows = counts.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * capacity
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("tokens") - start, F.lit(capacity)).alias("length"))


def gaps(rooms: DataFrame, longest: int) -> DataFrame:
    """Rows of a round for (container, room): gaps of ``longest`` tokens and a last one of what remains."""
    n = F.greatest(F.lit(1), F.floor(F.col("room") / longest).cast("int"))
    slots = rooms.where("room > 0").withColumn("n", n).select("container", "room", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
    width = F.when(F.col("slot") < F.col("n"), F.lit(longest)).otherwise(F.col("room") - (F.col("n") - 1) * longest)
    return slots.select(F.lit(GAP).alias("kind"), width.cast("int").alias("size"), "container", "slot", *[F.lit(None).cast(t).alias(c) for c, t in zip(ITEM_KEY, ("long", "int", "int"))])


def _as_rows(items: DataFrame) -> DataFrame:
    none = [F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("slot")]
    return items.select(F.lit(ITEM).alias("kind"), F.col("length").alias("size"), *none, *ITEM_KEY)


def _in_runs(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``run``: equal rows in runs of about ``ROWS_PER_RUN``, so a length with a third of all rows is no one task."""
    if n <= ROWS_PER_RUN:
        return rows.withColumn("run", F.lit(0).cast("long"))
    sizes = rows.groupBy("size", "kind").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_RUN)).alias("runs"))
    own = F.xxhash64("container", "slot", "doc_id", "piece")
    # at most 2 x capacity sizes
    return rows.join(F.broadcast(sizes), ["size", "kind"]).withColumn("run", F.pmod(own, F.col("runs"))).drop("runs")


def matched(rows: DataFrame, n: int, capacity: int = CAPACITY) -> DataFrame:
    """The rows of a round with ``given``, the container an item gets, and ``used``, the tokens an item takes of a gap."""
    key = ["size", "kind", "run"]
    in_runs = _in_runs(rows, n)
    counts = in_runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    scan = Window.orderBy(F.desc("size"), "kind", "run")
    signed = F.when(F.col("kind") == GAP, F.col("n")).otherwise(-F.col("n"))
    before = F.coalesce(F.sum(signed).over(scan.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walk = counts.withColumn("sum", before)
    # open brackets before a run: the sum above its lowest point so far, as closing without an open bracket does nothing
    lowest = F.least(F.min("sum").over(scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    nesting = walk.select(*key, (F.col("sum") - lowest).alias("open"))
    if 2 * capacity + n / ROWS_PER_RUN <= BROADCAST_ROWS:
        nesting = F.broadcast(nesting)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("container", "slot", "doc_id", "piece")) - 1
    ranked = in_runs.withColumn("rank", rank).join(nesting, key)
    closes = F.when(F.col("rank") < F.col("open"), F.col("open") - 1 - F.col("rank"))
    # items without an open bracket get levels of their own below zero
    alone = -1 - F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 40))
    level = F.when(F.col("kind") == GAP, F.col("open") + F.col("rank")).otherwise(F.coalesce(closes, alone))

    # on its level an item stands right behind the gap it closes; a level has at most a row per run
    along = Window.partitionBy("level").orderBy(F.desc("size"), "kind", "run")

    def beside(neighbour: Column, own: int, other: int, field: str) -> Column:
        return F.when((F.col("kind") == own) & (neighbour["kind"] == other), neighbour[field])

    pair = F.struct("kind", "container", "size")
    given = beside(F.lag(pair).over(along), ITEM, GAP, "container")
    used = beside(F.lead(pair).over(along), GAP, ITEM, "size")
    return ranked.withColumn("level", level).select(*rows.columns, given.alias("given"), used.alias("used"))


def pack(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, place, length, doc_id, piece, start) of every piece of (doc_id, tokens).

    ``place`` is the first token's place in the container, ``start`` its place in
    the document. Repeated doc_ids are items of their own. No item gives no row.
    A gap of a container is filled with one item a round, so the number of rounds
    follows the spread of lengths; it does not grow with the number of items.
    """
    spark = counts.sparkSession
    items = cut(pieces(counts, capacity))
    rooms = spark.range(0).select(F.col("id").alias("container"), F.lit(0).alias("room"))
    done, opened, before = [], 0, None
    while True:
        left = items.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), F.max("length").alias("longest")).first()
        if not left.n:
            break
        if before in (None, left.n):  # no gap holds an item: as many containers as the tokens fill
            new = -(-left.tokens // capacity)
            fresh = spark.range(opened, opened + new).select(F.col("id").alias("container"), F.lit(capacity).alias("room"))
            rooms, opened = rooms.unionByName(fresh), opened + new
        before = left.n
        rows = _as_rows(items).unionByName(gaps(rooms, left.longest))
        most = left.n + opened * (capacity // left.longest)
        result = cut(matched(rows, most, capacity))
        item = F.col("kind") == ITEM
        done.append(result.where(item & F.col("given").isNotNull()).select(F.col("given").alias("container"), F.col("size").alias("length"), *ITEM_KEY))
        items = result.where(item & F.col("given").isNull()).select(*ITEM_KEY, F.col("size").alias("length"))
        free = F.col("size") - F.coalesce("used", F.lit(0))
        rooms = result.where(~item).groupBy("container").agg(F.sum(free).cast("int").alias("room"))
    if not done:
        return items.select(F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("place"), "length", *ITEM_KEY)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # a container has at most ``capacity`` pieces
    inside = Window.partitionBy("container").orderBy(F.desc("length"), *ITEM_KEY).rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("place")
    return out.select("container", place, "length", *ITEM_KEY)


def faults(counts: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of counts over a packing of ``counts``, all 0 in a right one.

    missing, doubled: pieces that should be there or are there too often, a text
    cut without need among them; overfull: containers with more than ``capacity``
    tokens; overlapping: pieces that reach into the next one of their container.
    """
    key = ["doc_id", "piece", "start", "length"]
    there = packed.select(*key, F.lit(1).alias("d")).unionByName(pieces(counts, capacity).select(*key, F.lit(-1).alias("d")))
    off = there.groupBy(*key).agg(F.sum("d").alias("d")).agg(
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("doubled"),
    )
    along = Window.partitionBy("container").orderBy("place", *key)  # a container has at most ``capacity`` pieces
    over = F.col("place") + F.col("length") > F.lead("place").over(along)
    full = packed.withColumn("over", over).groupBy("container").agg(F.sum("length").alias("tokens"), F.count_if("over").alias("over")).agg(
        F.count_if(F.col("tokens") > capacity).alias("overfull"), F.coalesce(F.sum("over"), F.lit(0)).alias("overlapping")
    )
    return off.crossJoin(full)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, unused, share_used) of a packing; the share is null where there is no container."""
    used = packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    room = F.col("containers") * capacity
    return used.select("containers", "tokens", (room - F.col("tokens")).alias("unused"), F.try_divide("tokens", room).alias("share_used"))
