"""The crawl queue as a table of states: claims, merges, transitions.

Every step takes the queue and gives the new queue. Parquet has no update in
place, so an upsert is an outer join with one expression per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.session import cut

COLUMNS = ("id", "url", "domain", "priority", "depth", "status", "attempts", "needs_js", "queued_at", "last_attempt_at")


def delivered_once(queue: DataFrame) -> DataFrame:
    """The queue without rows delivered twice."""
    return queue.select(*COLUMNS).distinct()


def light(needs_js: str = "needs_js") -> Column:
    return (F.col("status") == "pending") & ~F.coalesce(F.col(needs_js), F.lit(False))


def rendered(needs_js: str = "needs_js") -> Column:
    return (F.col("status") == "pending") & F.coalesce(F.col(needs_js), F.lit(False))


def _turn() -> list[Column]:
    return [F.col("priority").desc_nulls_first(), F.col("queued_at").asc_nulls_last(), F.col("id").asc()]


def claim(queue: DataFrame, size: int, browser: bool = False) -> DataFrame:
    """The next ``size`` pending rows: highest priority (none counts as highest), longest queued, lowest id."""
    return queue.where(rendered() if browser else light()).orderBy(*_turn()).limit(size)


def leased(queue: DataFrame, claimed: DataFrame, batch_ts: Column) -> DataFrame:
    """The queue with the claimed rows processing. A claim has a bounded number of rows."""
    mine = claimed.select("id").withColumn("_mine", F.lit(True))
    joined = queue.join(mine, "id", "left")
    taken = F.col("_mine").isNotNull()
    return joined.select(
        *[
            F.when(taken, F.lit("processing")).otherwise(F.col("status")).alias("status") if c == "status"
            else F.when(taken, batch_ts).otherwise(F.col(c)).alias(c) if c == "last_attempt_at"
            else F.col(c)
            for c in queue.columns
        ]
    )


def by_worker(queue: DataFrame, workers: int, size: int) -> DataFrame:
    """A claim dealt to workers in turn: (id, url, turn, worker). The claim is bounded, so one window may order it."""
    turn = F.row_number().over(Window.orderBy(*_turn()))
    numbered = claim(queue, size).withColumn("turn", turn)
    return numbered.select("id", "url", "turn", ((F.col("turn") - 1) % workers).alias("worker"))


def snapshot(queue: DataFrame, browser: bool = False) -> DataFrame:
    """One row of counts: pending (light only, or all for the browser), pending with scripts, processing."""
    pending = F.col("status") == "pending"
    return queue.agg(
        F.count_if(pending if browser else light()).alias("pending"),
        F.count_if(rendered()).alias("pending_js"),
        F.count_if(F.col("status") == "processing").alias("processing"),
    )


def upserted(queue: DataFrame, incoming: DataFrame, batch_ts: Column, guarded: bool = True) -> DataFrame:
    """The queue after ``incoming`` (url, domain, priority, depth, needs_js), distinct on url.

    New addresses become pending rows with ids after the highest, in order of
    address. Known ones take the higher priority and lesser depth, any needs_js
    and the incoming host, and become pending again; guarded, only pending and
    failed ones do. Unguarded is the reactivation of seeds: depth 0 and the
    seed's priority.
    """
    fresh = incoming.select("url", *[F.col(c).alias(f"_{c}") for c in ("domain", "priority", "depth", "needs_js")]).withColumn("_in", F.lit(True))
    known = queue.withColumn("_old", F.lit(True))
    both = known.join(fresh, "url", "full_outer")
    came, old = F.coalesce("_in", F.lit(False)), F.coalesce("_old", F.lit(False))
    again = came & old & (F.col("status").isin("pending", "failed") if guarded else F.lit(True))
    js = F.coalesce("needs_js", F.lit(False)) | F.coalesce("_needs_js", F.lit(False))
    new = came & ~old

    def pick(renewed: Column, added: Column, column: str) -> Column:
        return F.when(new, added).when(F.coalesce(again, F.lit(False)), renewed).otherwise(F.col(column)).alias(column)

    merged = both.select(
        "id", "url", "_old",
        pick(F.col("_domain") if guarded else F.col("domain"), F.col("_domain"), "domain"),
        pick(F.greatest("priority", "_priority") if guarded else F.col("_priority"), F.col("_priority"), "priority"),
        pick(F.least("depth", "_depth") if guarded else F.lit(0), F.col("_depth"), "depth"),
        pick(F.lit("pending"), F.lit("pending"), "status"),
        pick(F.col("attempts"), F.lit(0), "attempts"),
        pick(js, F.coalesce("_needs_js", F.lit(False)), "needs_js"),
        pick(batch_ts, batch_ts, "queued_at"),
        "last_attempt_at",
    )
    return numbered(merged, "id", "url", "_old").select(*COLUMNS)


def numbered(rows: DataFrame, key: str, order: str, known: str) -> DataFrame:
    """``rows`` with ids for those whose ``known`` is null: highest id + place in order of ``order``.

    New rows are ranged by ``order`` over the tasks and written; a place is the
    place within the range plus the rows of the ranges before, so no task sees
    more than its range.
    """
    is_new = F.col(known).isNull()
    ranged = cut(rows.where(is_new).repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per task
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    new = ranged.withColumn("_within", within).join(offsets, "_range").crossJoin(F.broadcast(top))
    given = new.withColumn(key, (F.col("_top") + F.col("_before") + F.col("_within")).cast("bigint"))
    return rows.where(~is_new).unionByName(given.select(*rows.columns))


def in_chunks(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``chunk``: each group in its order cut into chunks of ``size``.

    Rows are ranged by group and order over the tasks and written; a row's place is
    the one within its range plus the group's rows in the ranges before, so a group
    with a third of all rows is spread over as many tasks as it fills.
    """
    ranged = cut(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))  # of a group a row per task
    offsets = sizes.select(F.col(group).alias("_group"), "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    own = ranged.withColumn("_within", within).join(offsets, ["_range"]).where(F.col(group).eqNullSafe(F.col("_group")))
    chunk = F.floor((F.col("_before") + F.col("_within") - 1) / size).alias("chunk")
    return own.select(*rows.columns, chunk)


def after_results(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after a batch: (item_id, ok, error, needs_js) of processed rows.

    ok makes a row done; no content makes it pending for the browser with one
    more attempt; any other error makes it failed with one more attempt. An
    unknown number of attempts stays unknown.
    """
    r = results.select(F.col("item_id").alias("id"), F.col("ok").alias("_ok"), F.col("error").alias("_error"))
    both = queue.join(r, "id", "left")
    hit = F.col("_ok").isNotNull()
    empty = hit & ~F.col("_ok") & (F.col("_error") == "sem_conteudo")
    status = F.when(~hit, F.col("status")).when(F.col("_ok"), "done").when(empty, "pending").otherwise("failed")
    bumped = F.when(hit & ~F.col("_ok"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    changed = {"status": status, "attempts": bumped, "needs_js": F.when(empty, True).otherwise(F.col("needs_js"))}
    return both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def rolled_back(queue: DataFrame, claimed: DataFrame) -> DataFrame:
    """The queue after a failed batch: claimed rows still processing are pending again."""
    mine = claimed.select("id").withColumn("_mine", F.lit(True))
    back = F.col("_mine").isNotNull() & (F.col("status") == "processing")
    status = F.when(back, "pending").otherwise(F.col("status")).alias("status")
    return queue.join(mine, "id", "left").select(*[status if c == "status" else F.col(c) for c in queue.columns])


def reactivated(queue: DataFrame, seeds: DataFrame, batch_ts: Column) -> DataFrame:
    """The idle queue with all seeds (url, domain, priority) pending again; unchanged while a row is active."""
    active = queue.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("_active"))
    idle = seeds.crossJoin(F.broadcast(active)).where("_active = 0")
    incoming = idle.select(
        "url", "domain", F.coalesce("priority", F.lit(0)).alias("priority"), F.lit(0).alias("depth"), F.lit(False).alias("needs_js")
    ).dropDuplicates(["url"])
    return upserted(queue, incoming, batch_ts, guarded=False)


def reclaimed(queue: DataFrame, older_than: Column, most_attempts: int | None = None) -> DataFrame:
    """Extension: rows left processing since before ``older_than`` are pending again, or failed after ``most_attempts``."""
    stuck = (F.col("status") == "processing") & (F.col("last_attempt_at") < older_than)
    spent = F.lit(False) if most_attempts is None else F.coalesce(F.col("attempts") >= most_attempts, F.lit(False))
    return queue.withColumn("status", F.when(stuck & spent, "failed").when(stuck, "pending").otherwise(F.col("status")))


def classified(attempts: DataFrame) -> DataFrame:
    """(item_id, ok, error, needs_js) of attempts, by the gates in their order.

    ``attempts`` has item_id, blocked, robots_blocked, fetch_error, http_status,
    content_type and summary; the first gate that fails names the error.
    """
    error = (
        F.when(F.coalesce("blocked", F.lit(False)), "dominio_bloqueado")
        .when(F.coalesce("robots_blocked", F.lit(False)), "bloqueado_robots")
        .when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(F.col("http_status") != 200, F.concat(F.lit("http_"), F.col("http_status").cast("string")))
        .when(~F.coalesce(F.col("content_type"), F.lit("")).contains("text/html"), "nao_html")
        .when(F.coalesce("summary", F.lit("")) == "", "sem_conteudo")
    )
    out = attempts.select("item_id", error.alias("error"))
    return out.select("item_id", F.col("error").isNull().alias("ok"), "error", (F.coalesce("error", F.lit("")) == "sem_conteudo").alias("needs_js"))
