"""Per-key results when a few keys hold most rows: eager aggregation through joins.

Both inputs are reduced to one state per join key before they meet. The join
then moves one row per key and side, however many rows a key has, and results
over the joined rows follow algebraically: the joined count is the product of
the counts, a joined sum is the sum of one side times the count of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def key_states(df: DataFrame, raw: str, key: Column, prefix: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One state per ``key``: ``<prefix>_rows`` and a ``<prefix>_<name>`` sum for each of ``sums``.

    Rows are first reduced by the raw column, in the scan stage, so ``key`` is
    worked out once per distinct raw value. Null keys form no state; nulls in a
    sum count as nothing.
    """
    sums = sums or {}
    first = df.groupBy(F.col(raw).alias("_raw")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()]
    )
    return (
        first.withColumn("key", key)
        .where("key is not null")
        .groupBy("key")
        .agg(
            F.sum("_n").alias(f"{prefix}_rows"),
            *[F.coalesce(F.sum(f"_s_{k}"), F.lit(0)).cast("bigint").alias(f"{prefix}_{k}") for k in sums],
        )
    )


def join_states(left: DataFrame, right: DataFrame, how: str = "full") -> DataFrame:
    """States of both sides by key; a side without the key has zeros."""
    joined = left.join(right, "key", how)
    return joined.select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "key"])


def joined_results(states: DataFrame, left: str, right: str) -> DataFrame:
    """Adds what an inner join of the original rows would give per key.

    ``pairs`` is its number of rows; every ``<side>_<name>`` sum gets a
    ``joined_<side>_<name>``. Held as decimals, as products pass 64 bits.
    """
    out = states.withColumn("pairs", F.col(f"{left}_rows").cast(WIDE) * F.col(f"{right}_rows"))
    for side, other in ((left, right), (right, left)):
        for c in states.columns:
            if c.startswith(f"{side}_") and c != f"{side}_rows":
                out = out.withColumn(f"joined_{c}", F.col(c).cast(WIDE) * F.col(f"{other}_rows"))
    return out


def rank_by_count(states: DataFrame, count: str, rank: str = "rank") -> DataFrame:
    """Rank of each key by ``count``, equal counts sharing a rank, without sorting all keys in one task.

    Ranks come from the histogram of counts. With R rows in all it has at most
    sqrt(2R) values, about 1.4 million for 10^12 rows, so its running sum may be
    taken in one task.
    """
    from pyspark.sql import Window

    histogram = states.groupBy(count).agg(F.count(F.lit(1)).alias("_keys"))
    above = Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = histogram.select(count, (F.coalesce(F.sum("_keys").over(above), F.lit(0)) + 1).cast("bigint").alias(rank))
    return states.join(ranks, count)


def heavy_keys(states: DataFrame, counts: dict[str, str], totals: DataFrame, share: float) -> DataFrame:
    """(table_name, key) of keys with at least ``share`` of a table's rows.

    ``counts`` maps table names to count columns of ``states``; ``totals`` is one
    row with the same columns over all rows, null keys included. An empty table
    has no heavy key.
    """
    both = states.crossJoin(F.broadcast(totals.select(*[F.col(c).alias(f"_t_{c}") for c in counts.values()])))
    tables = F.array(
        *[
            F.struct(F.lit(t).alias("table_name"), F.col(c).alias("n"), F.col(f"_t_{c}").alias("total"))
            for t, c in counts.items()
        ]
    )
    return (
        both.select("key", F.explode(tables).alias("x"))
        .where((F.col("x.n") > 0) & (F.col("x.n") >= F.lit(share) * F.col("x.total")))
        .select(F.col("x.table_name").alias("table_name"), F.col("key"))
    )
