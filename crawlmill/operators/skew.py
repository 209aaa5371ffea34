"""Joins whose big side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.session import cut

#: A key is hot from this many rows on, and is then cut into parts of about so many rows.
ROWS_PER_PART = 100_000
#: The list of hot keys that is broadcast has at most so many rows, whatever the input.
MOST_HOT_KEYS = 10_000


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``rows`` with a partner in ``keys`` and its other columns; ``keys`` is distinct on ``on`` and ``count`` holds its rows in ``rows``.

    Hot keys are split over ceil(count / part) salts on both sides. A part has at
    least ``rows_per_part`` rows and at least a ``MOST_HOT_KEYS``-th of all
    matching rows, so at most ``MOST_HOT_KEYS`` keys are hot and their list can be
    broadcast. Null keys match nothing.
    """
    keys = cut(keys)  # they are read for their total, for the hot ones and for the join
    total = keys.agg(F.sum(count)).first()[0] or 0
    part = max(rows_per_part, -(-total // MOST_HOT_KEYS))
    if total <= part:  # no key can be hot
        return rows.join(keys, on)
    parts = F.greatest(F.ceil(F.col(count) / F.lit(part)).cast("int"), F.lit(1))
    sized = keys.withColumn("_parts", parts)
    hot = F.broadcast(sized.where("_parts > 1").select(*on, "_parts"))
    # by the row's hash, not at random: a task that runs again must deal its rows in the same way
    dealt = F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))
    salted = rows.join(hot, on, "left").withColumn("_salt", F.coalesce(dealt, F.lit(0)).cast("int")).drop("_parts")
    spread = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return salted.join(spread, [*on, "_salt"]).drop("_salt")


def salted_semi_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``rows`` with a partner in ``keys``, as ``salted_join``; columns and their order stay."""
    keyed = keys.select(*on, F.col(count).alias("_count"))
    return salted_join(rows, keyed, on, "_count", rows_per_part).select(*rows.columns)
