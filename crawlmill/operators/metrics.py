"""Counts and figures that watch the crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions.text import duration


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` most frequent values of ``key``, ties by value."""
    return counts_by(rows, key).orderBy(F.desc("n"), F.col(key).asc_nulls_first()).limit(size)


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"))


def progress(done: Column, total: Column, elapsed_s: Column) -> list[Column]:
    """Share done in percent, rows a second, rows left, seconds to go and these as text."""
    rate = done / F.greatest(elapsed_s, F.lit(1e-9))
    left = F.greatest(total - done, F.lit(0))
    eta = F.when(rate > 0, left / rate).otherwise(F.lit(0.0))
    return [
        F.when(total > 0, done / total * 100.0).otherwise(F.lit(100.0)).alias("pct"),
        rate.alias("rate"), left.alias("remaining"), eta.alias("eta_s"), duration(eta).alias("eta"),
    ]


def watchdog_minutes(batch: Column, concurrency: Column, timeout_s: Column, delay_ms: Column) -> Column:
    """Least minutes without progress before a worker counts as dead."""
    waves = F.greatest(F.lit(1), F.ceil(batch / F.greatest(concurrency, F.lit(1))))
    fetching = waves * (F.greatest(timeout_s, F.lit(1)) + F.greatest(delay_ms / 1000, F.lit(0.0)))
    writing = F.greatest(F.lit(20.0), batch * F.lit(0.03))
    seconds = F.greatest(F.lit(120), F.floor((fetching + writing) * 2.0))
    return F.greatest(F.lit(1), F.ceil(seconds / 60)).cast("int")


def backoff_seconds(attempt: Column, base_s: float = 0.25, most_s: float = 5.0) -> Column:
    return F.least(F.lit(most_s), F.lit(base_s) * F.pow(F.lit(2.0), attempt - 1))
