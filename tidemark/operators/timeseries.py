"""Counters and gauges (M10, F3, W1, G3, G4): samples are (metric, labels map, ts, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def selected(samples: DataFrame, metric: str, **labels: str) -> DataFrame:
    found = samples.where(F.col("metric") == metric)
    for k, v in labels.items():
        found = found.where(F.try_element_at("labels", F.lit(k)) == v)
    return found


def within(samples: DataFrame, at: str, seconds: int) -> DataFrame:
    """Samples of the trailing range that ends at a time and leaves its beginning out."""
    end = F.lit(at).cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    return samples.where((ts <= end) & (ts > end - F.expr(f"INTERVAL {int(seconds)} SECONDS")))


def increase(samples: DataFrame, series: Sequence[str], at: str, seconds: int) -> DataFrame:
    """series…, increase of counters over the range. A value below the one before is a reset: the counter began at 0.

    Differences are taken inside the range, so the first sample there adds none; a series with fewer than two samples
    has no row. Nothing is extrapolated to the range's edges.
    """
    w = Window.partitionBy(*series).orderBy("ts")
    inside = within(samples, at, seconds).withColumn("before", F.lag("value").over(w))
    step = F.when(F.col("value") < F.col("before"), F.col("value")).otherwise(F.col("value") - F.col("before"))
    return inside.groupBy(*series).agg(F.sum(step).alias("increase"), F.count("*").alias("samples")).where("samples >= 2").drop("samples")


def rate(samples: DataFrame, series: Sequence[str], at: str, seconds: int) -> DataFrame:
    """series…, rate per second."""
    return increase(samples, series, at, seconds).select(*series, (F.col("increase") / float(seconds)).alias("rate"))


def rate_range(samples: DataFrame, series: Sequence[str], start: str, end: str, step: int, seconds: int) -> DataFrame:
    """series…, tick, rate: rate() at each of the times from start to end that are ``step`` seconds apart, as a panel shows it.

    The step from one sample to the next counts at all times whose range holds both, so each sample is looked at once,
    after one shuffle by series, however far the ranges overlap. A series has no row at times whose range holds fewer than
    two of its samples.
    """
    first, last = (F.unix_micros(F.lit(x).cast("timestamp_ntz").cast("timestamp")) for x in (start, end))
    ts, width, reach = F.unix_micros(F.col("ts").cast("timestamp")), F.lit(step * 1_000_000), F.lit(seconds * 1_000_000)
    w = Window.partitionBy(*series).orderBy("ts")
    known = samples.withColumns({"_ts": ts, "_ts_before": F.lag(ts).over(w), "_before": F.lag("value").over(w)})
    known = known.where(F.col("_ts_before").isNotNull() & (F.col("_ts") <= last) & (F.col("_ts_before") + reach > first))
    # Times at _ts or later, whose range began before the sample before.
    low = F.greatest(F.lit(0), F.ceil((F.col("_ts") - first) / width)).cast("long")
    high = F.least(F.floor((last - first) / width), F.ceil((F.col("_ts_before") + reach - first) / width) - 1).cast("long")
    grown = F.when(F.col("value") < F.col("_before"), F.col("value")).otherwise(F.col("value") - F.col("_before"))
    each = known.withColumns({"_low": low, "_high": high, "_grown": grown}).where("_low <= _high")
    each = each.select(*series, "_grown", F.explode(F.sequence("_low", "_high")).alias("_k"))
    tick = F.timestamp_micros(first + F.col("_k") * width).cast("timestamp_ntz")
    return each.groupBy(*series, "_k").agg(F.sum("_grown").alias("_sum")).select(*series, tick.alias("tick"), (F.col("_sum") / float(seconds)).alias("rate"))


def rate_sum_by(samples: DataFrame, series: Sequence[str], by: str, at: str, seconds: int) -> DataFrame:
    return rate(samples, series, at, seconds).groupBy(by).agg(F.sum("rate").alias("rate"))


def gauge_sum_by(samples: DataFrame, series: Sequence[str], by: str, at: str, lookback: int) -> DataFrame:
    """by, value: the sum over series of the last sample within the look-back; of samples at one time the largest counts."""
    last = within(samples, at, lookback).groupBy(*series).agg(F.max(F.struct("ts", "value")).alias("x"))
    return last.select(*series, F.col("x.value").alias("value")).groupBy(by).agg(F.sum("value").alias("value"))
