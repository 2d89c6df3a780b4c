"""How fragmented a table's partitions are, and which files to rewrite together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MB = 1 << 20


def health(files: DataFrame) -> DataFrame:
    """Of files (partition, path, rows, bytes): counts and sizes by partition."""
    return files.groupBy("partition").agg(
        F.count("*").alias("file_count"),
        F.sum("rows").alias("row_count"),
        F.sum("bytes").alias("bytes"),
        F.min("bytes").alias("min_bytes"),
        F.max("bytes").alias("max_bytes"),
        F.avg("bytes").alias("avg_bytes"),
        F.percentile("bytes", 0.5).alias("median_bytes"),
    )


def scored(health: DataFrame, target: int = 128 * MB, least_files: int = 2, threshold: float = 0.5) -> DataFrame:
    """Adds ideal_files (as many files of ``target`` bytes as hold the partition), score (the share of files too many) and
    eligible."""
    ideal = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(target))).cast("bigint")
    out = health.withColumn("ideal_files", ideal).withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("ideal_files") / F.col("file_count")))
    return out.withColumn("eligible", (F.col("file_count") >= least_files) & (F.col("score") >= threshold))


def worst(scored: DataFrame, n: int) -> DataFrame:
    """The n eligible partitions of highest score, ties by name."""
    return scored.where("eligible").orderBy(F.desc("score"), F.desc("file_count"), "partition").limit(n)


def bins(files: DataFrame, target: int) -> DataFrame:
    """Adds bin: files of a partition in the order of their paths, cut where their sizes pass multiples of target."""
    before = Window.partitionBy("partition").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("bin", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / F.lit(target)).cast("bigint"))


def latest(df: DataFrame, n: int, time: str, tie: str) -> DataFrame:
    """The n newest rows, oldest of them first."""
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n).orderBy(time, tie)


def allowed(df: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Rows on an allow-list."""
    return df.join(names.select(column).distinct(), column, "left_semi")


def only_partitions(df: DataFrame, column: str, partitions: Sequence) -> DataFrame:
    """Rows of these partitions: a literal list, so that other partitions aren't listed or read."""
    return df.where(F.col(column).isin(*partitions)) if partitions else df.where("false")


def costs(runs: DataFrame) -> DataFrame:
    """By table: runs, files and bytes rewritten, seconds, from a log of runs."""
    return runs.groupBy("table").agg(
        F.count("*").alias("runs"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.round(F.sum("seconds"), 6).alias("seconds")
    )
