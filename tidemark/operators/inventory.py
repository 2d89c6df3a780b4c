"""Comparisons of what a catalog refers to with what storage holds, and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import tables


def drift(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """path, status of each path (path, bytes) on either side: ok, missing (not stored), size_mismatch or orphan (not
    referred to). One pass over both by a union and an aggregation, whatever their sizes and however skewed."""
    both = catalog.select("path", F.col("bytes").alias("want"), F.lit(None).cast("bigint").alias("have")).unionByName(
        stored.select("path", F.lit(None).cast("bigint").alias("want"), F.col("bytes").alias("have"))
    )
    each = both.groupBy("path").agg(F.max("want").alias("want"), F.max("have").alias("have"))
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "orphan").when(F.col("want") != F.col("have"), "size_mismatch").otherwise("ok")
    return each.select("path", status.alias("status"))


def missing(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    return catalog.join(stored, "path", "left_anti").select("path")


def looked_up(table: Column, key: Column, default: Column) -> Column:
    """The key's value in a map, or the default."""
    return F.coalesce(F.try_element_at(table, key), default)


def others(names: DataFrame, taken: DataFrame, column: str = "name") -> DataFrame:
    return names.join(taken, column, "left_anti")


def to_compact(models: DataFrame, results: DataFrame, health: DataFrame) -> DataFrame:
    """Health rows (table, …) of the opted-in models that the last run built."""
    built = models.where("compaction").join(results.where("status = 'success'"), "unique_id")
    return health.join(built.select("unique_id", F.concat_ws(".", "schema", "name").alias("table")), "table")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often: exact, independent of order, and one shuffle of both, as equal
    rows are counted against each other before and after it."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    names = [tables.quoted(c) for c in a.columns]
    sign = "_" + max(a.columns, key=len, default="")  # no column's name is as long
    signed = a.select(*names, F.lit(1).alias(sign)).unionByName(b.select(*names, F.lit(-1).alias(sign)))
    return signed.groupBy(*names).agg(F.sum(tables.quoted(sign)).alias(sign)).where(F.col(tables.quoted(sign)) != 0).isEmpty()
