"""From transformation runs to compaction plans: opt-in, allow-list, presets, quota, locks, audit."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import health, inventory
from tidemark.sources import metadata, tables

from .versioned import VersionedTable


@dataclass(frozen=True)
class Preset:
    target: int = 128 * health.MB
    least_files: int = 2
    threshold: float = 0.5
    partitions: int = 100  #: of a table in a run
    quota_bytes: int = 100 << 30  #: of a run


PRESETS = {"gentle": Preset(threshold=0.8, partitions=10), "default": Preset(), "thorough": Preset(threshold=0.1, partitions=10_000)}


def plan(manifest: DataFrame, results: DataFrame, health_rows: DataFrame, allowed: DataFrame | None = None, preset: Preset = PRESETS["default"]) -> DataFrame:
    """table, partition, score, bytes, place: what to rewrite, the most fragmented first, within the preset's limits.

    health_rows: table and the columns of health(). Only models that opted in, were built and are on the allow-list, if one is given.
    """
    rows = inventory.to_compact(metadata.models(manifest), metadata.run_results(results), health_rows)
    if allowed is not None:
        rows = health.allowed(rows, allowed, "table")
    rows = health.scored(rows, preset.target, preset.least_files, preset.threshold).where("eligible")
    place = F.row_number().over(Window.partitionBy("table").orderBy(F.desc("score"), F.desc("file_count"), "partition"))
    rows = rows.withColumn("place", place).where(F.col("place") <= preset.partitions)
    before = F.sum("bytes").over(Window.partitionBy("table").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("so_far", before).where(F.col("so_far") <= preset.quota_bytes).select("table", "partition", "score", "bytes", "place")


@contextmanager
def only_one(spark: SparkSession, root: str):
    """Holds a table's lock: a second holder fails at once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/lock")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(path, False).close()
    try:
        yield
    finally:
        fs.delete(path, False)


def run(table: VersionedTable, name: str, audit: str, preset: Preset = PRESETS["default"], dry: bool = False, only: Sequence[str] | None = None) -> dict:
    """Compacts one table, or some partitions of it, under its lock and logs what was done; a dry run only logs the plan's size."""
    settings = dict(target=preset.target, n=preset.partitions, least_files=preset.least_files, threshold=preset.threshold, only=only)
    with only_one(table.spark, table.root):
        if dry:
            found = table.plan(**settings).agg(F.count("*").alias("files"), F.countDistinct("partition").alias("partitions")).first()
            out = {"before": table.head(), "after": table.head(), "partitions": found.partitions, "files_rewritten": 0, "files_planned": found.files}
        else:
            out = table.compact(**settings) | {"files_planned": 0}
    row = (uuid.uuid4().hex, name, "dry-run" if dry else "compact", out["before"], out["after"], out["partitions"], out["files_rewritten"])
    kind = "run_id string, table string, operation string, before string, after string, partitions long, files_rewritten long"
    tables.log(table.spark.createDataFrame([row], kind), audit)
    return out


def advise(
    lake: Mapping[str, VersionedTable],
    manifest: DataFrame,
    results: DataFrame,
    audit: str,
    allowed: DataFrame | None = None,
    preset: Preset = PRESETS["default"],
    dry: bool = False,
) -> dict[str, dict]:
    """From the last run of transformations to compacted tables: plan() over the health of all tables of the lake, then
    run() on the partitions that it names. By table, what run() tells; tables that the plan leaves out aren't touched.

    What reaches the driver are names of partitions, at most ``preset.partitions`` of a table.
    """
    if not lake:
        return {}
    rows = functools.reduce(DataFrame.unionByName, (t.health().withColumn("table", F.lit(name)) for name, t in lake.items()))
    chosen: dict[str, list[str]] = {}
    for r in plan(manifest, results, rows, allowed, preset).orderBy("table", "place").collect():
        chosen.setdefault(r.table, []).append(r.partition)
    return {name: run(lake[name], name, audit, preset, dry, partitions) for name, partitions in chosen.items()}
