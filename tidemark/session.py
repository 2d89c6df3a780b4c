"""Sessions with the settings that the library relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC throughout; adaptive plans size and split partitions; each partition that is read stays well within a task's memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


#: Paths that scratch() gave, deleted when the process ends.
_given: list[tuple[SparkSession, str]] = []


def session(name: str = "tidemark", master: str | None = None, warehouse: str | None = None, **more: str) -> SparkSession:
    """A session; master and further settings only where they are given, as a cluster sets its own."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, as spark.checkpoint.dir names it; what is there goes when the
    process ends. A session that names no folder gets a local one if it runs on this machine alone, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _given:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended already
            return
