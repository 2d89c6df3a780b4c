"""What is known about files, objects and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fragment(df: DataFrame, path: str, files: int, partition: str) -> None:
    """Writes a table that is fragmented on purpose: up to ``files`` files in each partition."""
    df.repartition(files).write.mode("append").partitionBy(partition).parquet(path)


def files(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """partition, path, rows, bytes of each data file of a table. Only the partition column and metadata are read."""
    table = spark.read.parquet(path).select(F.col(partition).cast("string").alias("partition"), "_metadata.file_path", "_metadata.file_size")
    return table.groupBy("partition", F.col("file_path").alias("path")).agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))


def objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """key, bytes, modified of the stored objects whose key starts with prefix; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    key = F.substring_index("path", root, -1) if len(root) > 1 else F.col("path")
    return found.select(key.alias("key"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(F.startswith("key", F.lit(prefix)))


def stat(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The size of one object: no row if there is none."""
    return objects(spark, path).where(F.col("key") == key).select("key", "bytes")


def tenants(names: DataFrame, template: str = "_template") -> DataFrame:
    """One row: the tenants' names, sorted, without the template, as a JSON list."""
    kept = names.where(F.col("name") != template)
    return kept.agg(F.to_json(F.sort_array(F.collect_list("name"))).alias("tenants"))


def document(spark: SparkSession, path: str) -> DataFrame:
    """One row: a JSON document's text."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))


def write_document(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def prefix(branch: str, warehouse: Column | str) -> Column:
    """The catalog's address of a warehouse on a branch, encoded once; to encode it again is an error."""
    return F.url_encode(F.concat_ws("|", F.lit(branch), warehouse if isinstance(warehouse, Column) else F.lit(warehouse)))


def catalog_config(warehouses: DataFrame, branch: str = "main") -> DataFrame:
    """warehouse, config: what a catalog answers to a request for its settings."""
    inner = F.struct(prefix(branch, F.col("name")).alias("prefix"))
    return warehouses.select(F.col("name").alias("warehouse"), F.to_json(F.struct(inner.alias("defaults"))).alias("config"))


def default_prefix(config: DataFrame) -> DataFrame:
    return config.select("warehouse", F.get_json_object("config", "$['defaults']['prefix']").alias("prefix"))


def namespaces(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW SCHEMAS").toDF("namespace")


def snapshots(tables: DataFrame) -> DataFrame:
    """The snapshots of table documents (table, document): their totals as numbers, and whether one wrote no manifest."""
    kind = "struct<snapshots: array<struct<`snapshot-id`: bigint, `manifest-list`: string, summary: map<string, string>>>>"
    each = tables.select("table", F.explode(F.from_json("document", kind)["snapshots"]).alias("s"))
    total = lambda k: F.try_element_at("s.summary", F.lit(k)).cast("bigint")
    return each.select(
        "table",
        F.col("s.snapshot-id").alias("snapshot_id"),
        F.col("s.manifest-list").alias("manifest_list"),
        total("total-records").alias("total_records"),
        total("total-data-files").alias("total_data_files"),
        total("manifests-created").alias("manifests_created"),
        F.coalesce(total("manifests-created") == 0, F.lit(False)).alias("without_data"),
    )


def models(manifest: DataFrame) -> DataFrame:
    """unique_id, name, schema, compaction of a transformation tool's manifest (document)."""
    kind = "struct<nodes: map<string, struct<name: string, schema: string, meta: struct<compaction: boolean>>>>"
    each = manifest.select(F.explode(F.from_json("document", kind)["nodes"]).alias("unique_id", "node"))
    return each.select("unique_id", "node.name", "node.schema", F.coalesce("node.meta.compaction", F.lit(False)).alias("compaction"))


def run_results(results: DataFrame) -> DataFrame:
    """unique_id, status of the tool's last run (document)."""
    kind = "struct<results: array<struct<unique_id: string, status: string>>>"
    return results.select(F.inline(F.from_json("document", kind)["results"]))
