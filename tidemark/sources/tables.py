"""Lake tables: schemas, Parquet tables, appended rows, listings and counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The events table: ids and payloads are text, times have no zone.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("occurred_at", T.TimestampNTZType()),
        T.StructField("payload", T.StringType()),
    ]
)
SHARED_ORDERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("shared_with", T.ArrayType(T.StringType(), False), False),
        T.StructField("payload", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def tenant_schema(tenant_id: str) -> str:
    """The private schema of a tenant in a pooled database."""
    if not re.fullmatch(r"[a-z0-9-]+", tenant_id):
        raise ValueError(f"not a tenant id: {tenant_id!r}")
    return "tenant_" + tenant_id.replace("-", "_")


def create_schema(spark: SparkSession, name: str) -> None:
    """Creates a schema; nothing happens if it is there."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(name)}")


def create_tenant_schema(spark: SparkSession, tenant_id: str, tries: int = 3) -> str:
    """The private schema, made with up to ``tries`` tries."""
    name = tenant_schema(tenant_id)
    for left in reversed(range(tries)):
        try:
            create_schema(spark, name)
            return name
        except Exception:
            if not left:
                raise
    return name


def create_table(spark: SparkSession, schema: str, table: str, columns: T.StructType, partitioned_by: Sequence[str] = ()) -> None:
    """Creates a Parquet table; one that is there stays as it is, whatever its columns."""
    body = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in columns)
    parts = f" PARTITIONED BY ({', '.join(map(quoted, partitioned_by))})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(schema, table)} ({body}) USING PARQUET{parts}")


def literal_rows(spark: SparkSession, rows: Sequence[tuple], columns: T.StructType) -> DataFrame:
    """Rows given in place, by position."""
    return spark.createDataFrame(list(rows), columns)


def append(df: DataFrame, schema: str, table: str) -> None:
    """Appends by position; doing so again appends again."""
    df.write.insertInto(quoted(schema, table))


def with_defaults(df: DataFrame) -> DataFrame:
    """shared_orders rows with what is missing filled in: a new id, shared with nobody, now."""
    defaults = {"id": F.expr("uuid()"), "shared_with": F.array().cast("array<string>"), "created_at": F.current_timestamp()}
    return df.select(*(F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults and c in df.columns else defaults[c].alias(c) if c in defaults else F.col(c) for c in SHARED_ORDERS.names))


def list_tables(spark: SparkSession, schema: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {quoted(schema)}").select(F.col("tableName").alias("table_name"))


def row_count(df: DataFrame) -> DataFrame:
    """One row with row_count; 0 for an empty table, which differs from no table at all."""
    return df.agg(F.count("*").alias("row_count"))


def copy_in(spark: SparkSession, path: str, schema: str, table: str, kind: str = "parquet", **options: str) -> None:
    """Appends staged files of any format that Spark reads to a table with the same columns."""
    append(spark.read.format(kind).schema(spark.table(quoted(schema, table)).schema).options(**options).load(path), schema, table)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A remote table, read in parts by ranges of a numeric key. The driver's jar has to be on the class path."""
    bounds = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()


def log(df: DataFrame, path: str) -> None:
    """Adds rows to an audit log."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
