"""Row and path security of tenants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def owner_or_shared(tenant: str | None) -> Column:
    """Whether a row belongs to the tenant or is shared with it. Without a tenant this is null, so no row passes."""
    who = F.lit(tenant).cast("string")
    return (F.col("tenant_id") == who) | F.array_contains("shared_with", who)


def visible_to(df: DataFrame, tenant: str | None) -> DataFrame:
    return df.where(owner_or_shared(tenant))


#: Predicates by name. A table's property names its policy, so that every session that reads the table knows of it.
PREDICATES: dict[str, Callable[[str | None], Column]] = {"owner_or_shared": owner_or_shared}
PROPERTY = "tidemark.row_policy"


def policy_of(spark: SparkSession, table: str) -> str | None:
    """The name of a table's policy, None where row security was never enabled."""
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == PROPERTY).collect()
    return found[0]["value"] if found else None


def create_policy(table: str, predicate: Callable[[str | None], Column] = owner_or_shared) -> None:
    """Enables row security on a table; attaching a second policy is an error, as in SQL."""
    spark = SparkSession.active()
    if policy_of(spark, table) is not None:
        raise ValueError(f"{table} has a policy already")
    PREDICATES[predicate.__name__] = predicate
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PROPERTY}' = '{predicate.__name__}')")


def read_as(spark: SparkSession, table: str, tenant: str | None) -> DataFrame:
    """A table as a tenant sees it; all of it where no policy was attached, no row where this session doesn't know the policy."""
    df, name = spark.table(table), policy_of(spark, table)
    if name is None:
        return df
    return df.where(PREDICATES[name](tenant)) if name in PREDICATES else df.where(F.lit(False))


def checked_for(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows that the tenant may write; the query fails on a row that it could not read afterwards, whatever columns of it
    are asked for, as the check is a condition on rows."""
    deny = F.raise_error(F.lit("row violates the table's policy")).cast("boolean")
    return df.where(F.when(F.coalesce(owner_or_shared(tenant), F.lit(False)), F.lit(True)).otherwise(deny))


def set_tenant(spark: SparkSession, tenant: str | None) -> None:
    """Sets the session's tenant variable."""
    spark.sql("DECLARE OR REPLACE VARIABLE app_tenant_id STRING DEFAULT NULL")
    if tenant is not None:
        spark.sql("SET VAR app_tenant_id = :t", {"t": tenant})


def visible_in_session(df: DataFrame) -> DataFrame:
    """What the session's tenant sees; no rows where none was set to a value."""
    return df.where("tenant_id = session.app_tenant_id OR array_contains(shared_with, session.app_tenant_id)")


def under_prefix(path: Column, tenant: Column | str) -> Column:
    """Whether an object key is the tenant's. The slash counts: tenant-a does not reach tenant-ab."""
    return F.startswith(path, F.concat(F.lit(tenant) if isinstance(tenant, str) else tenant, F.lit("/")))
