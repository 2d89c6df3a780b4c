"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(items: Column) -> Column:
    """A list without nulls and empty texts."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def joined_lines(items: Column) -> Column:
    return F.array_join(compact(items), "\n")


def mapped(keys: Column, value) -> Column:
    """A map from each key to value(key)."""
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k, value(k))))


def to_base64_json(value: Column) -> Column:
    return F.base64(F.to_json(value).cast("binary"))


def underscored(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def without_scheme(url: Column) -> Column:
    return F.replace(url, F.lit("https://"), F.lit(""))


def expires(at: Column, seconds: int = 30) -> Column:
    """A time some seconds later, as ISO 8601 in UTC."""
    return F.date_format(at + F.expr(f"INTERVAL {int(seconds)} SECONDS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def kb_to_mb(kb: Column) -> Column:
    return F.floor(kb / F.lit(1024)).cast("bigint")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def short_name(base: str = "task") -> Column:
    return F.concat(F.lit(base + "-"), F.substring(F.expr("uuid()"), 1, 8))


def exit_code(statuses: Column, name: str) -> Column:
    """The exit code of the named container among statuses (name, state.terminated.exitCode); -1 where there is none."""
    return F.coalesce(F.get(F.filter(statuses, lambda s: s["name"] == name), F.lit(0))["state"]["terminated"]["exitCode"], F.lit(-1))
