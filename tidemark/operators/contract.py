"""Documents that components hand on: unwrapping, validation and edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a value as the output of a failed command, and the keys that must be there.
GARBAGE = ("No outputs found",)
GARBAGE_ANY_CASE = ("warning:", "panic:")
REQUIRED = ("kubeconfig_path", "node_pool_refs", "workload_identity_mechanism", "service_account_annotations")


def unwrapped(outputs: Column) -> Column:
    """name → value, of a map name → struct with value."""
    return F.transform_values(outputs, lambda _, v: v["value"])


def is_garbage(value: Column) -> Column:
    """Whether a text value is empty, coloured terminal output or an error message; false for null, which is no text."""
    found = (value == "") | F.contains(value, F.lit("\x1b["))
    for words in GARBAGE:
        found |= F.contains(value, F.lit(words))
    for words in GARBAGE_ANY_CASE:
        found |= F.contains(F.lower(value), F.lit(words))
    return F.coalesce(found, F.lit(False))


def garbage_keys(docs: DataFrame, key: str = "doc_id", outputs: str = "outputs") -> DataFrame:
    """key, name of each value that is garbage."""
    return docs.select(key, F.explode(outputs).alias("name", "value")).where(is_garbage(F.col("value"))).select(key, "name")


def missing_keys(docs: DataFrame, required: Sequence[str] = REQUIRED, key: str = "doc_id", outputs: str = "outputs") -> DataFrame:
    """key, name of each required key that a document lacks; the first by the order of ``required`` has place 0."""
    absent = F.filter(F.array(*map(F.lit, required)), lambda k: ~F.coalesce(F.map_contains_key(outputs, k), F.lit(False)))
    return docs.select(key, F.posexplode(absent).alias("place", "name"))


def is_json(text: Column) -> Column:
    """Whether a text is there, not empty and one valid JSON value. As the parser stops at the end of a value, what follows
    must show inside something: a value alone goes on to the end of a list and of an object around it, while a text that
    closes the list early can't close the object, and the other way round."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":true}')))
    alone = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "string").isNull() & F.coalesce(F.try_variant_get(named, "$.end", "boolean"), F.lit(False))
    return text.isNotNull() & (F.trim(text) != "") & F.try_parse_json(text).isNotNull() & alone


def pick(items: Column, field: str, value: str) -> Column:
    """The first struct of a list whose field has this value."""
    return F.get(F.filter(items, lambda x: x[field] == value), F.lit(0))


def with_expiry(df: DataFrame, column: str, status: str, expires: Column) -> DataFrame:
    """Sets expirationTimestamp in the nested struct ``status`` of a struct column."""
    return df.withColumn(column, F.col(column).withField(f"{status}.expirationTimestamp", expires))


def without_field(df: DataFrame, column: str, *fields: str) -> DataFrame:
    return df.withColumn(column, F.col(column).dropFields(*fields))


def stuck(items: DataFrame, finalizers: str = "finalizers") -> DataFrame:
    """Rows that still have finalizers; null counts as none."""
    return items.where(F.size(F.coalesce(F.col(finalizers), F.array().cast("array<string>"))) > 0)


def lines_without(df: DataFrame, word: str, column: str = "line") -> DataFrame:
    return df.where(~F.contains(F.col(column), F.lit(word)))


def lines_with(df: DataFrame, word: str, column: str = "line") -> DataFrame:
    """In any case of letters."""
    return df.where(F.contains(F.lower(F.col(column)), F.lit(word.lower())))


def one_of(value: Column, allowed: Sequence[str]) -> Column:
    """The value; the query fails if it is none of these."""
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit("not allowed: "), F.coalesce(value, F.lit("null")))))


#: From which on a host's figure is OK, and from which on it is a WARN.
THRESHOLDS = {"cpu": (8, 4), "ram_mb": (15000, 8000), "disk_gb": (40, 20)}


def graded(measure: str, value: Column) -> Column:
    ok, warn = THRESHOLDS[measure]
    return F.when(value >= ok, "OK").when(value >= warn, "WARN").otherwise("FAIL")
