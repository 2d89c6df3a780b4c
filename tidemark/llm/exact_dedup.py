"""Exact deduplication over content-defined chunk recipes, with DataFrame functions only.

A text without white space is cut where its own content says so, so equal passages give equal chunks.
Each distinct chunk gets an identifier (its SHA-256); the dictionary of chunks holds each content once
and shows that no identifier stands for two contents. Documents are then compared by their ordered
lists of identifiers, about 3 % of the text, so long documents don't move when groups are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize

#: The characters that don't count: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunk_pattern(least: int, most: int) -> str:
    """A chunk ends, at ``least`` characters or later, after four characters whose code points are 1, 2, 3 and 0
    modulo 4 (Latin-1 letters and signs; about one place in 256), and at ``most`` characters in any case."""

    def kind(r: int) -> str:
        return "[" + "".join(f"\\x{c:02x}" for c in range(0x21, 0x100) if c % 4 == r) + "]"

    end = "".join(kind(r) for r in (1, 2, 3, 0))
    return f"(?s).{{{least},{most - 1}}}?(?<={end})|.{{1,{most}}}"


def chunks(text: Column, least: int = 256, most: int = 4096) -> Column:
    """The ordered chunks of a text; the empty text has none."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def chunk_dictionary(docs: DataFrame, text: str = "text", least: int = 256, most: int = 4096) -> DataFrame:
    """Each distinct chunk once: id binary, chunk string, uses long. Copies within a task meet before the shuffle."""
    pieces = docs.select(F.explode(chunks(normalised(F.col(text)), least, most)).alias("chunk"))
    return pieces.select(F.unhex(F.sha2("chunk", 256)).alias("id"), "chunk").groupBy("id", "chunk").agg(F.count("*").alias("uses"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 256, most: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical without white space; of equal ones, that with the most code points in the
    original, then the smallest id stays. A null text counts as empty; all empty texts form one group. Rows that
    share an id and a text are one document twice: they stay or go together. A null id sorts before all others.
    Other columns of docs are not read, whatever their names. An empty table gives an empty table.

    Should two contents ever share an identifier, the query stops with an error instead of merging them.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("length"), normalised(F.col("text")).alias("norm"))
    recipes = materialize(
        known.select(
            "doc_id",
            "length",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm"), least, most), lambda c: F.unhex(F.sha2(c, 256))).alias("recipe"),
        ),
        "recipes",
    )
    clashes = chunk_dictionary(docs, "text", least, most).groupBy("id").agg(F.count("*").alias("contents")).where("contents > 1")
    groups = recipes.groupBy("recipe").agg(
        F.count("*").alias("group_size"), F.min(F.struct((-F.col("length")).alias("length"), "doc_id")).alias("first")
    )
    # A group may hold a third of all documents, so members find their group by a join that Spark may split, not in a window.
    groups = materialize(groups.select("recipe", "group_size", F.col("first.doc_id").alias("keep_id")), "groups")
    found = recipes.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )
    # The error depends on the count, so no optimizer can look for it before chunks are counted.
    stop = F.when(F.col("contents") > 1, F.raise_error(F.concat(F.lit("contents of the chunk identifier "), F.hex("id"), F.lit(": "), F.col("contents").cast("string"))))
    return found.unionByName(
        clashes.select(
            *(stop.cast(t).alias(c) for c, t in found.dtypes),
        )
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of equal texts one row, that of exact_dedup's order, with all columns. Of rows that share an id and a
    length too, any one; ids that are null or repeat for other texts don't matter."""
    rows = keyed(docs)
    found = exact_dedup(rows.select(F.struct(F.col(doc_id), "_row").alias("id"), F.col(text).alias("text")), "id", "text")
    gone = found.where("not kept").select("doc_id._row")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS kept,
       text_sha256
FROM n
"""
