"""Removal of long repeated passages by de Bruijn compaction.

A window of ``width`` words is an edge of a de Bruijn graph, from its first words to its last. Consecutive windows of
a document that share the smallest hashed k-mer inside them form a path: equal windows have equal smallest k-mers, so
all that can be equal meets under one key, and one row stands for a whole path. Paths whose k-mer is there once hold
nothing that repeats. Of the others, equal paths compact into one node by joins: all their windows repeat. Where
different paths share a k-mer, that is, where the graph branches, one path of each kind is taken apart, from the text
at its source coordinates, into single windows that are compared by themselves.

What is taken for equal is looked up in the text at its source coordinates: a second hash, under another key and from
the bytes on, must agree too. Windows are compared by both; should the second differ within a node, the query stops
with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import discard, materialize

def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    more = width - have
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def paths(buffer: np.ndarray, at: np.ndarray, width: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Of a block: row, key (smallest k-mer), hash, first word in its text, windows, whether a window is in it twice."""
    start, end = hashing.words(buffer)
    h, first = hashing.word_hashes(buffer, start, end), hashing.by_row(at, start)
    count = np.maximum(0, np.diff(first) - width + 1)
    total = int(count.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, bool),)
    row = np.repeat(np.arange(len(count)), count)
    window = first[row] + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    least = sliding_min(hashing.rolling(h, kmer), width - kmer + 1)[window]
    begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.append(begin, total))
    word = window[begin]
    run = np.repeat(np.arange(len(begin)), n)
    own = hashing.rolling(h, width)[window]
    inside = own ^ hashing.mix(run.astype(hashing.U))
    order = np.argsort(inside)
    twice = np.zeros(len(begin), bool)
    twice[run[order[1:][inside[order[1:]] == inside[order[:-1]]]]] = True
    whole = hashing.sums(own, begin)
    return row[begin], least[begin].view(np.int64), whole.view(np.int64), word - first[row[begin]], n, twice


def proofs(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hash of each path of n windows from word at on, of a text whose windows have the hashes h."""
    begin = np.cumsum(n) - n
    window = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(begin, n)
    return hashing.sums(h[window], begin, hashing.SECOND).view(np.int64)


def covered(n_words: int, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which words the windows cover, of paths of n windows from word at on."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, width: int = 35, kmer: int = 6, doc_id: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the words left, joined by single spaces.

    Words are runs of characters other than space and U+0009 to U+000D. Each word goes that a window covers whose words
    also start anywhere else, in the same document too. A null text has no words; texts of fewer words than a window
    lose none. Rows are documents: of rows that are there twice, all windows repeat. Ids may be null or repeat. Other
    columns are not read; an empty table gives an empty table.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    # Rows that share an id are told apart by a hash of the text, which costs room, so only where there are such rows.
    shared_ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).collect()
    docs = docs.withColumn("salt", F.xxhash64("text") if shared_ids else F.lit(0).cast("long"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buffer, at in hashing.blocks(batch.column(1)):
                row, key, whole, word, n, twice = paths(buffer, at, width, kmer)
                pick = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(2).take(pick), pa.array(key), pa.array(whole), pa.array(word.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)],
                    ["doc_id", "salt", "key", "whole", "at", "n", "twice"],
                )

    found = materialize(docs.select("doc_id", "text", "salt").mapInArrow(scan, "doc_id long, salt long, key long, whole long, at int, n int, twice boolean"), "paths")
    keys = materialize(found.groupBy("key").agg(F.count("*").alias("paths"), F.max("twice").alias("twice")).where("paths > 1 OR twice").select("key"), "keys")
    repeated = materialize(found.join(keys, "key"), "repeated")
    discard(found, keys)
    nodes = repeated.groupBy("key", "whole", "n").agg(
        F.count("*").alias("uses"), F.max("twice").alias("twice"), F.min(F.struct("doc_id", "salt", "at")).alias("source")
    )
    nodes = materialize(nodes, "nodes")
    branching = nodes.groupBy("key").agg(F.count("*").alias("nodes"), F.sum((F.col("uses") == 1).cast("long")).alias("single"), F.max("twice").alias("twice"))
    branching = materialize(branching.where("nodes > 1 AND single > 0 OR twice").select("key"), "branching")
    same = repeated.join(nodes.where("uses > 1").select("key", "whole", "n"), ["key", "whole", "n"])
    none = F.lit(None).cast("long")
    # A branching path that is there once still has to be settled; one that is there more often only serves to compare.
    settled = (F.col("uses") > 1).alias("settled")
    spans = same.select("doc_id", "salt", "at", "n", none.alias("key"), F.lit(True).alias("settled"), F.xxhash64("key", "whole", "n").alias("path")).unionByName(
        nodes.join(branching, "key").select("source.doc_id", "source.salt", "source.at", "n", "key", settled, none.alias("path"))
    )
    # As many spans as a document has paths, at most; those of rows that are there twice are equal and count once.
    spans = spans.groupBy("doc_id", "salt").agg(F.collect_set(F.struct("at", "n", "key", "settled", "path")).alias("spans"))
    here = docs["doc_id"].eqNullSafe(spans["doc_id"]) & (docs["salt"] == spans["salt"])
    met = docs.join(spans, here, "left").select(docs["doc_id"], docs["salt"], docs["text"], spans["spans"])

    span_type = "array<struct<at: int, n: int>>"
    result = "doc_id long, salt long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def finish(text: str, gone: np.ndarray | None) -> tuple:
        words = text.encode("utf-8", "surrogatepass").split()
        some = gone is not None and gone.any()
        kept = b" ".join([words[i] for i in np.flatnonzero(~gone)] if some else words)
        return len(words), int(gone.sum()) if some else 0, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if kept_text else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without branching paths to settle are done; others go on with their text. Windows of all branching paths go on."""
        for batch in batches:
            done, pending, windows, proven = [], [], [], []
            for body, spans in zip(batch.column(2), batch.column(3), strict=True):
                body, spans = body.as_py(), spans.as_py() or []
                edges, whole = [s for s in spans if s["key"] is not None], [s for s in spans if s["key"] is None]
                windows.append(None)
                proven.append(None)
                if spans:
                    data = np.frombuffer(body.encode("utf-8", "surrogatepass"), np.uint8)
                    place = hashing.words(data)
                    check = hashing.rolling(hashing.word_hashes(data, *place, hashing.SECOND), width, hashing.SECOND)
                if edges:
                    h = hashing.rolling(hashing.word_hashes(data, *place), width).view(np.int64)
                    again = check.view(np.int64)
                    windows[-1] = [{"key": s["key"], "at": s["at"] + i, "window": int(h[s["at"] + i]), "check": int(again[s["at"] + i])} for s in edges for i in range(s["n"])]
                if whole:
                    proof = proofs(check, *(np.array([s[k] for s in whole]) for k in ("at", "n")))
                    proven[-1] = [{"path": s["path"], "proof": int(p)} for s, p in zip(whole, proof, strict=True)]
                if all(s["settled"] for s in edges):
                    n_words = len(body.encode("utf-8", "surrogatepass").split()) if whole else 0
                    done.append(finish(body, covered(n_words, *(np.array([s[k] for s in whole]) for k in ("at", "n")), width) if whole else None))
                    pending.append((None, None))
                else:
                    done.append((None, None, None, None))
                    pending.append((body, [{"at": s["at"], "n": s["n"]} for s in whole]))
            columns = [batch.column(0), batch.column(1)]
            columns += [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            ints = pa.struct([("at", pa.int32()), ("n", pa.int32())])
            edge = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("window", pa.int64()), ("check", pa.int64())])
            proof = pa.struct([("path", pa.int64()), ("proof", pa.int64())])
            columns += [pa.array([p[0] for p in pending], pa.string()), pa.array([p[1] for p in pending], pa.list_(ints)), pa.array(windows, pa.list_(edge)), pa.array(proven, pa.list_(proof))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "salt", "n_words", "n_removed", "kept_sha256", "kept_text", "text", "spans", "windows", "proven"])

    kinds = "windows array<struct<key: long, at: int, window: long, check: long>>, proven array<struct<path: long, proof: long>>"
    state = materialize(met.mapInArrow(compare, f"{result}, text string, spans {span_type}, {kinds}"), "state")
    discard(repeated, nodes, branching)
    told = state.select(F.explode("proven").alias("p")).groupBy("p.path").agg(F.min("p.proof").alias("a"), F.max("p.proof").alias("b")).where("a <> b")
    stop = F.raise_error(F.concat(F.lit("different passages share the hash of a path: "), F.col("path").cast("string")))
    edges = state.where("windows IS NOT NULL").select("doc_id", "salt", F.explode("windows").alias("w")).select("doc_id", "salt", "w.*")
    # Rows that are there twice have branching paths of the same source only; one of them counts.
    edges = edges.dropDuplicates(["doc_id", "salt", "at", "key"]) if shared_ids else edges
    both = ["key", "window", "check"]
    again = materialize(edges.groupBy(*both).agg(F.count("*").alias("n")).where("n > 1").select(*both), "again")
    hits = edges.join(again, both).groupBy("doc_id", "salt").agg(F.collect_set("at").alias("at"))
    waiting = state.where("text IS NOT NULL").select("doc_id", "salt", "text", "spans")
    here = waiting["doc_id"].eqNullSafe(hits["doc_id"]) & (waiting["salt"] == hits["salt"])
    waiting = waiting.join(hits, here, "left").select(waiting["doc_id"], waiting["salt"], waiting["text"], waiting["spans"], hits["at"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for body, spans, at in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                n_words = len(body.encode("utf-8", "surrogatepass").split())
                places = np.array([s["at"] for s in spans] + list(at or []), np.int64)
                n = np.array([s["n"] for s in spans] + [1] * len(at or []), np.int64)
                done.append(finish(body, covered(n_words, places, n, width)))
            columns = [batch.column(0), batch.column(1), *(pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "salt", "n_words", "n_removed", "kept_sha256", "kept_text"])

    finished = state.where("text IS NULL").select("doc_id", "salt", "n_words", "n_removed", "kept_sha256", "kept_text")
    stopped = told.select(*(F.when(F.col("a") != F.col("b"), stop).cast(t).alias(c) for c, t in finished.dtypes))
    out = finished.unionByName(waiting.mapInArrow(settle, result)).unionByName(stopped)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * kept_text)
