"""Language identification by prediction by partial matching.

For each language, a tree of byte contexts up to three bytes long is learned once and frozen. The probability of a
byte is its share under the longest context that has seen it; leaving a context costs an escape, as likely as the
context has distinct successors, and the shorter context then divides by what the longer one has ruled out, so
the probabilities of each context add up to one and code lengths are exact. The language whose tree codes a text
shortest is predicted. All 256 bytes are told apart; only contexts and successors that were seen are stored, so trees
are as large as what they were learned from, whatever the languages and their scripts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

ORDER = 3
#: Bytes that are scored at once.
BLOCK = 1 << 19
#: Texts of a language that has only very long ones which are learned.
LONG_ONES = 8
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")


def has_letter(text: str) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def folded(text: str) -> bytes:
    """What is coded: the text in lower case, in UTF-8, after as many spaces as a context is long."""
    return b" " * ORDER + text.lower().encode("utf-8", "surrogatepass")


@dataclass
class Level:
    """The seen contexts of one length and their seen successors, as numbers of bytes (the first the highest), sorted."""

    keys: np.ndarray  #: contexts with a successor
    bits: np.ndarray  #: code lengths of these successors
    contexts: np.ndarray
    leave: np.ndarray  #: bits that a byte costs, besides its code length in the shorter context, where it wasn't seen


def find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what in where, sorted, and whether it is there."""
    at = np.minimum(np.searchsorted(where, what), max(0, len(where) - 1))
    return at, where[at] == what if len(where) else np.zeros(len(what), bool)


def grams(codes: np.ndarray, length: int) -> np.ndarray:
    """Each run of so many bytes as a number."""
    n = max(0, len(codes) - length + 1)
    key = np.zeros(n, np.uint32)
    for j in range(length):
        key = key << np.uint32(8) | codes[j : n + j]
    return key


def tree(codes: np.ndarray) -> list[Level]:
    """The levels of contexts of 0 to ORDER bytes. A successor's share of a context is its count over ``rest``."""
    levels, keys_below, n_below = [], np.arange(256, dtype=np.uint32), np.ones(256, np.int64)
    contexts_below, rest_below = np.zeros(1, np.uint32), np.full(1, 256)  # order -1: all bytes alike
    for order in range(ORDER + 1):
        keys, n = np.unique(grams(codes, order + 1), return_counts=True)
        contexts, first, distinct = np.unique(keys >> np.uint32(8), return_index=True, return_counts=True)
        total = np.add.reduceat(n, first) if len(n) else n
        # What was seen after a context was seen after the shorter one, so the share of the others there is a count, too.
        cut = np.uint32((1 << 8 * max(1, order)) - 1)
        taken = n_below[find(keys_below, keys & cut)[0]]
        taken = np.add.reduceat(taken, first) if len(n) else taken
        whole = rest_below[find(contexts_below, contexts & (cut >> np.uint32(8)))[0]]
        left = whole - taken
        rest = np.where(left > 0, total + distinct, total)
        leave = np.where(left > 0, np.log2(np.maximum(1, left) / whole) - np.log2(distinct / np.maximum(1, rest)), np.inf)
        bits = np.log2(np.repeat(rest, distinct) / n)
        levels.append(Level(keys, bits.astype(np.float32), contexts, leave.astype(np.float32)))
        keys_below, n_below, contexts_below, rest_below = keys, n, contexts, rest
    return levels


@dataclass
class Trees:
    languages: list[str]
    levels: list[list[Level]]  #: of each language

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last of four bytes after the others, by language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        for k, levels in enumerate(self.levels):
            todo = np.arange(len(keys))
            for order in range(ORDER, -1, -1):
                level, key = levels[order], keys[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
                at, seen = find(level.keys, key)
                out[todo[seen], k] += level.bits[at[seen]]
                todo, key = todo[~seen], key[~seen] >> np.uint32(8)
                at, seen = find(level.contexts, key)
                out[todo[seen], k] += level.leave[at[seen]]
            out[todo, k] += 8
        return out

    @property
    def symbol(self) -> np.ndarray:
        """Of each byte, its place among those seen in any language; all others, which no tree tells apart, share the last."""
        seen = np.unique(np.concatenate([levels[0].keys for levels in self.levels])) if self.levels else np.zeros(0, int)
        out = np.full(256, len(seen), np.int32)
        out[seen] = np.arange(len(seen))
        return out

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 1

    @property
    def bits(self) -> np.ndarray:
        """The table of all contexts' code lengths by symbol, and language: to look at trees of few symbols, not for scoring."""
        symbol = self.symbol
        _, byte, n = np.unique(symbol, return_index=True, return_counts=True)
        key = np.zeros(1, np.uint32)
        for _ in range(ORDER + 1):
            key = (key[:, None] << np.uint32(8) | byte.astype(np.uint32)).reshape(-1)
        return self.lengths(key) - np.log2(np.tile(n, len(key) // len(n)))[:, None]


def fit(samples: dict[str, list[str]]) -> Trees:
    """Trees from texts by language. Languages are in order of their names."""
    languages = sorted(samples)
    return Trees(languages, [tree(np.frombuffer(b"".join(map(folded, samples[k])), np.uint8)) for k in languages])


def code_lengths(trees: Trees, texts: list[str]) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(texts), len(trees.languages)))
    coded = [folded(t) for t in texts]
    row = 0
    while row < len(coded):
        last, n = row, 0
        while last < len(coded) and (last == row or n + len(coded[last]) <= BLOCK):
            n += len(coded[last])
            last += 1
        codes = np.frombuffer(b"".join(coded[row:last]), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(x) for x in coded[row:last]])])
        for at in range(0, len(codes) - ORDER, BLOCK):  # a long text in several steps
            part = codes[at : at + BLOCK + ORDER]
            n = len(part) - ORDER
            keys, at_key = np.unique(grams(part, ORDER + 1), return_inverse=True)
            bits = trees.lengths(keys)[at_key]
            # a code at place i + ORDER is of the text that holds it; those of the leading spaces don't count
            for k in range(last - row):
                lo, hi = max(first[k], at), min(first[k + 1] - ORDER, at + n)
                if lo < hi:
                    out[row + k] += bits[lo - at : hi - at].sum(0, dtype=np.float64)
        row = last
    return out


def sample(labelled: DataFrame, per_language: int, longest: int) -> dict[str, list[str]]:
    """Up to ``per_language`` texts of each language, those of smallest hash, of texts of up to ``longest`` characters; of a
    language that has only longer ones, up to LONG_ONES of these.

    labelled: doc_id, text, lang without nulls in the last two. Only sampled rows reach the driver, at most twice as many and 100 a language.
    Rows that share an id and a text count once.
    """
    labelled = labelled.where(F.col("text").rlike("\\S")).withColumn("long", F.length("text") > longest)
    n = {(r[0], r[1]): r[2] for r in labelled.groupBy("lang", "long").agg(F.count("*").alias("n")).collect()}
    want = {k: LONG_ONES if k[1] else per_language for k in n if not k[1] or (k[0], False) not in n}
    if not want:
        return {}
    rank, share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)), F.lit(None).cast("double")
    for (lang, long), count in want.items():
        share = F.when((F.col("lang") == lang) & (F.col("long") == long), F.lit(min(1.0, (1.5 * count + 50) / n[lang, long]))).otherwise(share)
    some = labelled.withColumns({"rank": rank, "share": share}).where(F.col("rank") < F.col("share") * (1 << 30))
    some = some.select("lang", "share", "rank", "text").distinct().orderBy(F.col("rank") / F.col("share")).limit(sum(2 * x + 100 for x in want.values()))
    found: dict[str, list] = {lang: [] for lang, _ in want}
    for r in some.collect():
        found[r.lang].append((r.rank, r.text))
    most = {lang: count for (lang, _), count in want.items()}
    return {k: [t for _, t in sorted(x)[: most[k]]] for k, x in found.items() if x}


def decide(trees: Trees, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text of a column."""
    texts = [t or "" for t in column.to_pylist()]
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if has_letter(t)] if trees.languages else []
    if rows:
        bits = code_lengths(trees, [texts[i] for i in rows])
        more = bits - bits.min(1, keepdims=True)
        lang[rows] = np.array(trees.languages, object)[bits.argmin(1)]
        score[rows] = 1 / np.exp2(-np.minimum(more, 1000)).sum(1)
    return lang, score


def predict(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the language with the shortest code, and its share of the probability of all.

    "und" and 0 where the text is null or has no letter, or nothing was learned. Of languages that tie, the first by
    name. Rows are scored each on its own; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = decide(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    columns = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, trees: Trees, confidence: float, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that have a language, and one with this score at least. Rows are looked at each on
    its own, whatever their ids."""
    shared, place = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = decide(shared.value, batch.column(place))
            yield batch.filter(pa.array((lang != "und") & (score >= confidence)))

    return docs.mapInArrow(run, docs.schema)


def learned(docs: DataFrame, per_language: int = 400, longest: int = 50_000) -> Trees:
    """Trees of the languages of docs (doc_id, text, lang), from rows whose crc32 of the id, modulo 3, is not 1 and that have
    a lang, at most ``per_language`` of each."""
    mine = ~held_out(F.col("doc_id"), 3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    return fit(sample(docs.where(mine).select("doc_id", "text", "lang"), per_language, longest))


def identify(docs: DataFrame, per_language: int = 400, longest: int = 50_000) -> DataFrame:
    """doc_id, lang_pred, score, held_out. docs: doc_id, text, lang. Learns from the rows that are not held out."""
    trees = learned(docs, per_language, longest)
    return predict(docs, trees).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
