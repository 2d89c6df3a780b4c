"""Best-fit packing of token sequences by exact complements.

Texts become ids, ids become pieces of at most ``room`` tokens. What to put together follows from how many pieces
there are of each length, at most ``room`` numbers: taking the lengths from the longest down, the gap that a piece
leaves is looked up in an index of single lengths, then, from the longest down again, in one of the sums of pairs, then
of triples, and a combination that fills it exactly is used as often as its lengths are available; what finds no exact
partner is packed best fit.
The plan says where the k-th piece of each length goes; k comes from counts of small cells of pieces.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Memo, byte_characters
from .common import materialize


class Words:
    """The ids, as little-endian 32-bit numbers, of texts, remembered by word.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words; a word of
    simple characters is taken apart as the tokenizer would, and its letters, in lower case, are remembered too.
    """

    SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
    #: On simple characters, in lower case, what the tokenizer's own pattern matches.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.as_char = self.tokenizer.model, byte_characters()
        self.pieces, self.words = Memo(self._piece), Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize("".join(map(self.as_char.__getitem__, piece.encode())))
        return np.array([t.id for t in found], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if self.SIMPLE.match(word) and not any(x in word for x in self.special):
            return b"".join(map(self.pieces.__getitem__, self.PIECE.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        out = b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        self.words.trim()
        self.pieces.trim()
        return out


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, room: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each text's ids, ``end`` included.

    A null text counts as empty and is the id ``end`` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = words(vocabulary), np.array([end], "<u4").tobytes()
        for batch in batches:
            keys, rows = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = known.ids(body.as_py() or "") + last
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    keys.append(key)
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            table = np.array(rows, np.int64).reshape(-1, 4)
            columns = [pa.array(keys, pa.int64()), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, k]) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, PIECE)


class Sums:
    """The sums of one, two and three lengths that are there, and by sum the ways to it, the most even first, as
    very short lengths are what fills the last gaps. Counts in ``left`` only ever fall, so a way that has run out is passed
    by for good."""

    def __init__(self, left: list[int], room: int):
        self.left, self.at, there = left, [0] * (room + 1), np.array(left) > 0
        self.pairs: list[list[int]] = [[], []]
        for total in range(2, room + 1):
            first = np.arange((total + 1) // 2, total)
            self.pairs.append(first[there[first] & there[total - first]].tolist())

    def available(self, parts: tuple[int, ...]) -> bool:
        return all(self.left[p] >= parts.count(p) for p in parts)

    def one(self, gap: int, own: tuple[int, ...]) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.available((*own, gap)) else None

    def two(self, gap: int, own: tuple[int, ...], longest: int | None = None) -> tuple[int, ...] | None:
        """Two lengths, none above longest, that add up to gap and are there beside own."""
        if gap < 2:
            return None
        ways, at = self.pairs[gap], self.at[gap]
        while at < len(ways) and not self.available((ways[at], gap - ways[at])):
            at += 1
        self.at[gap] = at
        for first in itertools.islice(ways, at, None):
            if longest is not None and first > longest:
                break
            if self.available((*own, first, gap - first)):
                return first, gap - first
        return None

    def three(self, gap: int, own: tuple[int, ...]) -> tuple[int, ...] | None:
        for first in range((gap + 2) // 3, gap - 1):
            if self.left[first] > own.count(first) and (rest := self.two(gap - first, (*own, first), first)):
                return first, *rest
        return None


def combinations(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that go together, how often), so that every piece is in one sequence.

    Gaps are filled by singles, pairs and triples. Where lengths are few and far between, fillings of many short pieces
    can leave long ones without any, so the plans without triples, and without pairs, are made too; the one with the
    fewest sequences is taken, and among equals that with all.
    """
    return min((fill(counts, room, most) for most in (3, 2, 1)), key=lambda plan: sum(times for _, times in plan))


def fill(counts: dict[int, int], room: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan whose gaps are filled by up to ``most`` lengths exactly, the rest best fit."""
    left = [0] * (room + 1)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...]) -> None:
        """Uses the combination as often as its lengths are there."""
        times = min(left[p] // parts.count(p) for p in parts)
        out.append((parts, times))
        for p in parts:
            left[p] -= times

    if left[room]:
        use((room,))
    sums = Sums(left, room)
    for find in (sums.one, sums.two, sums.three)[:most]:
        for length in range(room - 1, 0, -1):
            while left[length] and (found := find(room - length, (length,))):
                use((length, *found))
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(parts: tuple[int, ...], times: int) -> None:
        gap = room - sum(parts)
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((parts, times))

    for length in range(room, 0, -1):
        n = left[length]
        while n:
            if (at := bisect_left(gaps, length)) < len(gaps):
                gap = gaps[at]
                parts, times = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(at)
                k = min(n, times)
                if times > k:
                    put(parts, times - k)
                put((*parts, length), k)
                n -= k
            else:
                each = room // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                n = 0
    return out + [x for group in bins.values() for x in group]


def pack(cut: DataFrame, room: int = 2048, cells: int = 256) -> DataFrame:
    """The pieces with sequence_id and offset. cut: what pieces() gives, with no other columns.

    Equal rows (a document that is there twice) are counted before the shuffle and dealt out again as so many rows.
    The driver gets the number of pieces of each length, at most ``room`` numbers, and sends back the plan, whose
    size depends on ``room`` alone. An empty table gives an empty table.
    """
    spark = cut.sparkSession
    cut = materialize(cut, "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    starts, sequences, offsets, base = [], [], [], 0
    given = dict.fromkeys(counts, 0)
    for parts, times in combinations(counts, room):
        at, k = 0, 0
        while k < len(parts):
            # equal lengths stand side by side or apart; each place takes the next `times` pieces of its length
            starts.append((parts[k] << 48) + given[parts[k]])
            sequences.append(base)
            offsets.append(at)
            given[parts[k]] += times
            at += parts[k]
            k += 1
        base += times
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    plan = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (starts, sequences, offsets)))
    # Whole sequences are the most frequent length by far where texts are long; they get more cells.
    cell = F.pmod(F.xxhash64("doc_id", "piece"), F.when(F.col("length") == room, cells * 256).otherwise(cells))
    alike = cut.groupBy(*cut.columns, cell.alias("cell")).agg(F.count("*").alias("copies"))
    before = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("within", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    sizes = cut.groupBy("length", cell.alias("cell")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("length", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    each = ranked.join(ahead, ["length", "cell"]).select(
        *cut.columns,
        F.explode(F.sequence(F.col("ahead") + F.col("within"), F.col("ahead") + F.col("within") + F.col("copies") - 1)).alias("rank"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, offset = plan.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            key = (length << 48) + rank
            at = np.searchsorted(first, key, "right") - 1
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns += [pa.array(sequence[at] + key - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return each.mapInArrow(place, PIECE + ", sequence_id long, offset long")
