"""Set similarity join on word shingles: a size-aware heavy-light join, and the components of its links.

Documents with equal shingle sets form one class, a node. Nodes whose Jaccard similarity reaches the threshold are
linked, by one of two ways. Small sets list all their subsets of the size that an overlap must have: sets that share
one are linked. Large sets enter inverted lists under the shingles of a prefix that any partner must share one of;
a common shingle further on, or sizes too far apart, rule a pair out in the list. The boundary between small and
large is where the sizes of all sets say that work is least. Shingles that many of all documents have come last in
every set's order, so they are in few prefixes; lists of the most frequent ones, the heavy, are merged by joins that
Spark can split, while lists of light shingles are read in one sorted pass.

Of a group of near copies not all pairs are looked at. First each node is compared with the node that its lists take
for the most central one; links found join components, and from then on only pairs across components matter. A list
that still brings many such pairs together gets a central node as its pivot, and the differences of its nodes to the
pivot are formed. The distance of two sets is the number of elements in one of them only; it is the sum of their
distances to the pivot less twice what the differences share. So two nodes that aren't both linked with the pivot can
only be linked if their differences share so much, which few do: new lists, under the rarest elements of the
differences, hold these pairs and no others. Nodes far from the pivot can't be linked with those near it; they stay in
their lists without these and get another pivot. All links are verified on whole sets.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing
from .common import discard, materialize

SET_A, SET_B, KEY = hashing.U(0xC2B2AE3D27D4EB4F), hashing.U(0x165667B19E3779F9), hashing.U(0xFF51AFD7ED558CCD)
#: Pairs across components that a node of a list may have on average before the list gets a pivot.
PARTNERS = 32
#: How often lists are refined by pivots; what then is left is compared pair by pair.
LEVELS = 3


def prefix(n: np.ndarray, t: int) -> np.ndarray:
    """Of a set of n, the elements of which a partner at t percent must have one."""
    return n - (t * n + 99) // 100 + 1


def short_prefix(n: np.ndarray, t: int) -> np.ndarray:
    """The same if the partner is no smaller."""
    return n - (2 * t * n + 99 + t) // (100 + t) + 1


def overlap(a: int, b: int, t: int) -> int:
    """The common elements that sets of a and b need."""
    return -(-t * (a + b) // (100 + t))


def shingles(buffer: np.ndarray, at: np.ndarray, words: int, key: np.uint64 = hashing.FIRST) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct shingle of a block, by row and hash. Fewer words than that are one shingle."""
    start, end = hashing.words(buffer)
    h, first = hashing.word_hashes(buffer, start, end, key), hashing.by_row(at, start)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, n - words + 1), 0)
    row, edge = np.repeat(np.arange(len(n)), count), np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(len(row), hashing.U)
    whole = n[row] >= words
    out[whole] = hashing.rolling(h, words, key)[(first[row] + np.arange(len(row)) - edge[row])[whole]]
    for m in range(1, words):
        few = np.flatnonzero(n == m)
        if len(few):
            run = h[(first[few][:, None] + np.arange(m)).ravel()]
            out[edge[few]] = hashing.sums(run, np.arange(0, len(run), m), key)
    for a, b in itertools.pairwise(edge.tolist()):
        out[a:b].sort()
    keep = np.concatenate([[True], (out[1:] != out[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
    return row[keep], out[keep]


def set_hashes(row: np.ndarray, h: np.ndarray, n: np.ndarray, key: np.uint64) -> np.ndarray:
    """A hash of the set of each row, of n elements."""
    total = np.concatenate([[hashing.U(0)], np.cumsum(hashing.mix(h + key))])
    edge = np.concatenate([[0], np.cumsum(n)])
    return hashing.mix(total[edge[1:]] - total[edge[:-1]] + n.astype(hashing.U) * key)


@lru_cache(None)
def subset_plan(n: int, small: int, t: int) -> list[tuple[int, int, np.ndarray]]:
    """(smaller size, larger size, subsets as index rows) for each size up to ``small`` that a partner of a set of n may have."""
    out = []
    for m in range(1, small + 1):
        a, b = min(n, m), max(n, m)
        need = overlap(a, b, t)
        if need <= a and not (n == m and need == n):
            out.append((a, b, np.array(list(itertools.combinations(range(n), need)), np.int64).reshape(-1, need)))
    return out


def subset_cost(n: int, small: int, t: int) -> int:
    return sum(math.comb(n, overlap(min(n, m), max(n, m), t)) for m in range(1, small + 1) if overlap(min(n, m), max(n, m), t) <= min(n, m))


def boundary(n: np.ndarray, t: int, most: int = 16, pair: int = 12) -> int:
    """The largest size that counts as small: where rows are fewest. n: the sets of each size. ``pair`` is what a row of an
    inverted list costs, with the pairs that come of it, in rows of subsets; sizes above ``most`` aren't tried."""
    listed = lambda k: pair * int(prefix(np.array(k), t))
    costs = [
        sum(int(n[k]) * (subset_cost(k, x, t) if k <= x else listed(k)) + (int(n[k]) * listed(k) if k <= x and 100 * k >= t * (x + 1) else 0) for k in range(1, most + 1))
        for x in range(most + 1)
    ]
    return int(np.argmin(costs))


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node it is connected with) of all nodes of links (a, b). Large-star and small-star steps
    in turn, each a join and an aggregation, until each node points to the smallest one and to no other."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        many = edges.groupBy("a").count().where("count > 1").select("a")
        if many.unionByName(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")).limit(1).count() == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            )
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(large.distinct(), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.*").where("a <> b").distinct(), "edges")
        discard(edges, least, large, low)
        edges = new


#: Bits of a shingle's hash that it is counted by, as its name; shingles that share them count together. 32 are sent, the rest is the part.
NAME = 46
#: Names that are sorted at once.
RUN = 1 << 21
#: Names of fewer documents than that are not told apart.
LEAST = 3
#: Sizes that are counted; larger ones count as the last.
SIZES = 101
#: From this size on 16 bits of a shingle tell too little.
BRIEF = 4096
POSTING = "token long, node long, n int, pos int, heavy boolean, doc_id long, check long"
POSTING_NAMES = ["token", "node", "n", "pos", "heavy", "doc_id", "check"]


class Join:
    """The join of one table. t: percent; words: of a shingle."""

    def __init__(self, docs: DataFrame, t: int, words: int, most_heavy: int, most_sent: int):
        self.spark, self.t, self.words, self.most_sent = docs.sparkSession, t, words, most_sent
        self.docs, self.most_heavy = docs, most_heavy

    def count(self) -> None:
        """Documents by size and by shingle, of all documents, and from these the frequent shingles and the boundary.

        Shingles are counted by NAME bits. Each task sorts runs of names and sends a row for each part of them, so that
        a name costs four bytes and a frequent one is a single entry of each run. The counts settle the order of the work
        only. The most frequent names go to all tasks, ``most_heavy`` at most and all of a count or none.
        """
        n = self.docs.count()
        self.shared_ids = self.docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() > 0
        words, schema = self.words, "part int, low binary, times binary"

        def packed(name: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Sorted names, by part: the rest of each in 32 bits, and how often it was there."""
            part, begin = np.unique(name >> 32, return_index=True)
            edge = pa.py_buffer((np.append(begin, len(name)) * 4).astype(np.int32))
            rest = (pa.Array.from_buffers(pa.binary(), len(part), [None, edge, pa.py_buffer(x.astype(np.uint32))]) for x in (name & 0xFFFFFFFF, times))
            batch = pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *rest], ["part", "low", "times"])
            for lo in range(0, batch.num_rows, 4096):
                yield batch.slice(lo, 4096)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, sizes = [], 0, np.zeros(SIZES, np.int64)
            for batch in batches:
                for _, _, buffer, at in hashing.blocks(batch.column(0), lower=True):
                    row, h = shingles(buffer, at, words)
                    sizes += np.bincount(np.minimum(np.bincount(row, minlength=len(at) - 1), SIZES - 1), minlength=SIZES)
                    held.append(names(h))
                    size += len(h)
                    if size >= RUN:
                        yield from packed(*np.unique(np.concatenate(held), return_counts=True))
                        held, size = [], 0
            if size:
                yield from packed(*np.unique(np.concatenate(held), return_counts=True))
            some = np.flatnonzero(sizes)
            yield from packed(some - (1 << 32), sizes[some])  # sizes are a part of their own, below all names

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by part; the last part of a batch may go on in the next one."""
            name, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in itertools.chain(batches, [None]):
                if batch is not None:
                    low, more = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).astype(np.int64) for k in (1, 2))
                    length = pa.compute.binary_length(batch.column(1)).to_numpy() // 4
                    name = np.concatenate([name, (np.repeat(batch.column(0).to_numpy().astype(np.int64), length) << 32) | low])
                    times = np.concatenate([times, more])
                if len(name):
                    order = np.argsort(name, kind="stable")
                    name, times = name[order], times[order]
                    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
                    name, times = name[begin], np.add.reduceat(times, begin)
                done = len(name) if batch is None else int(np.searchsorted(name >> 32, name[-1] >> 32)) if len(name) else 0
                tell = np.flatnonzero((times[:done] >= LEAST) | (name[:done] < 0))
                yield pa.RecordBatch.from_arrays([pa.array(name[tell]), pa.array(times[tell])], ["name", "df"])
                name, times = name[done:], times[done:]

        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = self.docs.select("text").mapInArrow(run, schema).repartition(parts, "part").sortWithinPartitions("part")
        counts = materialize(dealt.mapInArrow(summed, "name long, df long"), "counts")
        sizes = np.zeros(SIZES, np.int64)
        for name, df in counts.where("name < 0").collect():
            sizes[name + (1 << 32)] = df
        least = 1 << 62
        for df, many in itertools.accumulate(sorted(counts.where("name >= 0").groupBy("df").count().collect(), reverse=True), lambda x, y: (y[0], x[1] + y[1])):
            if many > self.most_heavy:
                break
            least = df
        frequent = counts.where((F.col("name") >= 0) & (F.col("df") >= least)).toArrow()
        name = frequent.column(0).to_numpy()
        order = np.argsort(name)
        self.frequent = (name[order], frequent.column(1).to_numpy()[order])
        self.hot = max(20, n // 200)  #: a shingle of so many documents has a list of its own kind
        self.small = boundary(sizes, self.t)
        discard(counts)

    def postings(self) -> DataFrame:
        """Rows of sets (pos null): node, n, doc_id, check; of inverted lists: token, node, n, pos; and of subsets, where pos
        is -1 for equal sizes, -2 for the smaller and -3 for the larger of two."""
        shared = self.spark.sparkContext.broadcast(self.frequent)
        t, words, small, hot = self.t, self.words, self.small, self.hot

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, df = shared.value
            for batch in batches:
                seen: set[int] = set()
                for first, last, buffer, at in hashing.blocks(batch.column(1), lower=True):
                    row, h = shingles(buffer, at, words)
                    n = np.bincount(row, minlength=last - first)
                    begin = np.concatenate([[0], np.cumsum(n)])
                    other_row, other = shingles(buffer, at, words, hashing.SECOND)  # from the bytes on, to check with
                    node = set_hashes(row, h, n, SET_A).view(np.int64)
                    check = set_hashes(other_row, other, np.bincount(other_row, minlength=last - first), SET_B).view(np.int64)
                    new = np.array([n[r] > 0 and not (x in seen or seen.add(x)) for r, x in enumerate(node.tolist())], bool)
                    weight = weights(h, known, df)
                    order = np.lexsort((weight, row)) if weight.any() else np.arange(len(h))
                    h, weight = h[order], weight[order]
                    pos = np.arange(len(h)) - begin[row]
                    size = n[row]
                    use = new[row] & (pos < prefix(size, t)) & ((size > small) | (100 * size >= t * (small + 1)) & (pos < short_prefix(size, t)))
                    parts = [(h[use].view(np.int64), node[row[use]], size[use], pos[use], weight[use] >= hot)]
                    for r in np.flatnonzero(new & (n <= small) & (n > 1)):
                        own = hashing.mix(h[begin[r] : begin[r + 1]] + KEY)
                        own.sort()
                        for a, b, index in subset_plan(int(n[r]), small, t):
                            key = hashing.mix(own[index].sum(1, dtype=hashing.U) + hashing.U(a << 32 | b)).view(np.int64)
                            kind = -1 if a == b else -2 if n[r] == a else -3
                            parts.append((key, np.full(len(key), node[r]), np.full(len(key), n[r]), np.full(len(key), kind), np.zeros(len(key), bool)))
                    token, who, size, pos, heavy = (np.concatenate(x) for x in zip(*parts, strict=True))
                    blank = len(token)
                    none = pa.nulls(blank, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token), pa.array(who), pa.array(size.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(heavy), none, none], POSTING_NAMES
                    )
                    rows = last - first
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(rows, pa.int64()), pa.array(node), pa.array(n.astype(np.int32)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.bool_()), batch.column(0).slice(first, rows), pa.array(check)],
                        POSTING_NAMES,
                    )

        return self.docs.select("doc_id", "text").mapInArrow(run, POSTING)

    def lists(self) -> DataFrame:
        """The postings of light tokens that several nodes have, those of heavy ones, and the rows of sets."""

        def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by token. The first row of a token that may go on in the next batch is looked at again there; all
            rows of a token and node are alike, so no other row has to wait, and twice the same row counts once later."""
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([*held, batch]).combine_chunks()
                token, node, heavy = table.column(0).fill_null(0).to_numpy(), table.column(1).to_numpy(), table.column(4).to_numpy()
                begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | heavy[1:] | heavy[:-1]]))
                mixed = (np.minimum.reduceat(node, begin) != np.maximum.reduceat(node, begin)) | heavy[begin]
                held = [] if heavy[-1] else table.slice(int(begin[-1]), 1).combine_chunks().to_batches()
                yield from table.filter(pa.array(np.repeat(mixed, np.diff(np.append(begin, len(token)))))).to_batches()

        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = self.postings().withColumn("heavy", F.coalesce("heavy", F.lit(True)))
        # Rows of heavy tokens and of sets pass through; they are spread by node, so that none of their lists meets in one task.
        spread = F.when(F.col("heavy"), F.xxhash64("node", "token", "doc_id")).otherwise(F.col("token"))
        dealt = rows.withColumn("spread", spread).repartition(parts, "spread").sortWithinPartitions("spread", "token").drop("spread")
        return materialize(dealt.mapInArrow(several, POSTING), "lists")

    def texts(self, pairs: DataFrame) -> DataFrame:
        """node, text of each node in pairs, read from the nodes' representatives. Up to ``most_sent`` nodes are sent to the
        texts; of more, both sides are dealt out by id."""
        some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes.select("node", "rep"), "node")
        some = materialize(some, "asked")
        if some.count() <= self.most_sent:
            some = F.broadcast(some)
        return self.docs.join(some, self.docs["doc_id"].eqNullSafe(some["rep"])).select(some["node"], self.docs["text"])

    def sets(self, pairs: DataFrame, whole: bool) -> DataFrame:
        """node, n, and shingles: whole, or brief, that is, 16 bits of each, 32 in sets of BRIEF and more."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                expected, out = batch.column(0).to_numpy(), []
                for first, last, buffer, at in hashing.blocks(batch.column(1), lower=True):
                    row, h = shingles(buffer, at, words)
                    edge = np.searchsorted(row, np.arange(last - first + 1))
                    names = set_hashes(row, h, np.diff(edge), SET_A).view(np.int64)
                    for r, node in enumerate(names.tolist()):
                        own = h[edge[r] : edge[r + 1]]
                        if node == expected[first + r]:  # else it is another text under the same id
                            out.append((node, len(own), (own if whole else np.sort(own.astype("<u2" if len(own) < BRIEF else "<u4"))).tobytes()))
                for lo in range(0, len(out), 500):
                    columns = [pa.array([x[k] for x in out[lo : lo + 500]], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "n", "shingles"])

        found = self.texts(pairs).mapInArrow(run, "node long, n int, shingles binary")
        # Rows that share id and text give the same set; it is enough once.
        return materialize(found.dropDuplicates(["node"]) if self.shared_ids else found, "sets")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs (a, b) that are linked: those that brief shingles don't rule out are compared by whole ones."""
        few = self.reaching(pairs, whole=False)
        return self.reaching(few, whole=True)

    def reaching(self, pairs: DataFrame, whole: bool) -> DataFrame:
        """The pairs (a, b) that reach the threshold by what their shingles have in common. Brief shingles may have more in
        common than whole ones, never less: they only rule pairs out."""
        t = self.t
        sets = self.sets(pairs, whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                common = np.zeros(batch.num_rows, np.int64)
                size = [batch.column(k).to_numpy() for k in (2, 4)]
                for k, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                    x, y = x.as_buffer(), y.as_buffer()
                    if whole:
                        common[k] = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                    else:
                        x, y = (np.frombuffer(v, "<u2" if n < BRIEF else "<u4") for v, n in ((x, size[0][k]), (y, size[1][k])))
                        if x.dtype != y.dtype:
                            x, y = x.astype("<u2"), y.astype("<u2")
                            x.sort()
                            y.sort()
                        common[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
                keep = 100 * common >= t * (size[0] + size[1] - common)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

        side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"shingles_{x}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b"))
        out = materialize(met.select("a", "b", "n_a", "shingles_a", "n_b", "shingles_b").mapInArrow(run, "a long, b long"), "linked")
        discard(sets)
        return out

    def differences(self, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The lists that take the place of those of pivots, nodes (pivot, node) that must stay in them as well, and links
        with pivots. near: pivot, node, n, comp, score.

        With phi = (100 + t) * (size of the difference to the pivot) - (100 - t) * n, two nodes are linked just if
        2 * (100 + t) * (what their differences share) reaches the sum of their phi. That is 1 at least where one of them
        is not linked with the pivot (u). Elements that no two differences share can't help; of the others each node
        is listed under the rarest, so many that a partner must have one of them.

        Nodes are apart by the difference of their distances to the pivot at least, so one whose phi is beyond a bound
        isn't linked with one whose omega = (100 + t) * (size of the difference) + (100 - t) * n is within it. The
        bound is the omega of a node as large as the pivot that shares half of the elements with it: only
        differences of nodes within are listed, and of nodes beyond, all pairs are left to their lists.
        """
        t = self.t
        pairs = near.where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        sets = self.sets(pairs, whole=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, edge, found = 0, [0], []
                for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True), 1):
                    both = np.concatenate([np.frombuffer(v.as_buffer(), "<u8") for v in (x, y)])
                    both.sort()
                    other = np.concatenate([[True], both[1:] != both[:-1], [True]])
                    found.append(both[other[1:] & other[:-1]].view(np.int64))
                    edge.append(edge[-1] + len(found[-1]))
                    if edge[-1] > 1 << 18 or k == batch.num_rows:
                        diff = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(found)))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k - at), batch.column(1).slice(at, k - at), diff], ["pivot", "node", "diff"])
                        at, edge, found = k, [0], []

        side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles_{x}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shingles_a", "shingles_b")
        met = met.mapInArrow(run, "pivot long, node long, diff array<long>").join(near, ["pivot", "node"]).join(self.nodes.select(F.col("node").alias("pivot"), F.col("n").alias("n_p")), "pivot")
        u = (100 + t) * F.size("diff") > (100 - t) * (F.col("n") + F.col("n_p"))
        far, own = (100 + t) * F.size("diff").cast("long"), (100 - t) * F.col("n").cast("long")
        bound = F.floor((500 - t) * F.col("n_p").cast("long") / 3)
        met = met.withColumns({"u": u, "phi": far - own, "within": far - own <= bound, "beyond": far + own > bound})
        diffs = materialize(met.withColumn("diff", F.when(F.col("within"), F.col("diff"))).drop("n_p"), "differences")
        discard(sets)
        key = ["pivot", "node"]
        every = diffs.select(*key, "u", F.explode("diff").alias("element"))
        counts = every.groupBy("pivot", "element").agg(F.count("*").alias("df"), F.max("u").alias("some")).where("df > 1 AND some").drop("some")
        shared = materialize(every.drop("u").join(counts, ["pivot", "element"]), "shared")
        known = diffs.drop("diff", "within", "beyond").join(shared.groupBy(*key).agg(F.count("*").alias("q")), key)
        slack = 2 * (100 + t) * F.col("q") - F.col("phi")
        # A node needs a partner whose phi its slack reaches; that of one linked with the pivot is not linked with it.
        of_u = known.groupBy("pivot").agg(F.min(F.when(F.col("u"), F.col("phi"))).alias("least_u"))
        known = known.join(of_u, "pivot").where(F.col("u") | (slack >= F.col("least_u")))
        of_all = known.groupBy("pivot").agg(F.min("phi").alias("least"))
        known = known.join(of_all, "pivot").withColumn("least", F.when(F.col("u"), F.col("least")).otherwise(F.col("least_u"))).where(slack >= F.col("least"))
        need = F.greatest(F.lit(1), F.ceil((F.col("phi") + F.col("least")) / F.lit(2 * (100 + t))))
        order = Window.partitionBy(*key).orderBy("df", "element")
        listed = shared.join(known, key).withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") <= F.col("q") - need)
        cap = (2 * (100 + t) * (F.col("q") - F.col("pos"))).cast("long")
        rows = listed.select(F.xxhash64("pivot", "element").alias("list"), "node", "n", "comp", "score", "u", "phi", cap.alias("cap"))
        rows = materialize(rows, "refined")
        discard(shared)
        return rows, diffs.where("beyond").select("pivot", "node"), diffs.where("not u").select(F.col("pivot").alias("a"), F.col("node").alias("b"))

    def crossing(self, rows: DataFrame, comp: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of nodes in different components that may be linked and whose links would join components, and
        links with pivots found on the way. rows: token, node, n, pos, score.

        A row of a list says that its node can only be linked with a node of the list whose phi and its own add up to
        its cap at most; so for inverted lists, with phi = t * n, and for those of differences.
        """
        t = self.t
        rows = rows.where("pos >= 0").join(comp, "node", "left")
        phi, cap = (t * F.col("n")).cast("long"), ((100 + t) * (F.col("n") - F.col("pos"))).cast("long")
        rows = rows.select(F.col("token").alias("list"), "node", "n", F.coalesce("comp", "node").alias("comp"), "score", F.lit(True).alias("u"), phi.alias("phi"), cap.alias("cap"))
        # The most central node of each component; nodes without links are their own.
        hubs = materialize(comp.join(scores, "node").groupBy("comp").agg(F.max(F.struct("score", "node")).alias("x")).select("comp", F.col("x.node").alias("hub")), "hubs")
        pairs, links = [], []

        def role(x: str, part: DataFrame) -> DataFrame:
            return part.select("list", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "comp", "u", "phi", "cap", "out")))

        for level in range(LEVELS):
            slack, own, of_u = F.col("cap") - F.col("phi"), F.col("phi"), lambda c: F.when(F.col("u"), c)
            stats = rows.groupBy("list", "comp").agg(F.min(own).alias("p"), F.min(of_u(own)).alias("pu"), F.max(slack).alias("s"), F.max(of_u(slack)).alias("su"))
            stats = stats.groupBy("list").agg(F.count("*").alias("comps"), F.min("p").alias("p"), F.min("pu").alias("pu"), F.max("s").alias("s"), F.max("su").alias("su"))
            least, most = F.when(F.col("u"), F.col("p")).otherwise(F.col("pu")), F.when(F.col("u"), F.col("s")).otherwise(F.col("su"))
            open_ = rows.join(stats.where("comps > 1"), "list").where((slack >= least) & (F.col("phi") <= most)).select(*rows.columns)
            open_ = materialize(open_, "open")
            shares = open_.groupBy("list", "comp").agg(F.count("*").alias("m"), F.max(F.struct("score", "node", "comp")).alias("top"))
            square = lambda c: F.col(c).cast("double") * F.col(c)
            shares = shares.groupBy("list").agg(
                F.count("*").alias("comps"), F.sum("m").alias("m"), F.sum(square("m")).alias("same"), F.max(F.struct("m", "comp")).alias("x"), F.max("top").alias("top")
            )
            large = (square("m") - F.col("same") > 2 * PARTNERS * F.col("m")) & F.lit(level < LEVELS - 1)
            shares = materialize(shares.where("comps > 1").select("list", F.col("x.comp").alias("most"), "top", large.alias("large")), "shares")

            here = open_.join(shares.where("not large"), "list").withColumn("out", F.col("comp") != F.col("most"))
            # One of a pair is outside the list's largest component; where both are, the smaller node is looked up.
            s, g = role("s", here.where("out")), role("g", here)
            total = F.col("phi_s") + F.col("phi_g")
            fits = (s["list"] == g["list"]) & (F.col("comp_s") != F.col("comp_g")) & (~F.col("out_g") | (F.col("node_s") < F.col("node_g")))
            fits &= (F.col("u_s") | F.col("u_g")) & (F.col("cap_s") >= total) & (F.col("cap_g") >= total) & (100 * F.least("n_s", "n_g") >= t * F.greatest("n_s", "n_g"))
            pairs.append(materialize(s.join(g, fits).select(F.least("node_s", "node_g").alias("a"), F.greatest("node_s", "node_g").alias("b")).distinct(), "cross"))
            hot = shares.where("large").select("list", F.col("top.node").alias("top"), F.col("top.comp").alias("comp")).join(hubs, "comp", "left")
            hot = materialize(open_.join(hot.select("list", F.coalesce("hub", "top").alias("pivot")), "list"), "hot")
            discard(open_, shares)
            if hot.limit(1).count() == 0:
                break
            near = materialize(hot.select("pivot", "node", "n", "comp", "score").distinct(), "around")
            refined, beyond, more = self.differences(near)
            rows = refined.unionByName(hot.join(beyond, ["pivot", "node"]).select(*refined.columns))
            links.append(more)
        union = lambda tables, none: functools.reduce(DataFrame.unionByName, tables) if tables else none
        return union(pairs, None).distinct(), union(links, self.spark.createDataFrame([], "a long, b long"))

    def run(self) -> DataFrame:
        t = self.t
        self.count()
        lists = self.lists()
        members = materialize(lists.where("pos IS NULL").select("doc_id", "node", "n", "check"), "members")
        clash = F.raise_error(F.lit("two shingle sets share a hash; choose other constants"))
        nodes = members.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.when((F.min("check") != F.max("check")) | (F.min("n") != F.max("n")), clash.cast("int")).otherwise(F.max("n")).alias("n")
        )
        self.nodes = nodes = materialize(nodes, "nodes")
        every = materialize(lists.where("pos IS NOT NULL").select("token", "node", "n", "pos").distinct(), "rows")
        discard(lists)

        # Lists of the same nodes lead to the same pairs; the first one by the order stands for all of them.
        who = F.struct("node", "n")
        firsts = every.groupBy("token").agg(
            F.min(F.when(F.col("pos") == -1, who)).alias("one"),
            F.min(F.when(F.col("pos") == -2, who)).alias("low"),
            F.min(F.when(F.col("pos") == -3, who)).alias("high"),
            F.count("*").alias("nodes"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
            F.min(F.struct("node", "pos")).alias("place"),
        )
        kind, pos = F.when(F.col("place.pos") < 0, F.col("token")), F.col("place.pos")
        alike = firsts.where((F.col("nodes") > 1) & ((pos >= -1) | F.col("low").isNotNull() & F.col("high").isNotNull())).groupBy("nodes", "x", "y", kind.alias("kind"))
        best_of = alike.agg(F.count("*").alias("lists"), F.min(F.struct("place.pos", "token", "one", "low", "high")).alias("f"))
        firsts = materialize(best_of.select("lists", "nodes", "f.token", "f.one", "f.low", "f.high"), "firsts")
        rows = materialize(every.join(firsts.select("token", "lists", "nodes"), "token"), "lists")
        discard(every)

        # A node is the more central, the more nodes its lists hold: what is its own alone keeps it out of such lists. Each
        # node is compared with the most central one of its lists, as most of them name it, and with what shares a subset.
        scores = rows.where("pos >= 0").groupBy("node").agg(F.sum(F.col("lists") * F.col("nodes")).alias("score"))
        scores = materialize(scores, "scores")
        scored = materialize(rows.drop("nodes").join(scores, "node", "left").fillna(0, ["score"]), "scored")
        central = scored.where("pos >= 0").groupBy("token").agg(F.max(F.struct("score", "node", "n")).alias("c")).select("token", F.struct("c.node", "c.n").alias("central"))
        named = scored.join(firsts.drop("lists", "nodes"), "token").join(central, "token", "left")
        other = F.when(F.col("pos") >= 0, F.col("central")).when(F.col("pos") == -1, F.col("one")).when(F.col("pos") == -2, F.col("high")).otherwise(F.col("low"))
        named = named.select("node", "n", "lists", (F.col("pos") < 0).alias("subset"), other.alias("o"))
        named = named.where((F.col("o.node") != F.col("node")) & (100 * F.least("n", "o.n") >= t * F.greatest("n", "o.n")))
        votes = materialize(named.groupBy("node", F.col("o.node").alias("o"), "subset").agg(F.sum("lists").alias("votes")), "votes")
        best = votes.where("not subset").groupBy("node").agg(F.max(F.struct("votes", "o")).alias("x")).select("node", F.col("x.o").alias("o"))
        pair = (F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b"))
        tried = materialize(best.select(*pair).unionByName(votes.where("subset").select(*pair)).distinct(), "tried")
        discard(votes, firsts, rows)
        links = self.compared(tried)
        comp = materialize(components(links), "components")

        # Then the pairs that could still join components, and the components that their links do join.
        pairs, more = self.crossing(scored, comp, scores)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = self.compared(pairs).unionByName(more)
        ca, cb = (comp.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
        ends = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
        joined = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        comp = nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        comp = materialize(comp.join(joined, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "components")
        lowest = comp.join(nodes, "node").groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = materialize(comp.join(lowest, "comp").select("node", "component_id"), "named")
        full = members.where("n > 0").join(named, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        return full.unionByName(members.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def names(h: np.ndarray) -> np.ndarray:
    """What each shingle is counted by."""
    return (h >> hashing.U(64 - NAME)).view(np.int64)


def weights(h: np.ndarray, known: np.ndarray, df: np.ndarray) -> np.ndarray:
    """How many documents have each shingle, by its name; those not among the frequent ones weigh 0."""
    if not len(known) or not len(h):
        return np.zeros(len(h), np.int64)
    name = names(h)
    k = np.minimum(np.searchsorted(known, name), len(known) - 1)
    return np.where(known[k] == name, df[k], 0)


def link(
    docs: DataFrame, t: int = 80, words: int = 5, most_heavy: int = 1 << 19, most_sent: int = 200_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links lead to, itself included.

    A-Z count as lower case, words are runs of characters other than space and U+0009 to U+000D, and a document's set has
    its distinct runs of ``words`` words, or the whole text as one where there are fewer. Documents are linked when
    100 * common >= t * all of their shingles. A null text and one without words have no shingles and no links; such rows
    are their own component. Ids may repeat: rows are told apart by their texts; null ids come before all others, so a
    component that has one has no number. Other columns are not read; an empty table gives an empty table.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return Join(docs, t, words, most_heavy, most_sent).run()
