"""Approximate nearest neighbours by inner product, over balanced posting lists.

A bounded sample gives centroids, trained so that lists come out about equally long. A graph over the centroids,
small enough for memory, finds the nearest ones of a vector without looking at all. Every vector is put in the list
of its nearest centroid and of others almost as near, so that those on a boundary are found from both sides. A
query looks at the lists whose centroids are within a ratio of the nearest one's distance, as found by comparing it
with all centroids. The ratio is widened until a sample of the queries, compared with all vectors, finds what it
should; a query with more such lists than it is worth to look up is compared with all vectors instead,
in blocks of queries that each pass over the table once.

Equal vectors form one class that is indexed once, with its smallest ids; lists and queries meet in blocks of
bounded size. For inner products, vectors get one more component that makes their lengths equal, which turns the
largest product into the smallest distance. Vectors whose lengths are nearest to the same power of two are a band with
centroids and lists of its own, so that long vectors don't press the short ones into one point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T)


def centroids(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k-means in which full lists repel: a list's excess over the mean adds to its distances."""
    r = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    out = sample[r.choice(len(sample), lists, replace=False)].astype(np.float64)
    push = np.zeros(lists)
    for _ in range(rounds):
        near, size, sums, spread = np.empty(len(sample), np.int64), np.zeros(lists), np.zeros_like(out, np.float64), 0.0
        for at in range(0, len(sample), 4096):
            d = squared(sample[at : at + 4096], out)
            near[at : at + 4096] = (d + push).argmin(1)
            spread += d.min(1).sum()
        size = np.bincount(near, minlength=lists)
        np.add.at(sums, near, sample)
        out = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], sample[r.choice(len(sample), lists)])
        push = np.maximum(0, push + 0.2 * spread / len(sample) * (size / (len(sample) / lists) - 1).clip(-1, 2))
    return out


@dataclass
class Graph:
    """Centroids and, of each, its neighbours: the nearest ones, and some at random so that all can be reached."""

    points: np.ndarray
    edges: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, near: int = 16, far: int = 8, seed: int = 4) -> Graph:
        n, r = len(points), np.random.default_rng(seed)
        edges = np.empty((n, min(near, n) + far), np.int64)
        for at in range(0, n, 1024):
            d = squared(points[at : at + 1024], points)
            edges[at : at + 1024, : min(near, n)] = np.argpartition(d, min(near, n - 1), 1)[:, : min(near, n)]
        edges[:, min(near, n) :] = r.integers(0, n, (n, far))
        return cls(points, edges)

    def search(self, x: np.ndarray, k: int, beam: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of about the k nearest to each row of x, nearest first.

        Best-first search for all rows at once; each step opens the nearest centroid of each row's beam that isn't open yet.
        """
        n, m = len(x), len(self.points)
        k, beam = min(k, m), min(max(beam, k), m)
        length = (self.points * self.points).sum(1)
        start = np.unique(np.linspace(0, m - 1, min(m, max(beam, 2 * int(np.sqrt(m))))).astype(np.int64))
        d = length[start] - 2 * x @ self.points[start].T
        pick = np.argsort(d, 1, kind="stable")[:, :beam]
        ids, d = start[pick], np.take_along_axis(d, pick, 1)
        opened = np.zeros(ids.shape, bool)
        live = np.arange(n)
        while len(live):
            todo = np.where(opened[live], np.inf, d[live])
            best = todo.argmin(1)
            on = todo[np.arange(len(live)), best] < np.inf
            live, best = live[on], best[on]
            if not len(live):
                break
            opened[live, best] = True
            new = self.edges[ids[live, best]]
            dn = length[new] - 2 * np.einsum("nkd,nd->nk", self.points[new], x[live])
            known = (new[:, :, None] == ids[live][:, None, :]).any(2)
            order = np.argsort(new, 1, kind="stable")
            again = np.zeros(new.shape, bool)
            srt = np.take_along_axis(new, order, 1)
            np.put_along_axis(again, order[:, 1:], srt[:, 1:] == srt[:, :-1], 1)
            dn = np.where(known | again, np.inf, dn)
            all_d, all_i = np.concatenate([d[live], dn], 1), np.concatenate([ids[live], new], 1)
            all_o = np.concatenate([opened[live], dn == np.inf], 1)
            keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
            d[live], ids[live], opened[live] = (np.take_along_axis(v, keep, 1) for v in (all_d, all_i, all_o))
        return ids[:, :k], np.maximum(0, d[:, :k] + (x * x).sum(1)[:, None])


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


#: Beyond these, lengths count as these.
LENGTHS = (1e-150, 1e150)


def bands(v: np.ndarray) -> np.ndarray:
    """Of each vector, the power of two nearest to its length; lengths about 1 are one band."""
    return np.rint(np.log2(np.sqrt((v * v).sum(1)).clip(*LENGTHS))).astype(int)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, embedding of the rows that take part: no nulls, finite, not zero, of the most frequent dimension."""
    x = df.select(df[vec_id].cast("long").alias("vec_id"), df[embedding].alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    return x


def classes(x: DataFrame, ids: int, salt: int = 64) -> DataFrame:
    """embedding, ids: each distinct vector with its smallest ids, ascending. A vector of very many rows is first thinned
    to its smallest ids within ``salt`` parts."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(salt))
    inner = Window.partitionBy("embedding", "part").orderBy("vec_id")
    few = x.withColumn("part", part).withColumn("n", F.row_number().over(inner)).where(F.col("n") <= ids)
    return few.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, ids).alias("ids"))


FOUND = pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())]))


def nearest(v: np.ndarray, ids: list[list[int]], q: np.ndarray, k: int, at_once: int = 256) -> list[list[dict]]:
    """The k best (negative product, id) for each row of q among the classes v with these ids, ascending."""
    first, out = np.array([i[0] for i in ids]), []
    for start in range(0, len(q), at_once):
        for row in q[start : start + at_once] @ v.T:
            if len(row) > k:
                edge = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row >= edge)
            else:
                at = np.arange(len(row))
            at = at[np.lexsort((first[at], -row[at]))]
            got = []
            for i in at:
                got += [(-row[i], m) for m in ids[i]]
            out.append([{"less": a, "vec_id": b} for a, b in sorted(got)[:k]])
    return out


def scan(base: DataFrame, asked: DataFrame, k: int, dim: int, at_once: int) -> DataFrame:
    """embedding, found: the k best of all classes for each row of asked, distinct vectors. A pass over base compares
    about ``at_once`` of them, which go to all executors; nothing of base is shuffled."""
    spark, kind = base.sparkSession, dict(base.dtypes)["embedding"]
    parts = -(-asked.count() // at_once)
    out = spark.createDataFrame([], f"embedding {kind}, found array<struct<less: double, vec_id: long>>")
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("embedding"), F.lit(parts)) == part).toArrow().column("embedding").combine_chunks()
        sent = spark.sparkContext.broadcast(vectors(block, dim))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = nearest(vectors(batch.column(0), dim), batch.column(1).to_pylist(), sent.value, k)
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, FOUND)], ["q", "found"])

        met = base.select("embedding", "ids").mapInArrow(run, "q int, found array<struct<less: double, vec_id: long>>")
        # Classes are disjoint over batches, so no id comes twice.
        best = met.select("q", F.explode("found").alias("x")).groupBy("q").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias("found"))
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(block)), pa.int32()), "embedding": block}))
        out = out.unionByName(materialize(best.join(names, "q").select(F.col("embedding").cast(kind).alias("embedding"), "found"), "scanned"))
        sent.destroy()
    return out


def widened(posted: DataFrame, truth: DataFrame, far: Callable[[np.ndarray], np.ndarray], recall: float) -> float:
    """The least ratio of squared distances within which queries of truth (embedding, found) reach this share of what they should."""
    asked = truth.collect()
    if not asked:
        return 1.0
    ids = truth.select(F.explode("found.vec_id").alias("id")).distinct()
    lists: dict[int, list[int]] = {}
    for r in posted.select("list", F.explode("ids").alias("id")).join(F.broadcast(ids), "id").collect():
        lists.setdefault(r.id, []).append(r.list)
    d = far(np.array([r.embedding for r in asked], np.float64))
    needed = [d[i, lists[f.vec_id]].min() for i, r in enumerate(asked) for f in r.found]
    return float(np.quantile(needed, recall, method="higher"))


@dataclass(frozen=True)
class Settings:
    list_size: int = 128  #: distinct vectors a list is meant to have
    most_lists: int = 16384  #: bounds the centroids in memory
    sampled: int = 32  #: vectors a list is trained from
    most_sampled: int = 131072
    copies: int = 4  #: lists that a boundary vector is in, at most; the nearest is always one of them
    near: float = 1.15  #: ratio of distances up to which a vector is in a further list
    lists: int = 32  #: lists that a query looks up; with more within the ratio it is compared with all vectors
    ratio: float = 1.3  #: ratio of distances up to which it does, at least
    recall: float = 0.99  #: share of the neighbours of sampled queries that must be within the ratio; it is widened to that
    tuned: int = 256  #: queries that are sampled for it
    least: int = 8  #: lists that it looks at in any case
    block: int = 4096  #: rows of a list, and queries of a list, that meet at once
    scanned: int = 32768  #: queries that one pass over all vectors compares


def search(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries its k nearest rows of df, itself left out by its id.

    Nearness is the inner product in double precision; ties go to the smaller id. Every usable row is indexed; rows and
    queries that are null, zero, non-finite or of another dimension than most take no part. Rows that share an id and a
    vector are one row. Other columns are not read; an empty table gives an empty table.
    """
    spark = df.sparkSession
    x = usable(df, vec_id, embedding)
    result = "query_id long, rank int, vec_id long, score double"
    dims = x.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], result)
    dim = dims[0].dim
    base = materialize(classes(x.where(F.size("embedding") == dim).distinct(), k + 1), "classes")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    band = F.rint(F.log2(F.greatest(F.least(norm, F.lit(LENGTHS[1])), F.lit(LENGTHS[0])))).cast("int")
    sizes = {r.band: r.n for r in base.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    size = max(s.list_size, -(-sum(sizes.values()) // s.most_lists))
    lists = sum(max(1, n // size) for n in sizes.values())
    some = base.select("embedding").orderBy(F.xxhash64("embedding")).limit(min(s.most_sampled, s.sampled * lists)).toArrow()
    some = vectors(some.column("embedding").combine_chunks(), dim)

    def lifted(v: np.ndarray, band: int) -> np.ndarray:
        """Vectors of a band, scaled to a ball of radius 1, on the sphere one dimension up."""
        v = v / 2.0 ** (band + 0.5)
        return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], 1)

    of_some, graphs, count = bands(some), {}, 0
    for k_band, n in sorted(sizes.items()):
        mine = some[of_some == k_band]
        points = centroids(lifted(mine, k_band), max(1, n // size)) if len(mine) else np.zeros((1, dim + 1))
        graphs[k_band] = (count, Graph.build(points))
        count += len(points)
    del some
    shared = spark.sparkContext.broadcast(graphs)
    known = np.array(sorted(graphs))
    copies, near, most, least, block = s.copies, s.near, s.lists, s.least, s.block

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = vectors(part.column(0), dim)
                band = known[np.minimum(np.searchsorted(known, bands(v)), len(known) - 1)]
                for b in np.unique(band):
                    rows = np.flatnonzero(band == b)
                    start, graph = shared.value[b]
                    found, d = graph.search(lifted(v[rows], b), copies)
                    row, j = np.nonzero(d <= d[:, :1] * near**2 + 1e-12)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows[row])) for c in part.columns), pa.array(start + found[row, j])], ["embedding", "ids", "list"])

    def apart(v: np.ndarray, graphs: dict[int, tuple[int, Graph]]) -> tuple[np.ndarray, np.ndarray]:
        """Of queries, scaled to length 1, and all centroids: squared distances, over the least of the centroid's band, and products."""
        v = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]
        far, product = [], []
        for b, (_, graph) in sorted(graphs.items()):
            d = squared(np.concatenate([v, np.zeros((len(v), 1))], 1), graph.points)
            far.append(d / np.maximum(d.min(1), 1e-12)[:, None])
            product.append(v @ graph.points[:, :-1].T * 2.0 ** (b + 0.5))
        return np.concatenate(far, 1), np.concatenate(product, 1)

    kind = dict(base.dtypes)["embedding"]
    posted = materialize(base.select("embedding", "ids").mapInArrow(index, f"embedding {kind}, ids array<long>, list long"), "lists")
    asked = usable(queries, vec_id, embedding).where(F.size("embedding") == dim).select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    asked = materialize(asked.distinct(), "asked")
    each = materialize(asked.select("embedding").distinct(), "each")
    wide = max(s.ratio**2, widened(posted, scan(base, each.orderBy(F.xxhash64("embedding")).limit(s.tuned), k + 1, dim, s.scanned), lambda v: apart(v, graphs)[0], s.recall))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                far, product = apart(vectors(part.column(0), dim), shared.value)
                first = min(least, product.shape[1])
                ok = (far <= wide + 1e-12) | (product >= -np.partition(-product, first - 1, 1)[:, first - 1 : first])
                row, j = np.nonzero(ok & (ok.sum(1) <= most)[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(j)], ["embedding", "list"])

    seeking = materialize(each.mapInArrow(seek, f"embedding {kind}, list long"), "seeking")

    # Blocks: at most most_lists rows say into how many parts each list and its queries fall.
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    sizes = posted.groupBy("list").agg(F.count("*").alias("n")).join(seeking.groupBy("list").agg(F.count("*").alias("m")), "list")
    sizes = F.broadcast(sizes.select("list", parts("n").alias("n"), parts("m").alias("m")))
    own, every = (lambda n: F.pmod(F.xxhash64("embedding"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    left = posted.join(sizes, "list").select("list", own("n").alias("a"), every("m").alias("b"), "embedding", "ids")
    right = seeking.join(sizes, "list").select("list", every("n").alias("a"), own("m").alias("b"), "embedding")

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("embedding", asked.schema.field("embedding").type), ("found", FOUND)])
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        v, q = (vectors(t.column("embedding").combine_chunks(), dim) for t in (rows, asked))
        out = nearest(v, rows.column("ids").to_pylist(), q, k + 1)
        return pa.Table.from_arrays([asked.column("embedding").combine_chunks(), pa.array(out, FOUND)], schema=schema)

    key = ["list", "a", "b"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"embedding {kind}, found array<struct<less: double, vec_id: long>>")
    best = met.groupBy("embedding").agg(F.flatten(F.collect_list("found")).alias("found"))
    # A class met in several lists has the same product each time, up to rounding: its ids count once.
    best = best.select("embedding", F.explode("found").alias("x")).groupBy("embedding", "x.vec_id").agg(F.min("x.less").alias("less"))
    found = materialize(best.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "vec_id"))), 1, k + 1).alias("found")), "found")
    rest = materialize(each.join(found, "embedding", "left_anti"), "rest")
    found = found.unionByName(scan(base, rest, k + 1, dim, s.scanned))
    each = asked.join(found, "embedding").select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("vec_id")), 1, k).alias("found")
    )
    return each.select("query_id", F.posexplode("found").alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.less")).alias("score")
    )


def exact(df: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """The k nearest rows to one vector by looking at all, for measuring recall."""
    dot = F.aggregate(F.zip_with("embedding", F.lit(query), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    return usable(df, "vec_id", "embedding").select("vec_id", dot.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)
