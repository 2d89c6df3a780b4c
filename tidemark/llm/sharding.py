"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring has 2**bits cells; every shard owns some of them, its virtual nodes, and each virtual node answers for
the cells up to the next one. A key belongs to the cell of its hash. Loads are bounded exactly: the capacities add
up to the number of rows and differ by one at most, and keys that find a shard full go on clockwise, one virtual
node at a time. Keys of one cell, which stand in a fixed order of their own, are alike to this rule, so it is settled
from the counts of the cells alone; these are as many as the ring has cells, whatever the number of rows. The order
within a cell is by a hash of the text's size and CRC first, so rows of one id, or without any, are counted in parts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def ring(shards: int, nodes: int, bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, in ring order. A node whose cell is taken moves to the next free one, so
    further shards never move the nodes of earlier ones."""
    cells, taken = 1 << bits, {}
    if shards * nodes > cells:
        raise ValueError("the ring has fewer cells than virtual nodes")
    for s in range(shards):
        for k in range(nodes):
            at = int.from_bytes(hashlib.sha256(f"{s}:{k}".encode()).digest()[:8], "big") % cells
            while at in taken:
                at = (at + 1) % cells
            taken[at] = s
    return sorted(taken.items())


def settle(counts: dict[int, int], shards: int, nodes: int, bits: int) -> list[tuple[int, int, int, int, int]]:
    """From the rows in each cell: (cell, first, end, shard, slot of first), ranks counted within the cell.

    Keys try the virtual node of their own arc first; whoever finds its shard full tries the next one clockwise,
    all arcs taking a step at a time, in ring order.
    """
    spots, cells = ring(shards, nodes, bits), 1 << bits
    total = sum(counts.values())
    home = [0] * len(spots)
    arcs: list[list[int]] = [[] for _ in spots]
    for a, (at, _) in enumerate(spots):
        stop = spots[(a + 1) % len(spots)][0]
        width = (stop - at) % cells or cells
        arcs[a] = [c for i in range(width) if (c := (at + i) % cells) in counts]
        home[a] = sum(counts[c] for c in arcs[a])
    wanted = [0] * shards
    for a, (_, s) in enumerate(spots):
        wanted[s] += home[a]
    room = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-wanted[s], s))[: total % shards]:
        room[s] += 1
    used = [0] * shards
    given: list[list[tuple[int, int, int, int]]] = [[] for _ in spots]
    waiting = [(a, 0) for a in range(len(spots)) if home[a]]
    hop = 0
    while waiting:
        left = []
        for a, done in waiting:
            s = spots[(a + hop) % len(spots)][1]
            take = min(home[a] - done, room[s] - used[s])
            if take:
                given[a].append((done, done + take, s, used[s]))
                used[s] += take
            if done + take < home[a]:
                left.append((a, done + take))
        waiting, hop = left, hop + 1
    out = []
    for a, parts in enumerate(given):
        start = 0
        for c in arcs[a]:
            end = start + counts[c]
            for lo, hi, s, slot in parts:
                if (x := max(lo, start)) < (y := min(hi, end)):
                    out.append((c, x - start, y - start, s, slot + x - lo))
            start = end
    return out


#: Parts of a cell that are counted apart.
PARTS = 256
PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("cell", "first", "end", "shard", "base")])


def shard(docs: DataFrame, shards: int = 24, nodes: int = 128, bits: int = 14, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ("rows"), shard, slot and grown_shard (null under this law).

    Row counts of the shards differ by one at most and slots run from 0 without gaps. A null text has size 8 and
    the CRC of no bytes; null ids hash like any key. Equal rows are counted before the shuffle and dealt out again
    as so many rows, so a row repeated a great many times meets in no task. An empty table gives an empty table;
    other columns of docs are not read. The driver gets 2**bits counts at most, and the plan that it broadcasts has
    at most 2**bits + shards * (nodes + 1) rows.
    """
    spark = docs.sparkSession
    cell = F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 64 - bits)
    counts = {r[0]: r[1] for r in docs.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(settle(counts, shards, nodes, bits), PLAN)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        cell.alias("cell"),
        F.xxhash64(F.col(doc_id)).alias("position"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    part = F.pmod(F.xxhash64("size", "text_crc32"), F.lit(PARTS)).alias("part")
    key = ["cell", "part"]
    alike = rows.groupBy("cell", part, "position", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    before = Window.partitionBy(*key).orderBy("position", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("cell", part).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    ranked = alike.withColumn("within", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(ahead, key).withColumn("start", F.col("ahead") + F.col("within"))
    each = ranked.withColumn("rank", F.explode(F.sequence("start", F.col("start") + F.col("copies") - 1)))
    here = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    return each.join(F.broadcast(plan), "cell").where(here).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
