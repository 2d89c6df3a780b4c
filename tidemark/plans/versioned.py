"""Versioned Parquet tables: snapshots, branches, scoped compaction, validation, merge, collection.

Layout under a root: ``data/`` holds Parquet files that are never changed, ``log/<snapshot>/`` the list of a snapshot's files
(partition, path, rows, bytes), ``snapshots/`` one row for each snapshot, ``refs/<branch>/<number>`` the snapshots that a
branch has pointed to, the highest number the present one. A branch moves only from the snapshot that its writer
started from: the next number can be taken once, by a rename that never overwrites (HDFS) or a hard link (local disks).
A store with neither needs a catalog service in its place.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators import health as measures
from tidemark.operators import inventory

FILES = T.StructType([T.StructField("partition", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType())])
SNAPSHOT = "snapshot_id string, parent_id string, committed_at double, operation string, summary map<string, string>"


class Conflict(Exception):
    """The branch has moved since the writer looked."""


@dataclass
class VersionedTable:
    spark: SparkSession
    root: str
    partition: str | None = None  #: the column that files are grouped by

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    # Branches.

    def branches(self) -> dict[str, str]:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/refs")):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/refs")) if s.isDirectory()]
        return {n: self._text(path(f"{self.root}/refs/{n}/{number:012d}")) for n in names if (number := self._number(n))}

    def _number(self, branch: str) -> int:
        """How often the branch has moved; 0 if there is none."""
        fs, path = self._fs()
        place = path(f"{self.root}/refs/{branch}")
        return max([int(s.getPath().getName()) for s in fs.listStatus(place) if s.getPath().getName().isdigit()], default=0) if fs.exists(place) else 0

    def _text(self, path) -> str:
        stream = self._fs()[0].open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def head(self, branch: str = "main") -> str | None:
        number = self._number(branch)
        return self._text(self._fs()[1](f"{self.root}/refs/{branch}/{number:012d}")) if number else None

    def move(self, branch: str, expected: str | None, snapshot: str) -> None:
        """Points a branch to a snapshot if it still points to the expected one, or raises Conflict."""
        fs, path = self._fs()
        number = self._number(branch)
        now = self._text(path(f"{self.root}/refs/{branch}/{number:012d}")) if number else None
        if now != expected:
            raise Conflict(f"{branch} points to {now}, not to {expected}")
        new, ref = path(f"{self.root}/refs/.{uuid.uuid4().hex}"), path(f"{self.root}/refs/{branch}/{number + 1:012d}")
        fs.mkdirs(ref.getParent())
        stream = fs.create(new, False)
        stream.write(bytearray(snapshot.encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(new.toUri().getPath(), ref.toUri().getPath())
            else:
                jvm = self.spark._jvm.org.apache.hadoop.fs
                once = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
                once[0] = jvm.Options.Rename.NONE
                jvm.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, ref, once)
        except FileExistsError as e:
            raise Conflict(f"{branch} has moved from {expected}") from e
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{branch} has moved from {expected}") from e
            raise
        finally:
            fs.delete(new, False)

    def branch(self, name: str, source: str = "main") -> str:
        head = self.head(source)
        self.move(name, None, head)
        return head

    def drop_branch(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/refs/{name}"), True)

    # Reading.

    def snapshots(self) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT).json(f"{self.root}/snapshots")

    def files(self, snapshot: str | None) -> DataFrame:
        if snapshot is None:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.root}/log/{snapshot}")

    def read(self, branch: str = "main", snapshot: str | None = None) -> DataFrame:
        """A branch's rows, or those of one snapshot."""
        snapshot = snapshot or self.head(branch)
        names = [r.path for r in self.files(snapshot).select("path").collect()]
        if not names:
            raise ValueError("the table has no rows yet")
        return self.spark.read.parquet(*(f"{self.root}/{n}" for n in names))

    # Writing.

    def _write(self, df: DataFrame) -> DataFrame:
        """Writes rows as new files and returns what the log says of them."""
        place = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{place}")
        by = F.col(self.partition).cast("string") if self.partition else F.lit(None).cast("string")
        found = self.spark.read.schema(df.schema).parquet(f"{self.root}/{place}").select(by.alias("partition"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
        each = found.groupBy("name", "partition").agg(F.count("*").alias("rows"), F.max("size").alias("bytes"))
        return each.select("partition", F.concat(F.lit(place + "/"), "name").alias("path"), "rows", "bytes")

    def commit(self, files: DataFrame, branch: str, parent: str | None, operation: str) -> str:
        """A new snapshot with these files, to which the branch moves."""
        snapshot = uuid.uuid4().hex
        files.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in FILES)).coalesce(1).write.parquet(f"{self.root}/log/{snapshot}")
        total = self.files(snapshot).agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        summary = {"total-records": str(total.rows), "total-data-files": str(total.files), "manifests-created": "1" if total.files else "0"}
        row = {"snapshot_id": snapshot, "parent_id": parent, "committed_at": time.time(), "operation": operation, "summary": summary}
        fs, path = self._fs()
        stream = fs.create(path(f"{self.root}/snapshots/{snapshot}.json"), False)
        stream.write(bytearray((json.dumps(row) + "\n").encode()))
        stream.close()
        self.move(branch, parent, snapshot)
        return snapshot

    def append(self, df: DataFrame, branch: str = "main") -> str:
        """Adds rows; with a partition column, each file holds rows of one partition."""
        parent = self.head(branch)
        if self.partition:
            df = df.repartition(self.partition).sortWithinPartitions(self.partition)
            place = self._split(df)
        else:
            place = self._write(df)
        return self.commit(self.files(parent).unionByName(place), branch, parent, "append")

    def _split(self, df: DataFrame, key: str = "_part") -> DataFrame:
        """Files by partition, or by a column that isn't kept: written below key=value folders."""
        place = f"data/{uuid.uuid4().hex}"
        by = F.col(self.partition).cast("string") if self.partition else F.lit(None).cast("string")
        df = df if key in df.columns else df.withColumn(key, by)
        df.write.partitionBy(key).parquet(f"{self.root}/{place}")
        found = self.spark.read.schema(df.drop(key).schema).parquet(f"{self.root}/{place}")
        found = found.select(by.alias("partition"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        each = found.groupBy("partition", "path").agg(F.count("*").alias("rows"), F.max("size").alias("bytes"))
        return each.select("partition", F.concat(F.lit(place), F.substring_index("path", place, -1)).alias("path"), "rows", "bytes")

    def append_fragmented(self, df: DataFrame, files: int, branch: str = "main") -> str:
        """Adds rows as up to ``files`` files in each partition, for trying out compaction."""
        parent = self.head(branch)
        return self.commit(self.files(parent).unionByName(self._split(df.repartition(files))), branch, parent, "append")

    # Maintenance.

    def health(self, branch: str = "main") -> DataFrame:
        return measures.health(self.files(self.head(branch)))

    def plan(
        self, branch: str = "main", target: int = 128 * measures.MB, n: int = 100, least_files: int = 2, threshold: float = 0.5, only: Sequence[str] | None = None
    ) -> DataFrame:
        """partition, path, bytes, bin: what a compaction would rewrite, without doing it. The worst n partitions, of those
        that ``only`` names if it is given."""
        scored = measures.scored(self.health(branch), target, least_files, threshold)
        worst = measures.worst(scored if only is None else measures.only_partitions(scored, "partition", only), n)
        chosen = self.files(self.head(branch)).join(F.broadcast(worst.select("partition")), "partition", "left_semi")
        return measures.bins(chosen, target)

    def compact(self, branch: str = "main", **planned) -> dict:
        """Rewrites what plan() names, one file for each bin, all in one job; compares the rows of the files that it replaces
        with those of the new ones, and commits where ``branch`` has not moved meanwhile. Other files are neither read nor
        changed; on any failure ``branch`` stays as it was."""
        before = self.head(branch)
        beside = F.count("*").over(Window.partitionBy("partition", "bin"))
        planned_files = self.plan(branch, **planned).withColumn("beside", beside).collect()  # of n partitions at most
        chosen = [r for r in planned_files if r.beside > 1]
        numbers = {k: i for i, k in enumerate(sorted({(r.partition, r.bin) for r in chosen}, key=str))}
        rows = {r.path: numbers[r.partition, r.bin] for r in chosen}
        partitions = len({r.partition for r in planned_files})
        if not rows:
            return {"before": before, "after": before, "partitions": partitions, "files_rewritten": 0}
        old = self.spark.read.parquet(*(f"{self.root}/{p}" for p in rows))
        place = self.root.removeprefix("file://").rstrip("/") + "/"
        bins = self.spark.createDataFrame(list(rows.items()), "_path string, _bin int")
        named = old.withColumn("_path", F.substring_index("_metadata.file_path", place, -1)).join(F.broadcast(bins), "_path").drop("_path")
        files = self._split(named.repartition("_bin").sortWithinPartitions("_bin"), "_bin")
        written = files.collect()  # one for each bin
        files = self.spark.createDataFrame(written, FILES)
        new = self.spark.read.schema(old.schema).parquet(*(f"{self.root}/{r.path}" for r in written))
        if not inventory.same_rows(old, new):
            raise ValueError("rows differ after compaction")
        kept = self.files(before).join(F.broadcast(bins.select(F.col("_path").alias("path"))), "path", "left_anti").select(*FILES.names)
        after = self.commit(kept.unionByName(files), branch, before, "replace")
        return {"before": before, "after": after, "partitions": partitions, "files_rewritten": len(rows)}

    def rewrite_log(self, branch: str = "main") -> str:
        """A snapshot with the same files whose list is one file in order."""
        parent = self.head(branch)
        return self.commit(self.files(parent).orderBy("partition", "path"), branch, parent, "rewrite-log")

    def garbage(self, grace_seconds: float = 3600) -> DataFrame:
        """path of each stored file that no branch's history within the grace period and no branch's head refers to. Files
        younger than the grace period are left alone: a writer may be about to commit them."""
        heads = list(set(self.branches().values()))
        if not heads:
            raise RuntimeError("no branch can be read, so nothing is known to be garbage")
        now = time.time()
        live = self.snapshots().where(F.col("snapshot_id").isin(heads) | (F.col("committed_at") > now - grace_seconds)).select("snapshot_id").collect()
        reachable = None
        for r in live:
            part = self.files(r.snapshot_id).select("path")
            reachable = part if reachable is None else reachable.unionByName(part)
        place = self.root.removeprefix("file://").rstrip("/") + "/"
        stored = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data")
        stored = stored.where(F.unix_timestamp("modificationTime") < F.lit(now - grace_seconds)).select(F.substring_index("path", place, -1).alias("path"))
        return stored.join(reachable, "path", "left_anti") if reachable is not None else stored

    def collect_garbage(self, grace_seconds: float = 3600) -> int:
        """Deletes garbage(); how many files went."""
        fs, path = self._fs()
        gone = 0
        for r in self.garbage(grace_seconds).toLocalIterator():
            gone += bool(fs.delete(path(f"{self.root}/{r.path}"), False))
        return gone
