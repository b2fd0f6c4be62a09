"""Versioned snapshots of a graph, with optimistic transactions.

A store is a folder: ``v=N-S`` holds the snapshot of the nodes that try S wrote,
``changes/v=N-S`` what it changed, and ``_versions/N.json`` publishes version N
by naming both, so a version and its changes are there together or not at all.
Publishing creates that file and fails if it is there, so of two writers that
started from one version only the first commits.  All access is by Spark or by
Hadoop's file system; the store needs one that creates a file only if it is not
there (HDFS and local disks do, plain object stores do not).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHANGES, NODES


class StoreError(Exception):
    """Why a store can't be opened or written; the store is left as it was."""


class StoreChanged(StoreError):
    """Another writer committed first."""


class StoreBusy(StoreError):
    """A transaction or a purge is under way."""


class Files:
    """The few operations on a folder that a store needs, on any file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = True) -> bool:
        """False if the file is there and may not be replaced."""
        try:
            stream = self.fs.create(self.at(name), replace)
        except Exception as e:
            if not replace and self.exists(name):
                return False
            raise StoreError(f"can't write {name}") from e
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class GraphStore:
    """``GraphStore.open(spark, path)``; see the module for the layout."""

    def __init__(self, spark: SparkSession, path: str, author: str):
        self.spark, self.path, self.author = spark, path.rstrip("/"), author
        self.files = Files(spark, path)
        self._busy = self._reading = False

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, author: str = "me", preflight: Callable[[], None] | None = None) -> GraphStore:
        """Open or create a store; an error of ``preflight`` leaves it untouched."""
        if preflight is not None:
            preflight()
        store = cls(spark, path, author)
        if not store.files.exists("_versions") or not store.files.names("_versions"):
            store._publish(spark.createDataFrame([], NODES), None, 0)
        return store

    @property
    def version(self) -> int:
        return max(int(n.split(".")[0]) for n in self.files.names("_versions") if n.endswith(".json"))

    def nodes(self, version: int | None = None) -> DataFrame:
        """A committed snapshot (the newest): it never changes once read."""
        v = self.version if version is None else version
        # each try writes a folder of its own; the published one is the version's
        return self.spark.read.schema(NODES).parquet(f"{self.path}/{json.loads(self.files.read(f'_versions/{v}.json'))['data']}")

    def changes(self, after: int = -1) -> DataFrame:
        """The change rows of the published versions above ``after``."""
        told = [json.loads(self.files.read(f"_versions/{v}.json")) for v in range(max(after + 1, 0), self.version + 1) if self.files.exists(f"_versions/{v}.json")]
        logs = [f"{self.path}/{t['changes']}" for t in told if "changes" in t]
        if not logs:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*logs).where(F.col("tx") > after)

    def _publish(self, nodes: DataFrame, before: DataFrame | None, version: int) -> None:
        stamp = time.time_ns()
        data = f"v={version}-{stamp}"
        nodes.select(*(F.col(f.name).cast(f.dataType) for f in NODES)).write.partitionBy("node_class").parquet(f"{self.path}/{data}")
        told = {"data": data, "author": self.author, "stamp": stamp}
        if before is not None:
            told["changes"] = f"changes/{data}"
            diff(before, self.spark.read.schema(NODES).parquet(f"{self.path}/{data}"), version, self.author).write.parquet(f"{self.path}/{told['changes']}")
        if not self.files.write(f"_versions/{version}.json", json.dumps(told), replace=False):
            self.files.delete(data)
            self.files.delete(f"changes/{data}")
            raise StoreChanged(f"version {version} was committed by another writer")

    def transaction(self, body: Callable[[DataFrame], DataFrame]) -> int:
        """Commit what ``body`` makes of a pinned snapshot; the new version.

        Raises StoreChanged if the store moved on meanwhile, and whatever
        ``body`` raises; nothing is changed then.  Not reentrant.
        """
        if self._busy:
            raise StoreBusy("a transaction is open")
        self._busy = True
        try:
            start = self.version
            before = self.nodes(start)
            self._publish(body(before), before, start + 1)
            return start + 1
        finally:
            self._busy = False

    save = transaction

    def read_snapshot(self, body: Callable[[DataFrame], object]):
        """What ``body`` makes of one pinned snapshot; not within another one."""
        if self._reading:
            raise StoreBusy("a snapshot is being read")
        self._reading = True
        try:
            return body(self.nodes(self.version))
        finally:
            self._reading = False

    def clear(self) -> int:
        """Delete every node, as a version of its own."""
        return self.transaction(lambda nodes: nodes.where("false"))

    def reset(self, before: Callable[[str], None]) -> None:
        """Remove the store, once ``before`` has returned."""
        if self._busy:
            raise StoreBusy("the store is in use")
        before(self.path)
        self.files.delete("")

    def purge(self, drop: Callable[[], object], pending: Callable[[DataFrame], DataFrame] | None = None):
        """Drop the remote copy by ``drop``, one purge at a time: what is
        pending is committed first, and transactions are refused until the end."""
        if self._busy:
            raise StoreBusy("a transaction or a purge is under way")
        if pending is not None:
            self.transaction(pending)
        self._busy = True
        try:
            return drop()
        finally:
            self._busy = False

    def export(self, to: str) -> None:
        """Copy the newest snapshot to a folder of its own."""
        self.nodes().write.mode("errorifexists").parquet(to)

    # metadata beside the snapshots
    def _metadata(self) -> dict:
        return json.loads(self.files.read("_metadata.json")) if self.files.exists("_metadata.json") else {}

    def keys(self) -> list[str]:
        return sorted(self._metadata())

    def value(self, key: str, default=None):
        return self._metadata().get(key, default)

    def set_value(self, key: str, value) -> None:
        """Set, or with None remove, a value."""
        kept = {k: v for k, v in self._metadata().items() if k != key}
        self.files.write("_metadata.json", json.dumps(kept if value is None else kept | {key: value}, sort_keys=True))

    @staticmethod
    def needs_upgrade(current: tuple[int | None, int | None], required: tuple[int | None, int | None]) -> bool:
        """Whether a version is below what is required (none counts as 0)."""
        return any((c or 0) < (r or 0) for c, r in zip(current, required))


def _parts(nodes: DataFrame) -> DataFrame:
    """(uri, family, part, owner_id, name, value) of nodes and their details."""
    own = nodes.select("id", "node_class", "props", "tags", "groups", F.to_json(F.struct("subject_id", "object_id")).alias("ends"))
    uri = lambda part, name: F.concat(F.lit(f"{part}/"), F.col("id"), *([F.lit("/"), name] if name is not None else []))
    rows = [own.select(uri("node", None).alias("object_uri"), F.col("node_class").alias("family"), F.lit("node").alias("part"), F.col("id").alias("owner_id"), F.lit(None).cast("string").alias("name"), F.when(F.col("node_class") == 2, F.col("ends")).alias("value"))]
    for part, items in (("tag", "tags"), ("group", "groups")):
        rows.append(own.select("id", "node_class", F.explode(F.array_distinct(items)).alias("x")).select(uri(part, F.col("x")), "node_class", F.lit(part), "id", "x", F.lit(None).cast("string")))
    p = own.select("id", "node_class", F.explode("props").alias("p"))
    slots = F.to_json(F.struct("p.kind", "p.s", "p.n", "p.l", "p.d", "p.b", "p.j"))
    rows.append(p.select(uri("property", F.col("p.name")), "node_class", F.lit("property"), "id", "p.name", slots))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def diff(before: DataFrame, after: DataFrame, tx: int, author: str | None) -> DataFrame:
    """Change rows that lead from one snapshot to the next."""
    old, new = _parts(before), _parts(after)
    keys = ["object_uri", "family", "part", "owner_id", "name"]
    o = old.select("object_uri", F.struct(*keys[1:], "value").alias("o"))
    n = new.select("object_uri", F.struct(*keys[1:], "value").alias("n"))
    both = o.join(n, "object_uri", "full_outer")
    op = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(~F.col("o.value").eqNullSafe(F.col("n.value")), "update")
    side = F.coalesce("n", "o")
    made = both.withColumn("op", op).where("op is not null").withColumn("x", side)
    return made.select(F.lit(tx).cast("long").alias("tx"), F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.lit(author).cast("string").alias("author"), "op", F.col("x.family").alias("family"), F.col("x.part").alias("part"), "object_uri", F.col("x.owner_id").alias("owner_id"), F.col("x.name").alias("name"), F.col("x.value").alias("value"), F.pmod(F.hash("object_uri"), F.lit(1 << 30)).cast("int").alias("change_index"))


def open_or_local(spark: SparkSession, remote: str, local: str, *, author: str = "me", warn: Callable[[Exception], None] | None = None) -> tuple[GraphStore, str]:
    """The store at ``remote`` and ``remote``; if that can't be opened, the one
    at ``local`` and ``localFallback``, after ``warn`` was told why."""
    try:
        return GraphStore.open(spark, remote, author=author), "remote"
    except Exception as error:  # whatever the file system or Spark raises
        if warn is not None:
            warn(error)
        return GraphStore.open(spark, local, author=author), "localFallback"
