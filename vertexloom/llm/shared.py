"""Helpers that several operators use: tables, cut lineage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may go without that setting; it gets a temporary
    folder, because its one process is driver and executor at once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks after this point.
    The table stays until ``release``, as results may still read it.
    """
    path = f"{shared_dir(df.sparkSession)}/vertexloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote here; for when results that
    came from them are written or no longer needed."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start as ``names`` and clash with none of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(texts: list, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``most`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes from
    here on, so that a task holds some megabytes at once in the JVM and in
    Python.  A session's own smaller number of rows stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def hot_join(rows: DataFrame, table: DataFrame, key: str, size: str, most: int, spread: str | list[str], salts: int = 32) -> DataFrame:
    """``rows`` joined with ``table`` (one row a ``key``) on ``key``, no task
    taking all rows of a frequent one.

    size: how many of ``rows`` have the key.  Keys with more than ``most`` are
    dealt by a hash of the columns ``spread`` to ``salts`` tasks, which their row
    of ``table`` is copied to.  Which keys these are is broadcast; they are at
    most rows / most, so a ``most`` that grows with the rows bounds their number.
    """
    salt, hot = fresh(rows, "_salt", "_hot")
    keys = table.where(F.col(size) > most).select(key, F.lit(True).alias(hot))
    dealt = rows.join(F.broadcast(keys), key, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread)), F.lit(salts)).cast("int")).otherwise(0)).drop(hot)
    copies = F.when(F.col(size) > most, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn(salt, F.explode(copies)), [key, salt]).drop(salt)


#: Least degree of a hub, and the most hubs there can be: 2 * edges / (edges * 2 / HUBS).
HUB, HUBS = 100_000, 2000


def _with_least(rows: DataFrame, key: str, value: str, most: int | None) -> DataFrame:
    """``rows`` and the least ``value`` of their ``key`` as column m.

    Minima are aggregated before the shuffle.  Keys with more than ``most``
    rows (at most ``HUBS``) have their minimum broadcast, so their rows stay
    where they are; the others are joined.  most: null if no key has so many.
    """
    if most is None:
        return rows.join(rows.groupBy(key).agg(F.min(value).alias("m")), key)
    least = rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("d"))
    hubs = least.where(F.col("d") > most).select(key, F.col("m").alias("hub"))
    tagged = rows.join(F.broadcast(hubs), key, "left")
    rest = tagged.where("hub is null").drop("hub").join(least.where(F.col("d") <= most).drop("d"), key)
    return tagged.where("hub is not null").withColumnRenamed("hub", "m").unionByName(rest)


def connected_components(edges: DataFrame, *, hub: int = HUB) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component
    is its smallest node.

    Alternating large-star and small-star steps: every step replaces edges by
    edges to the smallest neighbour, until all are stars.  Each round is
    written to the shared folder; the driver sees a count and one checksum.
    """
    now = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    mark = _checksum(now)
    while True:
        most = max(hub, 2 * mark[0] // HUBS) if mark[0] > hub else None
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _with_least(both, "u", "v", most).where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        small = _with_least(large, "hi", "lo", most)
        after = materialize(small.select("hi", F.col("m").alias("lo")).union(small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct().select("lo", "hi"))
        if (new := _checksum(after)) == mark:
            roots = after.select("lo").distinct()
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.select("lo", "lo"))
        now, mark = after, new


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first())
