"""Cutting a plan's lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the checkpoint folder.  The folder is what the
    cluster names in spark.checkpoint.dir; only a local session without one
    gets a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vertexloom-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the place (from 0) of each row in ``order`` as ``name``.

    Rows are dealt by ranges and sorted there, so no task sorts them all; the
    driver sees one count a range."""
    bits = 33
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part, sizes, at = F.shiftright(F.col(name), bits), [], 0
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        sizes.append((r["p"], at))
        at += r["count"]
    before = F.broadcast(df.sparkSession.createDataFrame(sizes, "_part long, _before long"))
    return placed.join(before, part == F.col("_part")).withColumn(name, F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << bits) - 1))).drop("_part", "_before")
