"""Payload scan: what the stored property payloads are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import data_kind


def decodes(p: Column) -> Column:
    """Whether the slot of a property's kind holds a value; bytes of any
    content do, and null needs none."""
    kind = p["kind"]
    slot = F.when(kind.isin("string", "url"), p["s"].isNotNull()).when(kind.isin("int", "double", "bool"), p["n"].isNotNull()).when(kind == "date", p["d"].isNotNull()).when(kind.isin("array", "dict"), p["j"].isNotNull()).when(kind == "data", F.lit(True))
    return kind.isNull() | (kind == "null") | F.coalesce(slot, F.lit(False))


def payloads(nodes: DataFrame, sample: int | None = None) -> DataFrame:
    """(family, name, kind, outcome, data_kind) of every property; ``sample``
    limits the properties of each family, as a diagnostic."""
    p = nodes.select("node_class", F.explode("props").alias("p")).select("node_class", "p.*", decodes(F.col("p")).alias("_ok"))
    if sample is not None:
        parts = [p.where(f"node_class = {c}").limit(sample) for c in (1, 3, 2)]
        p = parts[0].union(parts[1]).union(parts[2])
    kind = data_kind(F.col("b"))
    raw = kind.isin("PNG (raw)", "PDF (raw)", "JPEG (raw)")
    of_data = F.when(F.col("b").isNull(), "nil").when(raw, "raw_ok").otherwise("ok")
    outcome = F.when(F.col("kind").isNull() | (F.col("kind") == "null"), "nil").when(F.col("kind") == "data", of_data).when(F.col("_ok"), "ok").otherwise("failure")
    return p.select(F.col("node_class").alias("family"), "name", "kind", outcome.alias("outcome"), F.when(F.col("b").isNotNull(), kind).alias("data_kind"))


def failures(scanned: DataFrame) -> DataFrame:
    """(name, n): how many payloads of each property do not decode."""
    return scanned.where("outcome = 'failure'").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


def nested(nodes: DataFrame) -> DataFrame:
    """(kind, n): properties that hold an array or a dictionary."""
    return nodes.select(F.explode("props").alias("p")).where(F.col("p.kind").isin("array", "dict")).groupBy(F.col("p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def emptiness(nodes: DataFrame) -> DataFrame:
    """One row: entities, relationships, actions, and whether there is nothing."""
    n = lambda c: F.count_if(F.col("node_class") == c)
    return nodes.agg(n(1).alias("entities"), n(2).alias("relationships"), n(3).alias("actions"), (F.count(F.lit(1)) == 0).alias("empty"))


def totals(scanned: DataFrame) -> DataFrame:
    """One row: total, and how many are ok, failures, raw_ok and nil (these add up)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return scanned.agg(F.count(F.lit(1)).alias("total"), n("ok").alias("ok"), n("failure").alias("failures"), n("raw_ok").alias("raw_ok"), n("nil").alias("nil"))


def histogram(scanned: DataFrame, column: str) -> DataFrame:
    """Counts of ``name``, ``kind`` or ``data_kind``, most frequent first."""
    return scanned.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
