"""Mutations as functions from nodes to nodes.

``where`` is a boolean column telling which nodes a mutation is for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_column
from ..schema import NODES, NodeClass


def _words(names: list[str]) -> Column:
    return F.array_distinct(F.array(*map(F.lit, names)).cast("array<string>"))


def add(have: Column, names: list[str]) -> Column:
    return F.array_union(have, _words(names))


def remove(have: Column, names: list[str]) -> Column:
    return F.array_except(have, _words(names))


def toggle(have: Column, names: list[str]) -> Column:
    """What is there goes and what is not comes, for each distinct name."""
    return F.array_union(F.array_except(have, _words(names)), F.array_except(_words(names), have))


def change_labels(nodes: DataFrame, column: str, change: Callable[[Column, list[str]], Column], names: list[str], where: Column) -> DataFrame:
    """``change`` (add, remove or toggle) the tags or groups of some nodes."""
    made = F.when(F.coalesce(where, F.lit(False)), change(F.col(column), names)).otherwise(F.col(column))
    return nodes.withColumn(column, made).withColumn(f"{column}_fold", F.transform(column, fold_column))


def set_property(nodes: DataFrame, made: Column, where: Column) -> DataFrame:
    """Set one property (see ``property_``): the exact name is replaced, else added."""
    kept = F.filter("props", lambda p: p["name"] != made["name"])
    return nodes.withColumn("props", F.when(F.coalesce(where, F.lit(False)), F.concat(kept, F.array(made))).otherwise(F.col("props")))


def delete_property(nodes: DataFrame, name: str, where: Column) -> DataFrame:
    kept = F.filter("props", lambda p: p["name"] != name)
    return nodes.withColumn("props", F.when(F.coalesce(where, F.lit(False)), kept).otherwise(F.col("props")))


def property_value(name: str, slot: str) -> Column:
    """A slot of the first property of that exact name; null if there is none."""
    return F.get(F.filter("props", lambda p: p["name"] == name), 0)[slot]


def set_created_date(nodes: DataFrame, date: Column, where: Column) -> DataFrame:
    return nodes.withColumn("created_date", F.when(F.coalesce(where, F.lit(False)), date.cast("timestamp_ntz")).otherwise(F.col("created_date")))


def set_endpoint(nodes: DataFrame, role: str, entity_id: Column, where: Column) -> DataFrame:
    """Set (or with null clear) a relationship's subject or object."""
    chosen = F.coalesce(where, F.lit(False)) & (F.col("node_class") == int(NodeClass.RELATIONSHIP))
    return nodes.withColumn(f"{role}_id", F.when(chosen, entity_id).otherwise(F.col(f"{role}_id")))


def change_participants(nodes: DataFrame, role: str, change: Callable[[Column, list[str]], Column], ids: list[str], where: Column) -> DataFrame:
    """Add or remove an action's subjects or objects."""
    chosen = F.coalesce(where, F.lit(False)) & (F.col("node_class") == int(NodeClass.ACTION))
    return nodes.withColumn(f"{role}_ids", F.when(chosen, change(F.col(f"{role}_ids"), ids)).otherwise(F.col(f"{role}_ids")))


def create(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """With more nodes (rows of the same schema)."""
    return nodes.unionByName(made.select(*(F.col(f.name).cast(f.dataType) for f in NODES)))


def delete(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the nodes of ``ids(id)``.  A deleted entity takes along every
    relationship and action that it touches; deleted edges take nothing."""
    ids = ids.select("id").distinct()
    left = nodes.join(ids, "id", "left_anti")
    entity_ids = nodes.where(F.col("node_class") == int(NodeClass.ENTITY)).join(ids, "id", "left_semi").select("id")
    ends = F.array_union(F.array_union("subject_ids", "object_ids"), F.array_compact(F.array("subject_id", "object_id")))
    touched = left.where(F.col("node_class") != int(NodeClass.ENTITY)).select(F.col("id").alias("edge"), F.explode(ends).alias("id")).join(entity_ids, "id", "left_semi").select(F.col("edge").alias("id")).distinct()
    return left.join(touched, "id", "left_anti")


def property_text(p: Column) -> Column:
    """A property's value as text; null if it has none."""
    return F.coalesce(p["s"], p["l"].cast("string"), p["n"].cast("string"), p["d"].cast("string"), F.base64(p["b"]), p["j"].cast("string"))


def properties_map() -> Column:
    """Name to value, as text; of repeated names the last counts."""
    names = F.array_distinct(F.transform("props", lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: property_text(F.element_at(F.filter("props", lambda p: p["name"] == n), -1))))


def description() -> Column:
    """One line about a node: its class, id, type, labels, properties, ends and date."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    pairs = F.transform(F.map_entries(properties_map()), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("nil"))))
    ends = F.when(F.col("node_class") == 2, F.concat(F.lit(", subject: "), F.coalesce("subject_id", F.lit("nil")), F.lit(", object: "), F.coalesce("object_id", F.lit("nil"))))
    ends = ends.when(F.col("node_class") == 3, F.concat(F.lit(", subjects: "), listed(F.col("subject_ids")), F.lit(", objects: "), listed(F.col("object_ids")))).otherwise("")
    return F.concat(F.lit("[nodeClass: "), F.col("node_class").cast("string"), F.lit(", id: "), F.col("id"), F.lit(", type: "), F.col("type"), F.lit(", tags: "), listed(F.col("tags")), F.lit(", groups: "), listed(F.col("groups")), F.lit(", properties: "), listed(pairs), ends, F.lit(", createdDate: "), F.coalesce(F.col("created_date").cast("string"), F.lit("nil")), F.lit("]"))
