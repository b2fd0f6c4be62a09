"""One-hop traversals as joins.  Edges and actions link entities by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NodeClass


def entities(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_class") == int(NodeClass.ENTITY))


def relationships(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_class") == int(NodeClass.RELATIONSHIP))


def actions(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_class") == int(NodeClass.ACTION))


def endpoints(nodes: DataFrame) -> DataFrame:
    """Each relationship with its subject's and object's type and id (null if absent)."""
    e = entities(nodes)
    subject = e.select(F.col("id").alias("subject_id"), F.col("type").alias("subject_type"))
    object_ = e.select(F.col("id").alias("object_id"), F.col("type").alias("object_type"))
    return relationships(nodes).select("id", "type", "subject_id", "object_id").join(subject, "subject_id", "left").join(object_, "object_id", "left")


def _touch(nodes: DataFrame, roles: tuple[str, ...], family: str) -> DataFrame:
    """(entity_id, id, type) of edges or actions by the roles an entity has."""
    source = relationships(nodes) if family == "relationship" else actions(nodes)
    parts = []
    for role in roles:
        who = F.col(f"{role}_id") if family == "relationship" else F.explode(f"{role}_ids")
        parts.append(source.select(who.alias("entity_id"), "id", "type").where("entity_id is not null"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).dropDuplicates(["entity_id", "id"])


def relationships_of(nodes: DataFrame, roles: tuple[str, ...] = ("subject", "object"), types: list[str] | None = None) -> DataFrame:
    """(entity_id, id, type) of each entity's relationships in ``roles``; a
    self-loop counts once.  types: exact."""
    found = _touch(nodes, roles, "relationship")
    return found.where(F.col("type").isin(types)) if types is not None else found


def actions_of(nodes: DataFrame, roles: tuple[str, ...] = ("subject", "object"), types: list[str] | None = None) -> DataFrame:
    """The same for actions."""
    found = _touch(nodes, roles, "action")
    return found.where(F.col("type").isin(types)) if types is not None else found


def participants(nodes: DataFrame, role: str, types: list[str] | None = None) -> DataFrame:
    """(action_id, id, type) of the subjects or objects of each action."""
    links = actions(nodes).select(F.col("id").alias("action_id"), F.explode(f"{role}_ids").alias("id")).distinct()
    e = entities(nodes).select("id", "type")
    return links.join(e.where(F.col("type").isin(types)) if types is not None else e, "id")


def distinct_ends(nodes: DataFrame, edges: DataFrame, role: str, types: list[str]) -> DataFrame:
    """Distinct subjects or objects, of exact types, of a set of relationships
    or actions; absent ones are skipped."""
    single = edges.where(F.col("node_class") == int(NodeClass.RELATIONSHIP)).select(F.col(f"{role}_id").alias("id"))
    many = edges.where(F.col("node_class") == int(NodeClass.ACTION)).select(F.explode(f"{role}_ids").alias("id"))
    ids = single.union(many).where("id is not null").distinct()
    return entities(nodes).where(F.col("type").isin(types)).join(ids, "id", "left_semi")


def owners(nodes: DataFrame, details: DataFrame, key: str = "owner_id") -> DataFrame:
    """``details`` with their owner's type; ``missing_owner`` tells dangling ones."""
    found = nodes.select(F.col("id").alias(key), F.col("type").alias("owner_type"))
    return details.join(found, key, "left").withColumn("missing_owner", F.col("owner_type").isNull())
