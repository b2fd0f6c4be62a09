"""Schemas of the graph's tables, and the event kinds of its change feed."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class NodeClass(IntEnum):
    ENTITY = 1
    RELATIONSHIP = 2
    ACTION = 3


PROPERTY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("name_fold", T.StringType()),
        T.StructField("kind", T.StringType()),  # string int double bool date data url null array dict
        T.StructField("s", T.StringType()),
        T.StructField("s_fold", T.StringType()),
        T.StructField("n", T.DoubleType()),
        T.StructField("l", T.LongType()),
        T.StructField("d", T.TimestampNTZType()),
        T.StructField("b", T.BinaryType()),
        T.StructField("j", T.StringType()),
        T.StructField("app_data_version", T.LongType()),
    ]
)
_STRINGS = T.ArrayType(T.StringType())
#: A row per vertex (class 1), binary edge (class 2) or many-party action (class 3).
NODES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("node_class", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("type_fold", T.StringType()),
        T.StructField("created_date", T.TimestampNTZType()),
        T.StructField("tags", _STRINGS),
        T.StructField("tags_fold", _STRINGS),
        T.StructField("groups", _STRINGS),
        T.StructField("groups_fold", _STRINGS),
        T.StructField("props", T.ArrayType(PROPERTY)),
        T.StructField("subject_id", T.StringType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("subject_ids", _STRINGS),
        T.StructField("object_ids", _STRINGS),
    ]
)
#: The append-only log of committed changes.
CHANGES = T.StructType(
    [
        T.StructField("tx", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("author", T.StringType()),
        T.StructField("op", T.StringType()),  # insert update delete
        T.StructField("family", T.IntegerType()),
        T.StructField("part", T.StringType()),  # node property tag group
        T.StructField("object_uri", T.StringType()),
        T.StructField("owner_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("change_index", T.IntegerType()),
    ]
)
#: Event kinds by (operation, family, part), in the order of their rank.
EVENT_KINDS = (
    ("insert", 1, "node", "insertedEntity"),
    ("insert", 1, "property", "addedEntityProperty"),
    ("insert", 1, "tag", "addedEntityTag"),
    ("insert", 1, "group", "addedEntityToGroup"),
    ("update", 1, "property", "updatedEntityProperty"),
    ("delete", 1, "property", "removedEntityProperty"),
    ("delete", 1, "tag", "removedEntityTag"),
    ("delete", 1, "group", "removedEntityFromGroup"),
    ("delete", 1, "node", "deletedEntity"),
    ("insert", 2, "node", "insertedRelationship"),
    ("insert", 2, "property", "addedRelationshipProperty"),
    ("insert", 2, "tag", "addedRelationshipTag"),
    ("insert", 2, "group", "addedRelationshipToGroup"),
    ("update", 2, "node", "updatedRelationship"),
    ("update", 2, "property", "updatedRelationshipProperty"),
    ("delete", 2, "property", "removedRelationshipProperty"),
    ("delete", 2, "tag", "removedRelationshipTag"),
    ("delete", 2, "group", "removedRelationshipFromGroup"),
    ("delete", 2, "node", "deletedRelationship"),
    ("insert", 3, "node", "insertedAction"),
    ("insert", 3, "property", "addedActionProperty"),
    ("insert", 3, "tag", "addedActionTag"),
    ("insert", 3, "group", "addedActionToGroup"),
    ("update", 3, "property", "updatedActionProperty"),
    ("delete", 3, "property", "removedActionProperty"),
    ("delete", 3, "tag", "removedActionTag"),
    ("delete", 3, "group", "removedActionFromGroup"),
    ("delete", 3, "node", "deletedAction"),
)
