"""New nodes, one at a time or from rows: what ``mutate.create`` takes."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import fold
from ..schema import NODES, NodeClass


def _row(family: NodeClass, type_: str, key: str | None, **own) -> dict:
    base = {"id": f"{int(family)}{type_}p{key or uuid.uuid4().hex}", "node_class": int(family), "type": type_, "type_fold": fold(type_), "created_date": dt.datetime.now(dt.UTC).replace(tzinfo=None), "tags": [], "tags_fold": [], "groups": [], "groups_fold": [], "props": [], "subject_id": None, "object_id": None, "subject_ids": [], "object_ids": []}
    return base | own


def entity(type_: str, key: str | None = None) -> dict:
    return _row(NodeClass.ENTITY, type_, key)


def relationship(type_: str, subject: str | None = None, object_: str | None = None, key: str | None = None) -> dict:
    return _row(NodeClass.RELATIONSHIP, type_, key, subject_id=subject, object_id=object_)


def relate(subject: dict, object_: dict) -> dict:
    """A relationship of the subject's own type."""
    return relationship(subject["type"], subject["id"], object_["id"])


def action(type_: str, subjects: list[str] = (), objects: list[str] = (), key: str | None = None) -> dict:
    return _row(NodeClass.ACTION, type_, key, subject_ids=list(dict.fromkeys(subjects)), object_ids=list(dict.fromkeys(objects)))


def rows(spark: SparkSession, *made: dict) -> DataFrame:
    return spark.createDataFrame([tuple(m[f.name] for f in NODES) for m in made], NODES)
