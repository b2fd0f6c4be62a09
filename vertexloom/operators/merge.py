"""Merging a secondary graph into a primary one by logical ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_column
from ..sources.ingest import property_
from ..sources.lineage import cut
from .traverse import actions, entities, relationships


@dataclass
class Merge:
    """What a merge makes: new entities, relationships and actions (ready for
    ``mutate.create``), and a one-row table of counts."""

    entities: DataFrame
    relationships: DataFrame
    actions: DataFrame
    report: DataFrame


def logical_id(fields: dict[str, str]) -> Column:
    """The value (as a string; an empty one counts) of each type's id property."""
    name = F.lit(None).cast("string")
    for type_, field in fields.items():
        name = F.when(F.col("type") == type_, F.lit(field)).otherwise(name)
    value = F.get(F.filter("props", lambda p: p["name"] == name), 0)
    return F.when(value["kind"] == "string", value["s"])


def _new_id(family: int, *parts: Column) -> Column:
    """Ids of new nodes: a hash of what makes them, so that a second run gives
    the same."""
    return F.concat(F.lit(str(family)), F.col("type"), F.lit("p"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def merge(primary: DataFrame, secondary: DataFrame, fields: dict[str, str], source: str) -> Merge:
    """Import every entity of ``secondary`` as a new one, and recreate the
    relationships and actions whose ends have logical ids.

    Entities with one (type, logical id) map to the last of them by id.  A
    relationship keeps its type only; an action becomes one action for each
    mapped subject, with the mapped objects.
    """
    tag = F.lit(source)
    src = entities(secondary).withColumn("key", logical_id(fields)).withColumn("new_id", _new_id(1, tag, F.col("id")))
    stays = F.filter("props", lambda p: ~p["name"].isin("source", "migrationUnmapped", "migrationUnmappedReason"))
    unmapped = F.when(F.col("key").isNull(), F.array(property_("migrationUnmapped", F.lit(True), "bool"), property_("migrationUnmappedReason", F.lit("missing uuid field"), "string"))).otherwise(F.array().cast(dict(secondary.dtypes)["props"]))
    imported = src.withColumn("props", F.concat(stays, F.array(property_("source", tag, "string")), unmapped)).withColumn("id", F.col("new_id")).select(primary.columns)
    mapped = src.where("key is not null").groupBy("type", "key").agg(F.max_by("new_id", "id").alias("target"))
    # entities that share a logical id share the target; without one there is none
    ends = cut(src.join(mapped, ["type", "key"], "left").select(F.col("id").alias("end"), "target"))

    r = relationships(secondary).where("subject_id is not null").select("id", "type", "subject_id", "object_id")
    known = ends.select("end").withColumnRenamed("end", "subject_id")
    r = r.join(known, "subject_id", "left_semi")
    r = r.join(ends.select(F.col("end").alias("subject_id"), F.col("target").alias("s")), "subject_id", "left").join(ends.select(F.col("end").alias("object_id"), F.col("target").alias("o")), "object_id", "left")
    made_r = r.where("s is not null and o is not null")

    a = actions(secondary).select("id", "type", F.explode("subject_ids").alias("end"), "object_ids").join(ends, "end").withColumnRenamed("target", "s")
    objects = a.where("s is not null").select("id", F.col("end").alias("subject"), F.explode("object_ids").alias("end")).join(ends, "end", "left").groupBy("id", "subject").agg(F.array_sort(F.collect_set("target")).alias("objects"), F.count_if(F.col("target").isNull()).alias("lost"))
    made_a = a.where("s is not null").join(objects.withColumnRenamed("subject", "end"), ["id", "end"], "left")

    none, empty = F.array().cast("array<string>"), F.array().cast("array<string>")
    blank = {"tags": empty, "tags_fold": empty, "groups": empty, "groups_fold": empty, "props": F.array(property_("source", tag, "string")), "created_date": F.lit(None).cast("timestamp_ntz"), "subject_id": F.lit(None).cast("string"), "object_id": F.lit(None).cast("string"), "subject_ids": none, "object_ids": none}

    def rows(df: DataFrame, family: int, **own: Column) -> DataFrame:
        columns = blank | {"node_class": F.lit(family), "type": F.col("type"), "type_fold": fold_column(F.col("type"))} | own
        return df.select(*(columns[c].alias(c) for c in primary.columns))

    new_r = rows(made_r, 2, id=_new_id(2, tag, F.col("id")), subject_id=F.col("s"), object_id=F.col("o"))
    new_a = rows(made_a, 3, id=_new_id(3, tag, F.col("id"), F.col("end")), subject_ids=F.array("s"), object_ids=F.coalesce("objects", none))

    one = lambda df, **c: df.agg(*(x.alias(n) for n, x in c.items())).withColumn("_one", F.lit(1))
    counts = one(src, imported_entities=F.count(F.lit(1)), unmapped_entities=F.count_if(F.col("key").isNull()))
    counts = counts.join(one(mapped, mapped_entities=F.count(F.lit(1))), "_one")
    counts = counts.join(one(r, recreated_relationships=F.count_if(F.col("s").isNotNull() & F.col("o").isNotNull()), skipped_relationships=F.count_if(F.col("s").isNull() | F.col("o").isNull())), "_one")
    lost = F.coalesce(F.sum("lost"), F.lit(0))
    counts = counts.join(one(made_a, recreated_actions=F.count(F.lit(1)), lost=lost), "_one").join(one(a.where("s is null"), alone=F.count(F.lit(1))), "_one")
    report = counts.select("imported_entities", "mapped_entities", "unmapped_entities", "recreated_relationships", "skipped_relationships", "recreated_actions", (F.col("lost") + F.col("alone")).alias("skipped_actions"))
    return Merge(imported, new_r, new_a, report)
