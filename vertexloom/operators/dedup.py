"""Deduplication of entities by a key, with their links rewired.

Everything is set-oriented: groups are aggregates, the map from duplicates to
survivors is a table, and links are rewired by joins with it.  Orders the
result depends on are string orders of ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_column
from ..sources.lineage import cut
from .mutate import delete
from .traverse import actions, entities, relationships

POLICIES = ("rewire_and_deduplicate", "rewire_only", "skip", "fail")


class UnkeyedEntities(ValueError):
    pass


class UnresolvedLink(ValueError):
    pass


def field_key(fields_: dict[str, str], namespace: str = "uuid") -> Column:
    """(type, namespace, value) by one string property a type; null where it is
    missing, empty or no string."""
    field = F.lit(None).cast("string")
    for type_, name in fields_.items():
        field = F.when(F.col("type") == type_, F.lit(name)).otherwise(field)
    value = F.get(F.filter("props", lambda p: p["name"] == field), 0)
    text = F.when((value["kind"] == "string") & (value["s"] != ""), value["s"])
    return F.when(text.isNotNull(), F.struct(F.col("type").alias("type"), F.lit(namespace).alias("namespace"), text.alias("value")))


def keyed(nodes: DataFrame, key: Column) -> DataFrame:
    return entities(nodes).withColumn("key", key)


def duplicate_groups(nodes: DataFrame, key: Column) -> DataFrame:
    """(type, namespace, value, members) of keys with several entities."""
    return keyed(nodes, key).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key.*", "members").orderBy("type", "namespace", "value")


class InvalidSurvivor(ValueError):
    pass


def chosen(nodes: DataFrame, key: Column, values: dict[str, Column], choose: Callable[[dict, dict], dict]) -> DataFrame:
    """(id, survivor) for each duplicate; the survivor of a group is the left
    fold of ``choose`` over its members in the order of ids.

    A member is a dictionary of its id and ``values``.  A fold that is not
    associative needs a group's members one after another, so each group is one
    task's stream of these few values; a rule that is an order is better given
    to ``replacements``.  Raises InvalidSurvivor if neither member is chosen.
    """
    members = keyed(nodes, key).where("key is not null").select("id", "key", *(c.alias(n) for n, c in values.items()))
    doubled = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "key").drop("_n")

    def fold(_, group):
        rows = group.drop_columns(["key"]).sort_by("id").to_pylist()
        best = rows[0]
        for row in rows[1:]:
            found = choose(best, row)
            if found is None or found.get("id") not in (best["id"], row["id"]):
                raise InvalidSurvivor(f"neither {best['id']} nor {row['id']} was chosen")
            best = best if found["id"] == best["id"] else row
        gone = [r["id"] for r in rows if r["id"] != best["id"]]
        return pa.table({"id": pa.array(gone, pa.string()), "survivor": pa.array([best["id"]] * len(gone), pa.string())})

    fold.__annotations__ = {"_": tuple[pa.Scalar, ...], "group": pa.Table, "return": pa.Table}
    return doubled.groupBy("key").applyInArrow(fold, "id string, survivor string")


def replacements(nodes: DataFrame, key: Column, prefer: list[Column] | None = None) -> DataFrame:
    """(id, survivor) for each duplicate.  The survivor is the first of its
    group by ``prefer``, then by id."""
    members = keyed(nodes, key).where("key is not null").select("id", "key", *((c.alias(f"o{i}")) for i, c in enumerate(prefer or [])))
    order = [f"o{i}" for i in range(len(prefer or []))]
    # the best of a group by a partial aggregate, so that a large group needs no window in one task
    best = members.groupBy("key").agg(F.min(F.struct(*order, "id")).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.col("best.id").alias("survivor"))
    return members.join(best, "key").where("id <> survivor").select("id", "survivor")


def merged_metadata(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, props, tags, groups, copied) of each survivor: its own properties
    stay, missing ones come from the first duplicate (by id) that has them, tags
    and groups are joined.  copied: number of properties that came."""
    e = entities(nodes).select("id", "props", "tags", "groups")
    own = e.join(mapping.select(F.col("survivor").alias("id")).distinct(), "id", "left_semi").withColumn("survivor", F.col("id"))
    pool = own.unionByName(e.join(mapping, "id")).withColumn("rank", F.when(F.col("id") == F.col("survivor"), F.struct(F.lit(0).alias("r"), F.col("id"))).otherwise(F.struct(F.lit(1).alias("r"), F.col("id"))))
    best = pool.select("survivor", "rank", F.explode("props").alias("p")).groupBy("survivor", "p.name").agg(F.min_by("p", "rank").alias("p"), F.min("rank.r").alias("r"))
    props = best.groupBy("survivor").agg(F.array_sort(F.collect_list("p"), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)).alias("props"), F.sum("r").alias("copied"))
    labels = pool.groupBy("survivor").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("groups")))).alias("groups"))
    return labels.join(props, "survivor", "left").select(F.col("survivor").alias("id"), F.coalesce("props", F.array().cast(dict(nodes.dtypes)["props"])).alias("props"), "tags", "groups", F.coalesce("copied", F.lit(0)).alias("copied"))


def merged_by(nodes: DataFrame, mapping: DataFrame, values: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """(id, ``merge``) of each survivor: the caller's own aggregates over
    ``values`` of it and its duplicates.  ``is_survivor`` tells them apart."""
    e = entities(nodes).select("id", *(c.alias(n) for n, c in values.items()))
    own = e.join(mapping.select(F.col("survivor").alias("id")).distinct(), "id", "left_semi").withColumn("survivor", F.col("id"))
    pool = own.unionByName(e.join(mapping, "id")).withColumn("is_survivor", F.col("id") == F.col("survivor"))
    return pool.groupBy("survivor").agg(*(c.alias(n) for n, c in merge.items())).withColumnRenamed("survivor", "id")


def rewired_relationships(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each relationship with both ends: (id, type, subject_id, object_id,
    changed, first); first: it is the one of its (type, ends) that stays."""
    full = relationships(nodes).where("subject_id is not null and object_id is not null").select("id", "type", "subject_id", "object_id")
    s, o = mapping.select(F.col("id").alias("subject_id"), F.col("survivor").alias("s")), mapping.select(F.col("id").alias("object_id"), F.col("survivor").alias("o"))
    moved = full.join(s, "subject_id", "left").join(o, "object_id", "left").select("id", "type", F.coalesce("s", "subject_id").alias("subject_id"), F.coalesce("o", "object_id").alias("object_id"), (F.col("s").isNotNull() | F.col("o").isNotNull()).alias("changed"))
    return _with_first(moved, "type", "subject_id", "object_id")


def _with_first(moved: DataFrame, *key: str) -> DataFrame:
    """``moved`` with ``first``: whether the row has the least id of its key.
    Least ids are aggregated before the shuffle and joined by id, so the rows
    of a frequent key never meet in one task."""
    least = moved.groupBy(*key).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_first"))
    return moved.join(least, "id", "left").withColumn("first", F.coalesce("_first", F.lit(False))).select(*moved.columns, "first")


def rewired_actions(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """The same for actions: (id, type, subject_ids, object_ids, changed,
    first).  Keys are sorted lists with repeats; stored members have none."""
    a = actions(nodes).select("id", "type", "subject_ids", "object_ids")
    m = mapping.withColumnRenamed("id", "member")
    links = a.select("id", F.explode("subject_ids").alias("member"), F.lit("s").alias("role")).union(a.select("id", F.explode("object_ids"), F.lit("o")))
    ends = links.join(m, "member", "left").groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "s", F.coalesce("survivor", "member")))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "o", F.coalesce("survivor", "member")))).alias("o"),
        F.bool_or(F.col("survivor").isNotNull()).alias("changed"),
    )
    none = F.array().cast("array<string>")
    moved = a.select("id", "type").join(ends, "id", "left").select("id", "type", F.coalesce("s", none).alias("s"), F.coalesce("o", none).alias("o"), F.coalesce("changed", F.lit(False)).alias("changed"))
    return _with_first(moved, "type", "s", "o").select("id", "type", F.array_distinct("s").alias("subject_ids"), F.array_distinct("o").alias("object_ids"), "changed", "first")


@dataclass
class DedupReport:
    scanned_entities: int
    keyed_entities: int
    unkeyed_entities: int
    duplicate_groups: int
    merged_entities: int
    deleted_entities: int
    copied_properties: int
    rewired_relationships: int
    deleted_relationships: int
    rewired_actions: int
    deleted_actions: int
    skipped_items: int


def _touched(nodes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the relationships and of the actions that touch a duplicate, with it."""
    dup = mapping.select(F.col("id").alias("member"))
    r = relationships(nodes).select("id", F.explode(F.array_compact(F.array("subject_id", "object_id"))).alias("member")).join(dup, "member", "left_semi")
    a = actions(nodes).select("id", F.explode(F.array_union("subject_ids", "object_ids")).alias("member")).join(dup, "member", "left_semi")
    return r, a


def report(nodes: DataFrame, key: Column, policy: str = "rewire_and_deduplicate", prefer: list[Column] | None = None) -> DataFrame:
    """One row of the counts of a ``DedupReport``."""
    mapping = cut(replacements(nodes, key, prefer))
    marked = lambda df, **c: df.agg(*(x.alias(n) for n, x in c.items()))
    base = marked(keyed(nodes, key), scanned_entities=F.count(F.lit(1)), keyed_entities=F.count("key"), unkeyed_entities=F.count_if(F.col("key").isNull()))
    groups = marked(mapping, duplicate_groups=F.count_distinct("survivor"), merged_entities=F.count(F.lit(1)))
    copied = marked(merged_metadata(nodes, mapping), copied_properties=F.coalesce(F.sum("copied"), F.lit(0)))
    r, a = rewired_relationships(nodes, mapping), rewired_actions(nodes, mapping)
    if policy == "rewire_and_deduplicate":
        rel = marked(r, rewired_relationships=F.count_if(F.col("changed") & F.col("first")), deleted_relationships=F.count_if(F.col("changed") | ~F.col("first")))
        act = marked(a, rewired_actions=F.count_if(F.col("changed") & F.col("first")), deleted_actions=F.count_if(F.col("changed") | ~F.col("first")))
        extra = marked(mapping, deleted_entities=F.count(F.lit(1)), skipped_items=F.lit(0).cast("long"))
    elif policy == "rewire_only":
        rel = marked(r, rewired_relationships=F.count_if("changed"), deleted_relationships=F.lit(0).cast("long"))
        act = marked(a, rewired_actions=F.count_if("changed"), deleted_actions=F.lit(0).cast("long"))
        extra = marked(mapping, deleted_entities=F.count(F.lit(1)), skipped_items=F.lit(0).cast("long"))
    else:
        zero = lambda *names: {n: F.lit(0).cast("long") for n in names}
        rel, act = marked(mapping, **zero("rewired_relationships", "deleted_relationships")), marked(mapping, **zero("rewired_actions", "deleted_actions"))
        tr, ta = _touched(nodes, mapping)
        protected = tr.select("member").union(ta.select("member")).distinct()
        free = mapping.join(protected.withColumnRenamed("member", "id"), "id", "left_anti")
        skipped = r.where("changed").select("id").union(a.where("changed").select("id"))
        extra = _row(marked(free, deleted_entities=F.count(F.lit(1))), marked(skipped, skipped_items=F.count(F.lit(1))))
    return _row(base, groups, copied, rel, act, extra).select(*(f.name for f in fields(DedupReport)))


def _row(*parts: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def deduplicate(nodes: DataFrame, key: Column, *, policy: str = "rewire_and_deduplicate", unkeyed: str = "skip", prefer: list[Column] | None = None) -> DataFrame:
    """The graph after deduplication.

    policy: what to do with links of duplicates (see POLICIES).  unkeyed:
    ``skip`` or ``fail``.  Failures are raised before anything is changed.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    if unkeyed == "fail" and (n := keyed(nodes, key).where("key is null").count()):
        raise UnkeyedEntities(f"{n} entities have no key")
    mapping = cut(replacements(nodes, key, prefer))  # everything below joins with it
    touched_r, touched_a = _touched(nodes, mapping)
    if policy == "fail":
        for touched in (touched_r, touched_a):
            if found := touched.orderBy("id").select("id").head():
                raise UnresolvedLink(found[0])
    meta = merged_metadata(nodes, mapping).drop("copied").select("id", *(F.col(c).alias(f"m_{c}") for c in ("props", "tags", "groups")))
    out = nodes.join(meta, "id", "left")
    for c in ("props", "tags", "groups"):
        out = out.withColumn(c, F.coalesce(f"m_{c}", c)).drop(f"m_{c}")
    for c in ("tags", "groups"):
        out = out.withColumn(f"{c}_fold", F.transform(c, fold_column))
    gone = mapping.select("id")
    if policy == "skip":
        protected = touched_r.select("member").union(touched_a.select("member")).distinct().withColumnRenamed("member", "id")
        return _without(out, gone.join(protected, "id", "left_anti"))
    r, a = rewired_relationships(nodes, mapping), rewired_actions(nodes, mapping)
    if policy == "rewire_and_deduplicate":
        dropped = r.where("not first").select("id").union(a.where("not first").select("id"))
        out, r, a = out.join(dropped, "id", "left_anti"), r.where("first"), a.where("first")
    moved = r.where("changed").select("id", F.col("subject_id").alias("s"), F.col("object_id").alias("o"))
    members = a.where("changed").select("id", F.col("subject_ids").alias("ss"), F.col("object_ids").alias("os"))
    out = out.join(moved, "id", "left").join(members, "id", "left")
    out = out.withColumn("subject_id", F.coalesce("s", "subject_id")).withColumn("object_id", F.coalesce("o", "object_id")).withColumn("subject_ids", F.coalesce("ss", "subject_ids")).withColumn("object_ids", F.coalesce("os", "object_ids"))
    return _without(out.select(nodes.columns), gone)


def _without(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleted, with the half-edges still attached to the duplicates."""
    return delete(cut(nodes), ids).select(nodes.columns)
