"""Structural validation: does everything a node refers to exist?

A validated entity is followed to its relationships and actions, and these to
their ends, never further.  The result is a table of references, each absent
(nothing is referred to), materialized or unresolved (the target is missing, or a
property's payload does not decode).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut
from .scan import decodes
from .traverse import actions, relationships


def _details(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """References of the nodes of ``roots(root, id)`` to their own details."""
    own = roots.join(nodes.select("id", "groups", "names", "broken", "tags"), "id")
    parts = []
    for name, items in (("groupSet", "groups"), ("propertySet", "names"), ("tagSet", "tags")):
        found = own.select("root", F.col("id").alias("source"), F.lit(name).alias("relationship"), F.explode_outer(items).alias("destination"), "broken")
        lost = F.coalesce(F.array_contains("broken", F.col("destination")), F.lit(False)) if name == "propertySet" else F.lit(False)
        parts.append(found.withColumn("state", F.when(F.col("destination").isNull(), "absent").when(lost, "unresolved").otherwise("materialized")).drop("broken"))
    return parts[0].union(parts[1]).union(parts[2])


def references(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, source, relationship, destination, state) for each id of ``roots(id)``."""
    # every branch below reads these few columns, so they are made once
    nodes = cut(nodes.select("id", "node_class", "type", "subject_id", "object_id", "subject_ids", "object_ids", "groups", "tags", F.transform("props", lambda p: p["name"]).alias("names"), F.transform(F.filter("props", lambda p: ~decodes(p)), lambda p: p["name"]).alias("broken")))
    roots = roots.select("id").distinct()
    present = nodes.select("id", "node_class")
    rooted = roots.join(present, "id", "left")
    self_ = rooted.select(F.col("id").alias("root"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("relationship"), F.col("id").alias("destination"), F.when(F.col("node_class").isNull(), "unresolved").otherwise("materialized").alias("state"))

    # families without a root need no branch; the driver sees at most four rows
    classes = {c[0] for c in rooted.select("node_class").distinct().collect()}
    whole = rooted.where("node_class = 1").select("id")
    r, a = relationships(nodes), actions(nodes)
    hops = []
    for name, links in (
        ("actionObjectSet", a.select(F.col("id").alias("edge"), F.explode("object_ids").alias("id"))),
        ("actionSubjectSet", a.select(F.col("id").alias("edge"), F.explode("subject_ids").alias("id"))),
        ("relationshipObjectSet", r.select(F.col("id").alias("edge"), F.col("object_id").alias("id"))),
        ("relationshipSubjectSet", r.select(F.col("id").alias("edge"), F.col("subject_id").alias("id"))),
    ):
        found = whole.join(links.where("id is not null").distinct(), "id", "left")
        hops.append(found.select(F.col("id").alias("root"), F.col("id").alias("source"), F.lit(name).alias("relationship"), F.col("edge").alias("destination"), F.when(F.col("edge").isNull(), "absent").otherwise("materialized").alias("state")))
    near = hops[0].union(hops[1]).union(hops[2]).union(hops[3])
    if 1 not in classes:
        near = self_.where("false")

    # every edge once a root, whether the root is the edge or it was reached
    own = rooted.where("node_class in (2, 3)").select(F.col("id").alias("root"), "id")
    edges = near.where("destination is not null").select("root", F.col("destination").alias("id")).union(own).distinct() if 1 in classes else own
    full = edges.join(nodes.where("node_class in (2, 3)").select("id", "node_class", "subject_id", "object_id", "subject_ids", "object_ids"), "id")
    ends = []
    for role in ("object", "subject"):
        single = full.where("node_class = 2").select("root", F.col("id").alias("source"), F.lit(role).alias("relationship"), F.col(f"{role}_id").alias("destination"))
        many = full.where("node_class = 3").select("root", F.col("id").alias("source"), F.lit(f"{role}Set").alias("relationship"), F.explode_outer(f"{role}_ids").alias("destination"))
        ends += [single] * (1 in classes or 2 in classes) + [many] * (1 in classes or 3 in classes)
    if not ends:
        return self_
    linked = reduce(DataFrame.union, ends)
    there = present.where("node_class = 1").select(F.col("id").alias("destination"), F.lit(True).alias("there"))
    state = F.when(F.col("destination").isNull(), "absent").when(F.col("there"), "materialized").otherwise("unresolved")
    linked = linked.join(there, "destination", "left").select("root", "source", "relationship", "destination", state.alias("state"))
    details = _details(nodes, whole.select(F.col("id").alias("root"), "id").union(edges.select("root", "id")))
    found = self_.union(linked).union(details)
    return found.union(near) if 1 in classes else found


def in_order(refs: DataFrame) -> DataFrame:
    """References sorted by root, source, relationship and destination."""
    return refs.orderBy(*(F.col(c).asc_nulls_first() for c in ("root", "source", "relationship", "destination")))


def verdicts(refs: DataFrame) -> DataFrame:
    """(root, references, unresolved, valid) from ``references``."""
    return refs.groupBy("root").agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("state") == "unresolved").alias("unresolved")).withColumn("valid", F.col("unresolved") == 0)
