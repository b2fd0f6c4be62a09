"""Tables as a property graph.

Every builder is a projection of its tables, so a filter on the family or type
prunes the other branches of the union before anything is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_column
from ..schema import NODES, PROPERTY, NodeClass

_NUMERIC = ("int", "double", "bool")


def property_(name: str, value: Column, kind: str) -> Column:
    """One property with its typed slots; numbers also fill ``n``."""
    slots = {"name": F.lit(name), "name_fold": fold_column(F.lit(name)), "kind": F.lit(kind), "app_data_version": F.lit(0)}
    if kind in ("string", "url"):
        slots |= {"s": value, "s_fold": fold_column(value)}
    elif kind in _NUMERIC:
        slots["n"] = value.cast("int").cast("double") if kind == "bool" else value.cast("double")
        if kind != "double":
            slots["l"] = value.cast("long")
    else:
        slots[{"date": "d", "data": "b"}.get(kind, "j")] = value
    return F.struct(*(slots.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PROPERTY))


def properties(*parts: tuple) -> Column:
    """An array of properties; a part is (name, value, kind) or (name, value,
    kind, condition), and is left out where its value is null or its condition
    is not true."""
    made = []
    for name, value, kind, *condition in parts:
        present = value.isNotNull() & (F.coalesce(condition[0], F.lit(False)) if condition else F.lit(True))
        made.append(F.when(present, property_(name, value, kind)))
    return F.array_compact(F.array(*made)) if made else F.array().cast(NODES["props"].dataType)


def node_id(family: NodeClass, type_: str, key: Column) -> Column:
    return F.concat(F.lit(f"{int(family)}{type_}p"), key.cast("string"))


def nodes_of(rows: DataFrame, family: NodeClass, type_: Column | str, key: Column, *, tags: Column | None = None, groups: Column | None = None, props: Column | None = None, created: Column | None = None, subject: Column | None = None, object_: Column | None = None, subjects: Column | None = None, objects: Column | None = None) -> DataFrame:
    """Rows as nodes of one family and type."""
    kind = F.lit(type_) if isinstance(type_, str) else type_
    none = F.array().cast("array<string>")
    tags, groups = (F.array_distinct(x) if x is not None else none for x in (tags, groups))
    columns = {
        "id": F.concat(F.lit(str(int(family))), kind, F.lit("p"), key.cast("string")),
        "node_class": F.lit(int(family)),
        "type": kind,
        "type_fold": fold_column(kind),
        "created_date": created,
        "tags": tags,
        "tags_fold": F.transform(tags, fold_column),
        "groups": groups,
        "groups_fold": F.transform(groups, fold_column),
        "props": props if props is not None else properties(),
        "subject_id": subject,
        "object_id": object_,
        "subject_ids": F.array_distinct(subjects) if subjects is not None else none,
        "object_ids": F.array_distinct(objects) if objects is not None else none,
    }
    return rows.select(*((c if c is not None else F.lit(None)).cast(NODES[n].dataType).alias(n) for n, c in columns.items()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


E_, R_, A_ = NodeClass.ENTITY, NodeClass.RELATIONSHIP, NodeClass.ACTION


def regions(spark, d):
    return nodes_of(read(spark, d, "region"), E_, "Region", F.col("r_regionkey"), props=properties(("name", F.col("r_name"), "string")))


def nations(spark, d):
    return nodes_of(read(spark, d, "nation"), E_, "Nation", F.col("n_nationkey"), groups=F.array(F.concat(F.lit("region"), F.col("n_regionkey"))), props=properties(("name", F.col("n_name"), "string"), ("regionkey", F.col("n_regionkey"), "int")))


def customers(spark, d):
    props = properties(("name", F.col("c_name"), "string"), ("acctbal", F.col("c_acctbal"), "double"), ("nationkey", F.col("c_nationkey"), "int"), ("segment", F.col("c_mktsegment"), "string"), ("vip", F.lit(True), "bool", F.col("c_acctbal") > 5000))
    return nodes_of(read(spark, d, "customer"), E_, "Customer", F.col("c_custkey"), tags=F.array("c_mktsegment"), groups=F.array(F.concat(F.lit("nation"), F.col("c_nationkey"))), props=props)


def suppliers(spark, d):
    props = properties(("name", F.col("s_name"), "string"), ("acctbal", F.col("s_acctbal"), "double"), ("nationkey", F.col("s_nationkey"), "int"))
    debt = F.when(F.col("s_acctbal") < 0, F.array(F.lit("debt"))).otherwise(F.array().cast("array<string>"))
    return nodes_of(read(spark, d, "supplier"), E_, "Supplier", F.col("s_suppkey"), tags=debt, groups=F.array(F.concat(F.lit("nation"), F.col("s_nationkey"))), props=props)


def parts(spark, d):
    props = properties(("name", F.col("p_name"), "string"), ("brand", F.col("p_brand"), "string"), ("size", F.col("p_size"), "int"), ("retailprice", F.col("p_retailprice"), "double"))
    return nodes_of(read(spark, d, "part"), E_, "Part", F.col("p_partkey"), tags=F.array("p_type"), groups=F.array("p_brand"), props=props)


def users(spark, d):
    seen = read(spark, d, "events").where("user_id is not null").select("user_id").distinct()
    return nodes_of(seen, E_, "User", F.col("user_id"), props=properties(("user_id", F.col("user_id"), "int")))


def documents(spark, d):
    labels = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    return nodes_of(docs, E_, "Document", F.col("doc_id"), tags=tags, groups=F.array("source"), props=properties(("lang", F.col("lang"), "string"), ("source", F.col("source"), "string"), ("n_chars", F.col("n_chars"), "int")))


def in_region(spark, d):
    return nodes_of(read(spark, d, "nation"), R_, "inRegion", F.col("n_nationkey"), subject=node_id(E_, "Nation", F.col("n_nationkey")), object_=node_id(E_, "Region", F.col("n_regionkey")))


def in_nation(spark, d):
    of_customer = nodes_of(read(spark, d, "customer"), R_, "inNation", F.concat(F.lit("c"), F.col("c_custkey")), subject=node_id(E_, "Customer", F.col("c_custkey")), object_=node_id(E_, "Nation", F.col("c_nationkey")))
    of_supplier = nodes_of(read(spark, d, "supplier"), R_, "inNation", F.concat(F.lit("s"), F.col("s_suppkey")), subject=node_id(E_, "Supplier", F.col("s_suppkey")), object_=node_id(E_, "Nation", F.col("s_nationkey")))
    return of_customer.union(of_supplier)


def order_actions(spark, d):
    items = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(node_id(E_, "Part", F.col("l_partkey"))).alias("objects"))
    orders = read(spark, d, "orders").join(items, "o_orderkey", "left")
    props = properties(("totalprice", F.col("o_totalprice"), "double"), ("orderkey", F.col("o_orderkey"), "int"))
    return nodes_of(orders, A_, "order", F.col("o_orderkey"), tags=F.array("o_orderstatus"), groups=F.array("o_orderpriority"), props=props, created=F.col("o_orderdate"), subjects=F.array(node_id(E_, "Customer", F.col("o_custkey"))), objects=F.coalesce("objects", F.array().cast("array<string>")))


def event_actions(spark, d):
    number = F.expr("try_variant_get(try_parse_json(props), '$.k', 'long')")
    props = properties(("value", F.col("value"), "double"), ("k", number, "int"))
    return nodes_of(read(spark, d, "events"), A_, F.col("event_type"), F.col("event_id"), props=props, created=F.col("ts"), subjects=F.array(node_id(E_, "User", F.col("user_id"))))


BUILDERS = {
    NodeClass.ENTITY: {"Region": regions, "Nation": nations, "Customer": customers, "Supplier": suppliers, "Part": parts, "User": users, "Document": documents},
    NodeClass.RELATIONSHIP: {"inRegion": in_region, "inNation": in_nation},
    NodeClass.ACTION: {"order": order_actions, "event": event_actions},
}


def graph(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The nodes of the named types (all if none is named)."""
    made = [f(spark, sf_dir) for builders in BUILDERS.values() for name, f in builders.items() if not names or name in names]
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out


def changes(spark: SparkSession, sf_dir: str, *, tx_rows: int = 50) -> DataFrame:
    """A change log from events: authors by user (``me``, ``remoteA`` or null),
    sign-ups insert, errors delete, everything else updates."""
    e = read(spark, sf_dir, "events").where("event_id is not null")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    part = F.when(F.pmod("event_id", F.lit(4)) == 0, "node").when(F.pmod("event_id", F.lit(4)) == 1, "tag").when(F.pmod("event_id", F.lit(4)) == 2, "group").otherwise("property")
    return e.select(
        F.floor(F.col("event_id") / tx_rows).cast("long").alias("tx"),
        "ts",
        F.when(F.pmod("user_id", F.lit(3)) == 0, "me").when(F.pmod("user_id", F.lit(3)) == 1, "remoteA").alias("author"),
        op.alias("op"),
        (F.pmod("user_id", F.lit(3)) + 1).cast("int").alias("family"),
        part.alias("part"),
        F.concat(F.lit("x-store://"), part, F.lit("/"), F.pmod("event_id", F.lit(977))).alias("object_uri"),
        F.when(F.pmod("event_id", F.lit(29)) != 0, node_id(E_, "User", F.col("user_id"))).alias("owner_id"),
        F.when(part != "node", F.col("event_type")).alias("name"),
        F.when(part == "property", F.col("value").cast("string")).alias("value"),
        F.pmod("event_id", F.lit(tx_rows)).cast("int").alias("change_index"),
    )
