"""The registered graph queries, and the same rows in SQL for DuckDB.

A query returns scalar columns.  ``add`` pairs it with its SQL, which is
written against the base tables and shares no code with the query.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary, json, text
from ..migrations import ledger
from ..operators import dedup, merge, mutate, predicate, scan, traverse, validate
from ..operators.predicate import exists, has, member_of, prop, type_
from ..operators.search import Search
from ..schema import NodeClass
from ..sources import codec, ingest
from ..streaming import feed

E, R, A = NodeClass.ENTITY, NodeClass.RELATIONSHIP, NodeClass.ACTION
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(sql: str | None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return keep


def search(name: str, p, sql: str, *types: str, family: NodeClass = E, offset: int = 0) -> None:
    """A search that returns ids, over the graph of the named types."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = Search(ingest.graph(spark, d, *types), family, offset)
        for one in p() if isinstance(p(), list) else [p()]:
            s.where(one)
        return s.run().select("id")

    add(sql, name)(run)


CUSTOMER = "SELECT '1Customerp' || c_custkey AS id FROM customer WHERE "
PART = "SELECT '1Partp' || p_partkey AS id FROM part WHERE "
ORDER = "SELECT '3orderp' || o_orderkey AS id FROM orders WHERE "
DOCUMENT = "SELECT '1Documentp' || doc_id AS id FROM documents WHERE "
#: Ids and folded types of all small entity tables.
SMALL = """(SELECT '1Regionp' || r_regionkey AS id, 'region' AS t FROM region UNION ALL SELECT '1Nationp' || n_nationkey, 'nation' FROM nation
 UNION ALL SELECT '1Customerp' || c_custkey, 'customer' FROM customer UNION ALL SELECT '1Supplierp' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT '1Partp' || p_partkey, 'part' FROM part)"""
FEW = ("Region", "Nation", "Customer", "Supplier", "Part")


@add("SELECT '1Customerp' || c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer WHERE lower(c_mktsegment) = 'building' AND c_acctbal >= 5000")
def rich_builders(spark, d):
    found = Search(ingest.graph(spark, d), E).where(type_("Customer") & has("building") & (prop("acctbal") >= 5000)).run()
    return found.select("id", mutate.property_value("name", "s").alias("name"), mutate.property_value("acctbal", "n").alias("acctbal"))


# --- search -----------------------------------------------------------------
search("search_type_exact", lambda: type_("customer"), CUSTOMER + "true", *FEW)
search("search_type_wildcard", lambda: type_("*ti?n"), f"SELECT id FROM {SMALL} WHERE t LIKE '%ti_n'", *FEW)
search("search_type_star", lambda: type_("*"), f"SELECT id FROM {SMALL}", *FEW)
search("search_type_compound", lambda: type_(predicate.text("*r") & ~predicate.text("supplier")), f"SELECT id FROM {SMALL} WHERE t LIKE '%r' AND t <> 'supplier'", *FEW)
search("search_where_or", lambda: [type_("Region"), prop("acctbal") > 9000], "SELECT '1Regionp' || r_regionkey AS id FROM region UNION ALL SELECT '1Customerp' || c_custkey FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT '1Supplierp' || s_suppkey FROM supplier WHERE s_acctbal > 9000", *FEW)
search("search_offset", lambda: type_("Customer"), CUSTOMER + "true ORDER BY id OFFSET 25", "Customer", offset=25)


@add(f"SELECT id FROM {SMALL} WHERE false")
def search_no_predicate(spark, d):
    return Search(ingest.graph(spark, d, *FEW), E).run().select("id")


@add(f"SELECT id FROM {SMALL} WHERE false")
def search_clear(spark, d):
    return Search(ingest.graph(spark, d, *FEW), E).where(type_("*")).clear().run().select("id")


@add(CUSTOMER + "c_acctbal < 0 OR c_mktsegment = 'MACHINERY'")
def search_plus(spark, d):
    nodes = ingest.graph(spark, d, "Customer")
    return (Search(nodes, E).where(prop("acctbal") < 0) + Search(nodes, E).where(has("machinery"))).run().select("id")


# --- property predicates ----------------------------------------------------
search("pred_prop_eq_string", lambda: prop("SEGMENT") == "Building", CUSTOMER + "lower(c_mktsegment) = 'building'", "Customer")
search("pred_prop_eq_wildcard", lambda: prop("name") == "*L?", PART + "lower(p_name) LIKE '%l_'", "Part")
search("pred_prop_name_wildcard", lambda: prop("n*key") == 7, "SELECT '1Customerp' || c_custkey AS id FROM customer WHERE c_nationkey = 7", "Customer")
search("pred_prop_eq_number", lambda: prop("size") == 15, PART + "p_size = 15", "Part")
search("pred_prop_eq_bool", lambda: prop("vip") == True, CUSTOMER + "c_acctbal > 5000", "Customer")  # noqa: E712
search("pred_prop_ne_string_missing", lambda: prop("segment") != "b*", f"SELECT id FROM {SMALL} WHERE NOT (t = 'customer' AND id IN (SELECT '1Customerp' || c_custkey FROM customer WHERE lower(c_mktsegment) LIKE 'b%'))", *FEW)
search("pred_prop_ne_number_missing", lambda: prop("vip") != 0, CUSTOMER + "c_acctbal > 5000", *FEW)
search("pred_prop_gt", lambda: prop("size") > 25, PART + "p_size > 25", "Part")
search("pred_prop_ge", lambda: prop("retailprice") >= 910, PART + "p_retailprice >= 910", "Part")
search("pred_prop_lt", lambda: prop("acctbal") < 0, CUSTOMER + "c_acctbal < 0", "Customer")
search("pred_prop_le", lambda: prop("size") <= 10, PART + "p_size <= 10", "Part")
search("pred_number_on_string", lambda: prop("name") >= 1, PART + "false", "Part")
search("pred_exists_any", lambda: exists("vip", "size"), "SELECT '1Customerp' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT '1Partp' || p_partkey FROM part WHERE p_size IS NOT NULL", *FEW)
search("pred_exists_all", lambda: exists("vip", "name", using=lambda a, b: a & b), CUSTOMER + "c_acctbal > 5000", *FEW)
search("pred_exists_compound", lambda: type_("customer") & exists(predicate.text("name") & ~predicate.text("vip")), CUSTOMER + "c_acctbal <= 5000", "Customer", "Part")
search("pred_tags_any", lambda: has("building", "machinery"), CUSTOMER + "c_mktsegment IN ('BUILDING', 'MACHINERY')", "Customer")
search("pred_tags_all", lambda: has("quality", "toxic", using=lambda a, b: a & b), DOCUMENT + "doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "Document")
search("pred_tags_not", lambda: ~has("quality"), DOCUMENT + "doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)", "Document")
search("pred_groups_any", lambda: member_of("nation1*"), CUSTOMER + "c_nationkey::VARCHAR LIKE '1%'", "Customer")
search("pred_groups_all", lambda: member_of("brand*", "*1", using=lambda a, b: a & b), PART + "lower(p_brand) LIKE 'brand%' AND lower(p_brand) LIKE '%1'", "Part")
search("pred_empty_list", lambda: has(), CUSTOMER + "false", "Customer")
search("pred_demorgan_mixed", lambda: ~((prop("acctbal") > 0) & has("building")) & ~((prop("acctbal") > 9000) | has("machinery")), CUSTOMER + "NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING') AND NOT (c_acctbal > 9000 OR c_mktsegment = 'MACHINERY')", "Customer")
search("pred_compound_none", lambda: predicate.compound([has("building"), prop("acctbal") < 0], "not"), CUSTOMER + "NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)", "Customer")
search("pred_order_status", lambda: has("f") & member_of("1-*") & (prop("totalprice") >= 100000), ORDER + "o_orderstatus = 'F' AND o_orderpriority LIKE '1-%' AND o_totalprice >= 100000", "order", family=A)


def _dated(spark, d):
    rows = ingest.read(spark, d, "orders")
    return ingest.nodes_of(rows, E, "Dated", F.col("o_orderkey"), props=ingest.properties(("at", F.col("o_orderdate"), "date")))


@add("SELECT '1Datedp' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def pred_date_ge(spark, d):
    return Search(_dated(spark, d), E).where(prop("at") >= dt.datetime(1998, 1, 1)).run().select("id")


@add("SELECT '1Datedp' || o_orderkey AS id FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'")
def pred_date_le(spark, d):
    return Search(_dated(spark, d), E).where(prop("at") <= dt.datetime(1996, 6, 30)).run().select("id")


@add("SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def fold_text(spark, d):
    return ingest.read(spark, d, "documents").select("doc_id", F.md5(text.fold_column(F.col("text")).cast("binary")).alias("folded"))


@add("SELECT doc_id FROM documents WHERE lower(strip_accents(text)) LIKE '%ete%' OR lower(strip_accents(text)) LIKE 'u%'")
def pred_accent(spark, d):
    folded = text.fold_column(F.col("text"))
    return ingest.read(spark, d, "documents").where(text.like(folded, "*été*") | text.like(folded, "Ü*")).select("doc_id")


# --- object-level checks, projections, mutations ---------------------------
@add("SELECT '1Documentp' || d.doc_id AS id, coalesce(q, false) AND coalesce(t, false) AS both, coalesce(q, false) OR coalesce(t, false) AS any_of, true AS none_all, false AS none_any FROM documents d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def object_has_tags(spark, d):
    two = ["quality", "toxic"]
    return ingest.graph(spark, d, "Document").select("id", predicate.exact_set("tags", two).alias("both"), predicate.exact_set("tags", two, "or").alias("any_of"), predicate.exact_set("tags", []).alias("none_all"), predicate.exact_set("tags", [], "or").alias("none_any"))


@add("SELECT '1Partp' || p_partkey AS id, p_brand = 'Brand#11' AS one, false AS folded FROM part")
def object_member_of(spark, d):
    return ingest.graph(spark, d, "Part").select("id", predicate.exact_set("groups", ["Brand#11"]).alias("one"), predicate.exact_set("groups", ["brand#11"], "or").alias("folded"))


@add("SELECT '1Customerp' || c_custkey AS id, c_name AS name, c_acctbal AS acctbal, CASE WHEN c_acctbal > 5000 THEN 1 END::BIGINT AS vip, CASE WHEN c_acctbal > 5000 THEN 5 ELSE 4 END::INTEGER AS properties FROM customer")
def project_properties(spark, d):
    v = mutate.property_value
    return ingest.graph(spark, d, "Customer").select("id", v("name", "s").alias("name"), v("acctbal", "n").alias("acctbal"), v("vip", "l").alias("vip"), F.size("props").alias("properties"))


@add("SELECT '3orderp' || o_orderkey AS id, o_orderdate AS created, 1::INTEGER AS tags, o_orderpriority AS grp FROM orders")
def project_scalars(spark, d):
    return ingest.graph(spark, d, "order").select("id", F.coalesce("created_date", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("created"), F.size("tags").alias("tags"), F.get("groups", F.lit(0)).alias("grp"))


@add("SELECT '1Customerp' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' ELSE 'BUILDING,' || CASE WHEN c_mktsegment < 'BUILDING' THEN c_mktsegment || ',new' ELSE c_mktsegment || ',new' END END AS tags FROM customer WHERE c_mktsegment >= 'BUILDING' UNION ALL SELECT '1Customerp' || c_custkey, c_mktsegment || ',BUILDING,new' FROM customer WHERE c_mktsegment < 'BUILDING'")
def toggle_tags(spark, d):
    nodes = mutate.change_labels(ingest.graph(spark, d, "Customer"), "tags", mutate.toggle, ["BUILDING", "new", "new"], F.lit(True))
    return nodes.select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@add("SELECT '1Partp' || p_partkey AS id, 'extra' || CASE WHEN p_brand = 'Brand#11' THEN '' ELSE ',' || p_brand END AS grps FROM part")
def add_remove_groups(spark, d):
    nodes = mutate.change_labels(ingest.graph(spark, d, "Part"), "groups", mutate.add, ["extra"], F.lit(True))
    nodes = mutate.change_labels(nodes, "groups", mutate.remove, ["Brand#11"], F.lit(True))
    return nodes.select("id", F.array_join(F.reverse(F.array_sort("groups")), ",").alias("grps"))


@add("SELECT '1Partp' || p_partkey AS id, CASE WHEN p_size > 25 THEN 1 ELSE p_size END::BIGINT AS size, NULL::VARCHAR AS brand FROM part")
def set_delete_property(spark, d):
    nodes = mutate.set_property(ingest.graph(spark, d, "Part"), ingest.property_("size", F.lit(1), "int"), mutate.property_value("size", "l") > 25)
    nodes = mutate.delete_property(nodes, "brand", F.lit(True))
    return nodes.select("id", mutate.property_value("size", "l").alias("size"), mutate.property_value("brand", "s").alias("brand"))


@add("SELECT 1::INTEGER AS node_class, (SELECT count(*) FROM customer WHERE c_nationkey <> 3 OR c_nationkey IS NULL) AS n UNION ALL SELECT 2, (SELECT count(*) FROM customer WHERE c_nationkey <> 3) + (SELECT count(*) FROM supplier) UNION ALL SELECT 3, (SELECT count(*) FROM orders o JOIN customer c ON c_custkey = o_custkey WHERE c_nationkey <> 3)")
def delete_cascade_counts(spark, d):
    nodes = ingest.graph(spark, d, "Customer", "inNation", "order")
    gone = nodes.where(member_of("nation3").column() & (F.col("type") == "Customer")).select("id")
    return mutate.delete(nodes, gone).groupBy("node_class").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT '2inRegionp' || n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN NULL ELSE '1Regionp0' END AS object_id FROM nation")
def set_relationship_object(spark, d):
    nodes = mutate.set_endpoint(ingest.graph(spark, d, "inRegion"), "object", F.lit("1Regionp0"), F.lit(True))
    low = F.regexp_extract("id", "p([0-9]+)$", 1).cast("int") < 5
    return mutate.set_endpoint(nodes, "object", F.lit(None).cast("string"), low).select("id", "object_id")


@add("SELECT '3orderp' || o_orderkey AS id, 2::INTEGER AS subjects FROM orders")
def action_add_subjects(spark, d):
    nodes = mutate.change_participants(ingest.graph(spark, d, "order"), "subject", mutate.add, ["1Customerp0x", "1Customerp0x"], F.lit(True))
    return nodes.select("id", F.size("subject_ids").alias("subjects"))


# --- traversals -------------------------------------------------------------
@add("SELECT '2inNationpc' || c_custkey AS id, 'Customer' AS subject_type, 'Nation' AS object_type, '1Nationp' || c_nationkey AS object_id FROM customer UNION ALL SELECT '2inNationps' || s_suppkey, 'Supplier', 'Nation', '1Nationp' || s_nationkey FROM supplier UNION ALL SELECT '2inRegionp' || n_nationkey, 'Nation', 'Region', '1Regionp' || n_regionkey FROM nation")
def rel_subject_object(spark, d):
    return traverse.endpoints(ingest.graph(spark, d, *FEW, "inRegion", "inNation")).select("id", "subject_type", "object_type", "object_id")


@add("SELECT '1Nationp' || n_nationkey AS entity_id, '2inRegionp' || n_nationkey AS id FROM nation UNION ALL SELECT '1Customerp' || c_custkey, '2inNationpc' || c_custkey FROM customer UNION ALL SELECT '1Supplierp' || s_suppkey, '2inNationps' || s_suppkey FROM supplier")
def rel_when_subject(spark, d):
    return traverse.relationships_of(ingest.graph(spark, d, "inRegion", "inNation"), ("subject",)).select("entity_id", "id")


@add("SELECT '1Nationp' || k AS entity_id, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) GROUP BY k")
def rel_all_of_nations(spark, d):
    return traverse.relationships_of(ingest.graph(spark, d, "inRegion", "inNation")).where("entity_id like '1Nation%'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT '1Nationp' || k AS entity_id, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def rel_types(spark, d):
    return traverse.relationships_of(ingest.graph(spark, d, "inRegion", "inNation"), ("object",), ["inNation"]).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT '1Customerp' || o_custkey AS entity_id, count(*) AS n FROM orders GROUP BY o_custkey")
def act_when_subject(spark, d):
    return traverse.actions_of(ingest.graph(spark, d, "order"), ("subject",)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT '1Partp' || l_partkey AS entity_id, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey")
def act_when_object(spark, d):
    return traverse.actions_of(ingest.graph(spark, d, "order"), ("object",)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT '1Userp' || user_id AS entity_id, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def act_types(spark, d):
    return traverse.actions_of(ingest.graph(spark, d, "event"), types=["click", "purchase"]).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT '3orderp' || o_orderkey AS action_id, '1Customerp' || o_custkey AS id FROM orders JOIN customer ON c_custkey = o_custkey")
def act_subject_types(spark, d):
    return traverse.participants(ingest.graph(spark, d, "Customer", "order"), "subject", ["Customer"]).select("action_id", "id")


@add("SELECT '3orderp' || l_orderkey AS action_id, count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def act_object_types(spark, d):
    return traverse.participants(ingest.graph(spark, d, "Part", "order"), "object", ["Part"]).groupBy("action_id").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT DISTINCT '1Partp' || l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
def act_array_objects(spark, d):
    nodes = ingest.graph(spark, d, "Part", "order")
    urgent = Search(nodes, A).where(member_of("1-urgent") & (prop("totalprice") > 200000)).run()
    return traverse.distinct_ends(nodes, urgent, "object", ["Part"]).select("id")


@add("SELECT DISTINCT '1Nationp' || c_nationkey AS id FROM customer WHERE c_acctbal < 0")
def rel_array_objects(spark, d):
    nodes = ingest.graph(spark, d, "Customer", "Nation", "inNation")
    poor = Search(nodes, E).where(prop("acctbal") < 0).run().select(F.col("id").alias("subject_id"))
    edges = traverse.relationships(nodes).join(poor, "subject_id", "left_semi").select(nodes.columns)
    return traverse.distinct_ends(nodes, edges, "object", ["Nation"]).select("id")


# --- JSON, binary and string functions -------------------------------------
def _event_json(spark, d):
    return ingest.read(spark, d, "events").select("event_id", "props", json.parse(F.col("props")).alias("v"))


@add("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.k'), 'null') AS k_text, NULL::VARCHAR AS missing FROM events")
def json_access(spark, d):
    k = json.member(F.col("v"), "k")
    return _event_json(spark, d).select("event_id", json.typed(k, "long").alias("k"), json.stringify(k).alias("k_text"), json.typed(json.member(F.col("v"), "nope"), "string").alias("missing"))


@add("SELECT event_id, 'b' AS second, 'null' AS beyond, 'null' AS negative, 'null' AS bad, true AS loose FROM events")
def json_edges(spark, d):
    v = F.parse_json(F.lit('["a", "b"]'))
    return ingest.read(spark, d, "events").select("event_id", json.stringify(json.item(v, 1)).alias("second"), json.stringify(json.item(v, 3)).alias("beyond"), json.stringify(json.item(v, -1)).alias("negative"), json.stringify(json.parse(F.lit("not-json"))).alias("bad"), json.equal(F.parse_json(F.lit("1")), F.parse_json(F.lit('"1"'))).alias("loose"))


@add("SELECT event_id, pos::INTEGER AS pos, item FROM (SELECT event_id, unnest([0, 1]) AS pos, unnest([event_id::VARCHAR, event_type]) AS item FROM events)")
def json_iterate(spark, d):
    made = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(', "'), F.col("event_type"), F.lit('", null, 5]'))
    rows = ingest.read(spark, d, "events").select("event_id", json.parse(made).alias("v"))
    return json.iterate(rows, "v").select("event_id", "pos", "item")


@add("SELECT '1Customerp' || c_custkey AS id, 'Customer' AS type, c_mktsegment AS tag, c_name AS name FROM customer")
def node_json_export(spark, d):
    from ..sources.codec import decode, encode

    nodes = ingest.graph(spark, d, "Customer")
    back = decode(nodes.select("id", encode().alias("json")), "json")
    return back.select("id", "type", F.get("tags", F.lit(0)).alias("tag"), F.try_element_at("properties", F.lit("name")).alias("name"))


@add("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PDF (raw)' WHEN 1 THEN 'JPEG (raw)' WHEN 2 THEN 'PNG (raw)' WHEN 3 THEN 'NSKeyedArchive/Plist' ELSE 'Unknown' END AS kind, CASE event_id % 5 WHEN 0 THEN '25 50 44 46' WHEN 1 THEN 'FF D8 FF E0' WHEN 2 THEN '89 50 4E 47' WHEN 3 THEN '62 70 6C 69' ELSE '00 01' END AS head FROM events")
def binary_kinds(spark, d):
    heads = F.array(*map(F.lit, ("255044462D312E37", "FFD8FFE000104A46", "89504E470D0A1A0A", "62706C6973743030", "0001")))
    data = F.unhex(F.get(heads, F.pmod("event_id", F.lit(5)).cast("int")))
    return ingest.read(spark, d, "events").select("event_id", binary.data_kind(data).alias("kind"), binary.hex_header(data, 4).alias("head"))


@add("SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'text' WHEN url LIKE '%/' THEN 'directory' ELSE 'unknown' END AS kind FROM pages")
def file_types(spark, d):
    return ingest.read(spark, d, "pages").select("page_id", binary.file_type(F.col("url")).alias("kind"))


@add("SELECT page_id, left(regexp_replace(url, '[^\\p{L}\\p{M}\\p{N}_.-]', '_', 'g'), 80) AS name FROM pages")
def safe_names(spark, d):
    return ingest.read(spark, d, "pages").select("page_id", text.safe_component(F.col("url")).alias("name"))


# --- payload scan -----------------------------------------------------------
@add("SELECT '1Blobp' || event_id AS id, CASE event_id % 4 WHEN 0 THEN 'raw_ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'nil' ELSE 'failure' END AS outcome FROM events")
def payload_outcomes(spark, d):
    rest = F.pmod("event_id", F.lit(4))
    blob = F.when(rest == 0, F.unhex(F.lit("255044462D312E37"))).when(rest == 1, F.col("event_type").cast("binary"))
    rows = ingest.read(spark, d, "events")
    lost = ingest.property_("x", F.lit(None).cast("string"), "string")
    props = F.array(F.when(rest == 3, lost).otherwise(ingest.property_("x", blob, "data")))
    nodes = ingest.nodes_of(rows, E, "Blob", F.col("event_id"), props=props)
    return nodes.select("id", "node_class", "props").withColumn("props", F.transform("props", lambda p: p.withField("name", F.col("id")))).transform(scan.payloads).select(F.col("name").alias("id"), "outcome")


@add("SELECT count(*) AS total, count(*) AS ok, 0::BIGINT AS failures, 0::BIGINT AS raw_ok, 0::BIGINT AS nil FROM (SELECT unnest(CASE WHEN c_acctbal > 5000 THEN [1,2,3,4,5] ELSE [1,2,3,4] END) FROM customer)")
def payload_totals(spark, d):
    return scan.totals(scan.payloads(ingest.graph(spark, d, "Customer")))


@add("SELECT kind, n FROM (SELECT 'string' AS kind, 2 * count(*) AS n FROM customer UNION ALL SELECT 'double', count(*) FROM customer UNION ALL SELECT 'int', count(*) FROM customer UNION ALL SELECT 'bool', count(*) FROM customer WHERE c_acctbal > 5000)")
def payload_kinds(spark, d):
    return scan.histogram(scan.payloads(ingest.graph(spark, d, "Customer")), "kind")


# --- dedup ------------------------------------------------------------------
PART_KEY = {"Part": "name"}


def _parts(spark, d):
    return ingest.graph(spark, d, "Part", "order")


@add("SELECT 'Part' AS type, 'uuid' AS namespace, p_name AS value, count(*) AS members FROM part GROUP BY p_name HAVING count(*) > 1")
def dedup_groups(spark, d):
    return dedup.duplicate_groups(_parts(spark, d), dedup.field_key(PART_KEY))


SURVIVOR = "(SELECT '1Partp' || p_partkey AS id, min('1Partp' || p_partkey) OVER (PARTITION BY p_name) AS survivor, p_name, p_size, p_brand, p_type, p_retailprice FROM part)"


@add(f"SELECT id, survivor FROM {SURVIVOR} WHERE id <> survivor")
def dedup_replacements(spark, d):
    return dedup.replacements(_parts(spark, d), dedup.field_key(PART_KEY))


@add("SELECT id, survivor FROM (SELECT '1Partp' || p_partkey AS id, first_value('1Partp' || p_partkey) OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, '1Partp' || p_partkey) AS survivor FROM part) WHERE id <> survivor")
def dedup_survivor_rule(spark, d):
    return dedup.replacements(_parts(spark, d), dedup.field_key(PART_KEY), [-mutate.property_value("retailprice", "n")])


@add(f"SELECT survivor AS id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS tags, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS grps, max(CASE WHEN id = survivor THEN p_size END)::BIGINT AS size FROM {SURVIVOR} GROUP BY survivor HAVING count(*) > 1")
def dedup_metadata(spark, d):
    nodes = _parts(spark, d)
    made = dedup.merged_metadata(nodes, dedup.replacements(nodes, dedup.field_key(PART_KEY)))
    return made.select("id", F.array_join("tags", ",").alias("tags"), F.array_join("groups", ",").alias("grps"), mutate.property_value("size", "l").alias("size"))


NATION_KEY = {"Customer": "segment"}
CUSTOMER_SURVIVOR = "(SELECT '1Customerp' || c_custkey AS id, min('1Customerp' || c_custkey) OVER (PARTITION BY c_mktsegment) AS survivor, c_custkey, c_nationkey FROM customer)"


@add(f"SELECT survivor AS subject_id, '1Nationp' || c_nationkey AS object_id, count(*) AS merged, min('2inNationpc' || c_custkey) AS id FROM {CUSTOMER_SURVIVOR} GROUP BY survivor, c_nationkey UNION ALL SELECT '1Supplierp' || s_suppkey, '1Nationp' || s_nationkey, 1, '2inNationps' || s_suppkey FROM supplier")
def dedup_relationships(spark, d):
    nodes = ingest.graph(spark, d, "Customer", "inNation")
    made = dedup.rewired_relationships(nodes, dedup.replacements(nodes, dedup.field_key(NATION_KEY)))
    return made.groupBy("subject_id", "object_id").agg(F.count(F.lit(1)).alias("merged"), F.max(F.when(F.col("first"), F.col("id"))).alias("id"))


@add(f"SELECT '3orderp' || o_orderkey AS id, coalesce(string_agg(DISTINCT survivor, ',' ORDER BY survivor), '') AS objects FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN {SURVIVOR} s ON s.id = '1Partp' || l_partkey GROUP BY o_orderkey")
def dedup_actions(spark, d):
    nodes = _parts(spark, d)
    made = dedup.rewired_actions(nodes, dedup.replacements(nodes, dedup.field_key(PART_KEY)))
    return made.select("id", F.array_join("object_ids", ",").alias("objects"))


REPORT_SQL = """WITH s AS {s},
r AS (SELECT survivor, c_nationkey, c_custkey, id <> survivor AS changed, row_number() OVER (PARTITION BY survivor, c_nationkey ORDER BY '2inNationpc' || c_custkey) = 1 AS first FROM s)
SELECT (SELECT count(*) FROM s) AS scanned_entities, (SELECT count(*) FROM s) AS keyed_entities, 0::BIGINT AS unkeyed_entities,
 (SELECT count(*) FROM (SELECT survivor FROM s GROUP BY survivor HAVING count(*) > 1)) AS duplicate_groups, (SELECT count(*) FROM s WHERE id <> survivor) AS merged_entities,
 {deleted} AS deleted_entities, (SELECT count(*) FROM (SELECT survivor FROM s JOIN customer USING (c_custkey) GROUP BY survivor HAVING max(CASE WHEN id = survivor THEN c_acctbal END) <= 5000 AND max(c_acctbal) > 5000))::BIGINT AS copied_properties,
 {rewired} AS rewired_relationships, {gone} AS deleted_relationships, 0::BIGINT AS rewired_actions, 0::BIGINT AS deleted_actions, {skipped} AS skipped_items"""


def _report(policy: str, **sql: str) -> None:
    @add(REPORT_SQL.format(s=CUSTOMER_SURVIVOR, **sql), f"dedup_report_{policy}")
    def run(spark, d):
        return dedup.report(ingest.graph(spark, d, "Customer", "inNation"), dedup.field_key(NATION_KEY), policy)


_report("rewire_and_deduplicate", deleted="(SELECT count(*) FROM s WHERE id <> survivor)", rewired="(SELECT count(*) FROM r WHERE changed AND first)", gone="(SELECT count(*) FROM r WHERE changed OR NOT first)", skipped="0::BIGINT")
_report("rewire_only", deleted="(SELECT count(*) FROM s WHERE id <> survivor)", rewired="(SELECT count(*) FROM r WHERE changed)", gone="0::BIGINT", skipped="0::BIGINT")
_report("skip", deleted="0::BIGINT", rewired="0::BIGINT", gone="0::BIGINT", skipped="(SELECT count(*) FROM r WHERE changed)")


@add(f"SELECT 1::INTEGER AS node_class, (SELECT count(DISTINCT survivor) FROM {CUSTOMER_SURVIVOR}) AS n UNION ALL SELECT 2, (SELECT count(*) FROM (SELECT DISTINCT survivor, c_nationkey FROM {CUSTOMER_SURVIVOR})) + (SELECT count(*) FROM (SELECT DISTINCT s_suppkey FROM supplier))")
def dedup_result_counts(spark, d):
    nodes = ingest.graph(spark, d, "Customer", "inNation")
    return dedup.deduplicate(nodes, dedup.field_key(NATION_KEY)).groupBy("node_class").agg(F.count(F.lit(1)).alias("n"))


# --- merge ------------------------------------------------------------------
MERGE_FIELDS = {"Supplier": "name", "Nation": "name"}


def _merge(spark, d):
    return merge.merge(ingest.graph(spark, d, "Customer"), ingest.graph(spark, d, "Supplier", "Nation", "Region", "inNation", "inRegion"), MERGE_FIELDS, "second")


@add("SELECT 'Supplier' AS type, count(*) AS n, 0::BIGINT AS unmapped FROM supplier UNION ALL SELECT 'Nation', count(*), 0 FROM nation UNION ALL SELECT 'Region', count(*), count(*) FROM region")
def merge_entities(spark, d):
    made = _merge(spark, d).entities
    return made.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(exists("migrationUnmapped").column()).alias("unmapped"))


@add("SELECT 'inNation' AS type, count(*) AS n FROM supplier")
def merge_relationships(spark, d):
    return _merge(spark, d).relationships.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT (SELECT count(*) FROM supplier) + 30::BIGINT AS imported_entities, (SELECT count(*) FROM supplier) + 25::BIGINT AS mapped_entities, 5::BIGINT AS unmapped_entities, (SELECT count(*) FROM supplier) AS recreated_relationships, 25::BIGINT AS skipped_relationships, 0::BIGINT AS recreated_actions, 0::BIGINT AS skipped_actions")
def merge_report(spark, d):
    return _merge(spark, d).report


@add("SELECT n, count(*) AS actions FROM (SELECT o_orderkey, count(DISTINCT p_name) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey) GROUP BY n")
def merge_actions(spark, d):
    made = merge.merge(ingest.graph(spark, d, "Region"), ingest.graph(spark, d, "Customer", "Part", "order"), {"Customer": "name", "Part": "name"}, "second")
    return made.actions.groupBy(F.size("object_ids").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("actions"))


# --- structural validation --------------------------------------------------
@add("SELECT '1Customerp' || c_custkey || 'x' AS root, 1::BIGINT AS few, false AS valid FROM customer")
def validate_none(spark, d):
    nodes = ingest.graph(spark, d, "Customer")
    found = validate.verdicts(validate.references(nodes, nodes.select(F.concat("id", F.lit("x")).alias("id"))))
    return found.select("root", F.col("references").alias("few"), "valid")


@add("SELECT '2inNationpc' || c_custkey AS root, 6::BIGINT AS refs, 0::BIGINT AS unresolved, true AS valid FROM customer UNION ALL SELECT '2inNationps' || s_suppkey, 6, 1, false FROM supplier")
def validate_relationship(spark, d):
    nodes = ingest.graph(spark, d, "Customer", "Nation", "inNation")
    made = validate.verdicts(validate.references(nodes, traverse.relationships(nodes)))
    return made.select("root", F.col("references").alias("refs"), "unresolved", "valid")


@add("SELECT '3orderp' || o_orderkey AS root, (1 + 1 + greatest(count(DISTINCT l_partkey), 1) + 4)::BIGINT AS refs, count(DISTINCT CASE WHEN l_partkey <= 100 THEN l_partkey END) AS unresolved FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def validate_dangling(spark, d):
    nodes = ingest.graph(spark, d, "Customer", "Part", "order")
    low = (F.col("type") == "Part") & (F.regexp_extract("id", "p([0-9]+)$", 1).cast("long") <= 100)
    nodes = nodes.where(~low)
    made = validate.verdicts(validate.references(nodes, traverse.actions(nodes)))
    return made.select("root", F.col("references").alias("refs"), "unresolved")


@add("SELECT state, count(*) AS n FROM (SELECT 'absent' AS state FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'materialized' FROM orders UNION ALL SELECT 'materialized' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) GROUP BY state")
def validate_action_ends(spark, d):
    nodes = ingest.graph(spark, d, "Customer", "Part", "order")
    refs = validate.references(nodes, traverse.actions(nodes)).where("relationship in ('subjectSet', 'objectSet')")
    return refs.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@add("""WITH e AS (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation)
SELECT '1Nationp' || k AS root, relationship, CASE WHEN n = 0 AND relationship = 'relationshipObjectSet' OR relationship LIKE 'action%' THEN 'absent' ELSE 'materialized' END AS state, CASE relationship WHEN 'relationshipObjectSet' THEN greatest(n, 1) WHEN 'subject' THEN n + 1 WHEN 'object' THEN n + 1 ELSE 1 END AS n
FROM e, (SELECT unnest(['relationshipObjectSet', 'relationshipSubjectSet', 'actionObjectSet', 'actionSubjectSet', 'subject', 'object']) AS relationship)""")
def validate_entity(spark, d):
    nodes = ingest.graph(spark, d, *FEW, "inRegion", "inNation")
    refs = validate.references(nodes, nodes.where("type = 'Nation'").select("id")).where("relationship is not null and relationship not in ('tagSet', 'groupSet', 'propertySet')")
    return refs.groupBy("root", "relationship", "state").agg(F.count(F.lit(1)).alias("n"))


# --- change feed ------------------------------------------------------------
CHANGES = """(SELECT event_id // 50 AS tx, event_id % 50 AS change_index, CASE user_id % 3 WHEN 0 THEN 'me' WHEN 1 THEN 'remoteA' END AS author,
 CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, user_id % 3 + 1 AS family,
 CASE event_id % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'tag' WHEN 2 THEN 'group' ELSE 'property' END AS part,
 'x-store://' || CASE event_id % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'tag' WHEN 2 THEN 'group' ELSE 'property' END || '/' || (event_id % 977) AS object_uri,
 CASE WHEN event_id % 29 <> 0 THEN '1Userp' || user_id END AS owner_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS name FROM events)"""
#: The event kinds in the order of their rank.
KINDS = """(VALUES ('insert', 1, 'node', 'insertedEntity', 0), ('insert', 1, 'property', 'addedEntityProperty', 1), ('insert', 1, 'tag', 'addedEntityTag', 2),
 ('insert', 1, 'group', 'addedEntityToGroup', 3), ('update', 1, 'property', 'updatedEntityProperty', 4), ('delete', 1, 'property', 'removedEntityProperty', 5),
 ('delete', 1, 'tag', 'removedEntityTag', 6), ('delete', 1, 'group', 'removedEntityFromGroup', 7), ('delete', 1, 'node', 'deletedEntity', 8),
 ('insert', 2, 'node', 'insertedRelationship', 9), ('insert', 2, 'property', 'addedRelationshipProperty', 10), ('insert', 2, 'tag', 'addedRelationshipTag', 11),
 ('insert', 2, 'group', 'addedRelationshipToGroup', 12), ('update', 2, 'node', 'updatedRelationship', 13), ('update', 2, 'property', 'updatedRelationshipProperty', 14),
 ('delete', 2, 'property', 'removedRelationshipProperty', 15), ('delete', 2, 'tag', 'removedRelationshipTag', 16), ('delete', 2, 'group', 'removedRelationshipFromGroup', 17),
 ('delete', 2, 'node', 'deletedRelationship', 18), ('insert', 3, 'node', 'insertedAction', 19), ('insert', 3, 'property', 'addedActionProperty', 20),
 ('insert', 3, 'tag', 'addedActionTag', 21), ('insert', 3, 'group', 'addedActionToGroup', 22), ('update', 3, 'property', 'updatedActionProperty', 23),
 ('delete', 3, 'property', 'removedActionProperty', 24), ('delete', 3, 'tag', 'removedActionTag', 25), ('delete', 3, 'group', 'removedActionFromGroup', 26),
 ('delete', 3, 'node', 'deletedAction', 27)) AS k(op, family, part, event_kind, rank)"""
ME = "me"


@add(f"SELECT tx, change_index::INTEGER AS change_index, event_kind, rank FROM {CHANGES} JOIN {KINDS} USING (op, family, part)")
def feed_events(spark, d):
    return feed.events(ingest.changes(spark, d)).select("tx", "change_index", "event_kind", "rank")


@add(f"SELECT tx, change_index::INTEGER AS change_index, row_number() OVER (PARTITION BY tx ORDER BY rank, object_uri, name NULLS FIRST, change_index)::INTEGER AS position FROM {CHANGES} JOIN {KINDS} USING (op, family, part)")
def feed_order(spark, d):
    return feed.ordered(feed.events(ingest.changes(spark, d))).select("tx", "change_index", "position")


@add(f"SELECT author, count(*) AS n FROM {CHANGES} WHERE author IS NULL OR author <> 'me' GROUP BY author")
def feed_author_filter(spark, d):
    return feed.from_others(ingest.changes(spark, d), ME).groupBy("author").agg(F.count(F.lit(1)).alias("n"))


@add(f"""WITH c AS {CHANGES}, state AS (SELECT object_uri, max(CASE WHEN author = 'me' AND op = 'delete' THEN tx * 50 + change_index END) AS del, max(CASE WHEN op = 'insert' THEN tx * 50 + change_index END) AS ins, bool_or(op = 'delete' AND author IS DISTINCT FROM 'me') AS remote FROM c GROUP BY object_uri)
SELECT tx, change_index::INTEGER AS change_index, op FROM c JOIN state USING (object_uri) WHERE author IS DISTINCT FROM 'me' AND NOT (del IS NOT NULL AND (ins IS NULL OR del > ins)) AND (op = 'delete' OR NOT remote)""")
def feed_superseded(spark, d):
    return feed.surviving(ingest.changes(spark, d), ME).select("tx", "change_index", "op")


@add(f"SELECT CASE WHEN owner_id IS NOT NULL THEN 'none' WHEN op = 'delete' THEN 'unmaterialized' ELSE 'missing_owner' END AS problem, count(*) AS n FROM {CHANGES} JOIN {KINDS} USING (op, family, part) GROUP BY 1")
def feed_unmaterialized(spark, d):
    made = feed.resolved(feed.events(ingest.changes(spark, d)), ingest.graph(spark, d, "User"))
    return made.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@add(f"SELECT tx AS report_id, CASE WHEN author = 'me' THEN 'local' ELSE 'cloud' END AS source, count(*) AS events, min(rank) AS first_rank, max(rank) AS last_rank FROM {CHANGES} JOIN {KINDS} USING (op, family, part) GROUP BY 1, 2")
def feed_reports(spark, d):
    return feed.reports(feed.with_source(feed.events(ingest.changes(spark, d)), ME))


@add(f"SELECT coalesce(author, '') AS author, part, op, count(*) AS n FROM {CHANGES} GROUP BY ALL ORDER BY 1, 2, 3 LIMIT 64")
def history_summary(spark, d):
    return feed.history_summary(ingest.changes(spark, d))


@add(f"SELECT tx FROM {CHANGES} JOIN (SELECT event_id // 50 AS tx, event_id % 50 AS change_index, ts FROM events) USING (tx, change_index) ORDER BY ts DESC, tx DESC LIMIT 1")
def history_newest(spark, d):
    return feed.newest_transaction(ingest.changes(spark, d))


@add("SELECT DISTINCT user_id AS identifier, event_type AS phase FROM events")
def lifecycle_dedupe(spark, d):
    return feed.lifecycle(ingest.read(spark, d, "events").select(F.col("user_id").alias("identifier"), F.col("event_type").alias("phase")))


@add("SELECT user_id, generation, device, op_id FROM (SELECT user_id, event_id // 10 AS generation, event_type AS device, event_id AS op_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 10 DESC, event_type DESC, event_id::VARCHAR DESC) AS rn FROM events) WHERE rn = 1")
def ledger_latest(spark, d):
    return ledger.newest(_entries(spark, d)).select(F.col("migrationID").alias("user_id"), "generation", F.col("deviceID").alias("device"), F.col("operationID").cast("long").alias("op_id"))


def _entries(spark, d):
    """Events as entries of a ledger for each user."""
    e = ingest.read(spark, d, "events")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("started")
    own = {"migrationID": F.col("user_id"), "version": F.lit(1), "state": state, "deviceID": F.col("event_type"), "operationID": F.col("event_id").cast("string"), "generation": F.floor(F.col("event_id") / 10).cast("long")}
    return e.select(*(c.alias(n) for n, c in own.items()))


STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'started' END"


@add(f"SELECT user_id AS \"migrationID\", 1 AS version, count(*) FILTER ({STATE} = 'started') AS attempts, count(*) AS entries FROM events GROUP BY user_id")
def ledger_attempts(spark, d):
    return ledger.attempts(_entries(spark, d))


@add(f"SELECT {STATE} AS state, count(*) AS n, min(event_id // 10) AS first, max(event_id // 10) AS last FROM events GROUP BY 1")
def ledger_compaction(spark, d):
    return ledger.compaction(_entries(spark, d))


# --- states, gates and bounded history ------------------------------------------
def _users(spark, d, tag: str, which):
    user = mutate.property_value("user_id", "l")
    return mutate.change_labels(ingest.graph(spark, d, "User"), "tags", mutate.add, [tag], which(user))


@add(f"SELECT event_kind, count(*) AS n FROM {CHANGES} JOIN {KINDS} USING (op, family, part) WHERE owner_id IS NULL AND op = 'delete' OR substr(owner_id, 7)::BIGINT % 6 = 0 OR substr(owner_id, 7)::BIGINT < 5 GROUP BY event_kind")
def watch_old_new(spark, d):
    old = _users(spark, d, "old", lambda u: F.pmod(u, F.lit(3)) == 0)
    new = _users(spark, d, "new", lambda u: F.lit(True)).where(F.pmod(mutate.property_value("user_id", "l"), F.lit(2)) == 0)
    p = (has("old") & has("new")) | (prop("user_id") < 5)
    return feed.matching(feed.events(ingest.changes(spark, d)), feed.both_states(old, new), p).groupBy("event_kind").agg(F.count(F.lit(1)).alias("n"))


GATED = f"""WITH e AS (SELECT *, CASE WHEN author = 'me' THEN 'local' ELSE 'cloud' END AS source FROM {CHANGES.replace('event_id // 50', 'event_id // 5').replace('event_id % 50', 'event_id % 5')} JOIN {KINDS} USING (op, family, part)),
 d AS (SELECT DISTINCT tx, owner_id AS gone FROM e WHERE op = 'delete' AND part = 'node' AND owner_id IS NOT NULL),
 x AS (SELECT e.*, op <> 'delete' AND gone IS NULL AND (owner_id IS NULL OR substr(owner_id, 7)::BIGINT % 7 = 0) AS bad FROM e LEFT JOIN d ON d.tx = e.tx AND gone = owner_id),
 f AS (SELECT tx, bool_or(bad) AS failing FROM x WHERE source = 'cloud' GROUP BY tx),
 g AS (SELECT x.*, CASE WHEN source = 'cloud' AND failing THEN 'withheld' WHEN bad THEN 'dropped' ELSE 'delivered' END AS gate FROM x LEFT JOIN f USING (tx))"""


def _gated(spark, d):
    users = ingest.graph(spark, d, "User")
    verdicts = users.select(F.col("id").alias("root"), (F.pmod(mutate.property_value("user_id", "l"), F.lit(7)) != 0).alias("valid"))
    made = feed.with_source(feed.events(ingest.changes(spark, d, tx_rows=5)), ME)
    return feed.gated(feed.resolved(made, users), verdicts)


@add(GATED + " SELECT source, gate, count(*) AS n FROM g GROUP BY ALL")
def report_gate(spark, d):
    return _gated(spark, d).groupBy("source", "gate").agg(F.count(F.lit(1)).alias("n"))


@add(GATED + " SELECT tx, count(*) AS events FROM g WHERE gate = 'withheld' GROUP BY tx HAVING bool_or(owner_id IS NULL AND op <> 'delete')")
def report_missing_owner(spark, d):
    held = _gated(spark, d).where("gate = 'withheld'").groupBy("tx").agg(F.count(F.lit(1)).alias("events"), F.bool_or(F.expr("owner_id is null and op <> 'delete'")).alias("lost"))
    return held.where("lost").select("tx", "events")


DATED = f"(SELECT c.*, ts FROM {CHANGES} c JOIN (SELECT event_id // 50 AS tx, event_id % 50 AS change_index, ts FROM events) USING (tx, change_index))"


def _history(name: str, start: str, end: str) -> None:
    ranged = f"WITH r AS (SELECT * FROM {DATED} WHERE ts BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}'), t AS (SELECT count(*) AS total FROM r), s AS (SELECT * FROM r ORDER BY tx, change_index LIMIT 512)"

    @add(f"{ranged} SELECT author, part, op, n, total, total > 512 AS truncated FROM (SELECT coalesce(author, '') AS author, part, op, count(*) AS n FROM s GROUP BY ALL ORDER BY 1, 2, 3 LIMIT 64), t", name)
    def run(spark, d):
        return feed.history_between(ingest.changes(spark, d), dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end))


_history("history_between", "2024-01-05", "2024-01-06")
_history("history_truncated", "2024-01-02", "2024-01-29")


@add(f"WITH c AS {CHANGES} SELECT tx, change_index::INTEGER AS change_index FROM c WHERE op = 'delete' AND author IS DISTINCT FROM 'me' AND object_uri NOT IN (SELECT object_uri FROM c WHERE op = 'delete' AND author = 'me')")
def captured_deletions(spark, d):
    gone = ingest.changes(spark, d).where("op = 'delete'")
    return feed.not_captured(feed.from_others(gone, ME), gone.where(F.col("author") == ME)).select("tx", "change_index")


@add(f"SELECT tx, change_index::INTEGER AS change_index, row_number() OVER (PARTITION BY tx ORDER BY CASE op WHEN 'insert' THEN 0 WHEN 'update' THEN 1 ELSE 2 END, object_uri, change_index)::INTEGER AS position FROM {CHANGES}")
def change_order(spark, d):
    return feed.change_order(ingest.changes(spark, d)).select("tx", "change_index", "position")


@add("SELECT user_id AS store, identifier FROM (SELECT user_id, event_id AS identifier, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_id % 3 = 0 AS was_empty FROM events WHERE event_type <> 'error') WHERE rn = 1 AND was_empty")
def initial_import(spark, d):
    rows = ingest.read(spark, d, "events").select(F.col("user_id").alias("store"), F.col("event_id").alias("identifier"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), (F.pmod("event_id", F.lit(3)) == 0).alias("empty"))
    return feed.initial_imports(rows)


# --- projections, stores and survivors -------------------------------------------
@add("SELECT '1Customerp' || c_custkey AS id, c_name AS name, c_acctbal AS acctbal, CASE WHEN c_acctbal > 5000 THEN 5 ELSE 4 END::INTEGER AS n, CASE WHEN c_acctbal > 5000 THEN '1' END AS vip FROM customer")
def nodes_property_map(spark, d):
    m = mutate.properties_map()
    rows = ingest.graph(spark, d, "Customer").select("id", m.alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return rows.select("id", at("name").alias("name"), at("acctbal").cast("double").alias("acctbal"), F.size("m").alias("n"), at("vip").alias("vip"))


@add("SELECT '[nodeClass: 1, id: 1Nationp' || n_nationkey || ', type: Nation, tags: [], groups: [region' || n_regionkey || '], properties: [name: ' || n_name || ', regionkey: ' || n_regionkey || '], createdDate: nil]' AS line FROM nation UNION ALL SELECT '[nodeClass: 2, id: 2inRegionp' || n_nationkey || ', type: inRegion, tags: [], groups: [], properties: [], subject: 1Nationp' || n_nationkey || ', object: 1Regionp' || n_regionkey || ', createdDate: nil]' FROM nation")
def node_descriptions(spark, d):
    return ingest.graph(spark, d, "Nation", "inRegion").select(mutate.description().alias("line"))


@add("SELECT (SELECT count(*) FROM nation) AS entities, (SELECT count(*) FROM nation) AS relationships, 0::BIGINT AS actions, false AS empty")
def store_emptiness(spark, d):
    return scan.emptiness(ingest.graph(spark, d, "Nation", "inRegion"))


@add("SELECT id, survivor FROM (SELECT '1Partp' || p_partkey AS id, first_value('1Partp' || p_partkey) OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, '1Partp' || p_partkey) AS survivor FROM part) WHERE id <> survivor")
def survivor_chooser(spark, d):
    dearer = lambda a, b: b if b["price"] > a["price"] else a
    return dedup.chosen(_parts(spark, d), dedup.field_key(PART_KEY), {"price": mutate.property_value("retailprice", "n")}, dearer)


@add("SELECT event_id, event_id AS whole, NULL::BIGINT AS of_text, NULL::BIGINT AS of_fraction, NULL::VARCHAR AS of_number, event_id::DOUBLE AS number, event_type AS word, true AS flag, NULL::BOOLEAN AS no_flag FROM events")
def json_typed_kinds(spark, d):
    made = F.concat(F.lit('{"n": '), F.col("event_id").cast("string"), F.lit(', "s": "1", "f": 1.7, "b": true, "w": "'), F.col("event_type"), F.lit('"}'))
    rows = ingest.read(spark, d, "events").select("event_id", json.parse(made).alias("v"))
    t = lambda key, kind: json.typed(json.member(F.col("v"), key), kind)
    return rows.select("event_id", t("n", "long").alias("whole"), t("s", "long").alias("of_text"), t("f", "long").alias("of_fraction"), t("n", "string").alias("of_number"), t("n", "double").alias("number"), t("w", "string").alias("word"), t("b", "boolean").alias("flag"), t("n", "boolean").alias("no_flag"))


@add("SELECT event_id, 'x' AS word, '7' AS number, 'true' AS flag, '[1,\"a\"]' AS list, '{\"k\":null}' AS members, true AS nothing FROM events")
def json_literals(spark, d):
    show = lambda v: json.stringify(json.literal(v))
    return ingest.read(spark, d, "events").select("event_id", show("x").alias("word"), show(7).alias("number"), show(True).alias("flag"), show([1, "a"]).alias("list"), show({"k": None}).alias("members"), json.is_null(json.literal(None)).alias("nothing"))


@add("SELECT page_id FROM pages WHERE page_id % 3 = 0")
def fold_other_scripts(spark, d):
    """Stored text in other scripts is found by the same text as a literal."""
    word = F.element_at(F.array(*map(F.lit, ("가나", "がく", "ДЁМ", "ΆΛΦΑ", "हिन्दी", "שָׁלוֹם"))), (F.pmod("page_id", F.lit(6)) + 1).cast("int"))
    rows = ingest.read(spark, d, "pages").where("page_id is not null")
    nodes = ingest.nodes_of(rows, E, "Word", F.col("page_id"), props=ingest.properties(("w", word, "string"), ("page_id", F.col("page_id"), "int")))
    # every word that stands at 0 and 3 modulo 6
    return Search(nodes, E).where(prop("w") == "가나").where(prop("w") == "άλφα").run().select(mutate.property_value("page_id", "l").alias("page_id"))


# --- typed decoding, payload errors, owners and orders ---------------------------
def _typed(spark, d):
    """Events as nodes with a property of every kind."""
    e = ingest.read(spark, d, "events")
    n, word = F.col("event_id"), F.col("event_type")
    listed = F.concat(F.lit("["), n.cast("string"), F.lit(',"x"]'))
    props = ingest.properties(("n", n, "int"), ("half", n + 0.5, "double"), ("flag", n % 2 == 0, "bool"), ("word", word, "string"), ("at", F.col("ts").cast("timestamp_ntz"), "date"), ("raw", word.cast("binary"), "data"), ("site", F.concat(F.lit("http://h/"), word), "url"), ("list", listed, "array"), ("members", F.lit('{"k":1}'), "dict"))
    return ingest.nodes_of(e, A, "Typed", n, props=props)


@add("SELECT '3Typedp' || event_id AS id, event_id AS n, event_id + 0.5::DOUBLE AS half, (event_id % 2 = 0)::INTEGER::BIGINT AS flag, event_type AS word, ts::TIMESTAMP AS at, hex(event_type::BLOB) AS raw, 'http://h/' || event_type AS site, '[' || event_id || ',\"x\"]' AS list, '{\"k\":1}' AS members, 'array bool data date dict double int string url' AS kinds FROM events")
def decode_typed(spark, d):
    """What is written as JSON comes back with its kinds."""
    back = _typed(spark, d).select("id", codec.decode_properties(codec.encode()).alias("props"))
    value = mutate.property_value
    slots = {"n": "l", "half": "n", "flag": "l", "word": "s", "at": "d", "site": "s", "list": "j", "members": "j"}
    kinds = F.array_join(F.array_sort(F.transform("props", lambda p: p["kind"])), " ")
    return back.select("id", *(value(name, slot).alias(name) for name, slot in slots.items()), F.hex(value("raw", "b")).alias("raw"), kinds.alias("kinds"))


@add("SELECT '1Nationp' || n_nationkey AS root, n_nationkey % 5 <> 0 AS valid, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS unresolved FROM nation")
def validate_payloads(spark, d):
    """A property whose payload does not decode is an unresolved reference."""
    nations = ingest.graph(spark, d, "Nation")
    nodes = mutate.set_property(nations, ingest.property_("broken", F.lit(None), "int"), F.pmod(F.regexp_extract("id", r"(\d+)$", 1).cast("long"), F.lit(5)) == 0)
    return validate.verdicts(validate.references(nodes, nodes.select("id"))).select("root", "valid", "unresolved")


@add("SELECT '1Partp' || id AS id, most, members, own FROM (SELECT arg_min(p_partkey, '1Partp' || p_partkey) AS id, max(p_retailprice) AS most, count(*) AS members, arg_min(p_retailprice, '1Partp' || p_partkey) AS own FROM part GROUP BY p_name HAVING count(*) > 1)")
def metadata_merger(spark, d):
    nodes = _parts(spark, d)
    merge_ = {"most": F.max("price"), "members": F.count(F.lit(1)), "own": F.max(F.when(F.col("is_survivor"), F.col("price")))}
    return dedup.merged_by(nodes, dedup.replacements(nodes, dedup.field_key(PART_KEY)), {"price": mutate.property_value("retailprice", "n")}, merge_)


@add(f"SELECT tx, change_index::INTEGER AS change_index, object_uri FROM {CHANGES} JOIN {KINDS} USING (op, family, part) WHERE op = 'delete' AND owner_id IS NULL")
def unmaterialized_deletions(spark, d):
    return feed.unmaterialized(feed.events(ingest.changes(spark, d)), ingest.graph(spark, d, "User")).select("tx", "change_index", "object_uri")


@add(f"SELECT tx, ts::TIMESTAMP AS ts, n AS changes, row_number() OVER (ORDER BY tx, ts) - 1 AS position FROM (SELECT tx, min(ts) AS ts, count(*) AS n FROM {DATED} GROUP BY tx)")
def transaction_order(spark, d):
    return feed.transactions(ingest.changes(spark, d))


@add(f"SELECT tx, change_index::INTEGER AS change_index, CASE WHEN owner_id IS NOT NULL THEN 'User' END AS type FROM {CHANGES}")
def owner_lookup(spark, d):
    """The node of a tag, group or property; none if there is no owner."""
    details = ingest.changes(spark, d).select("tx", "change_index", "owner_id")
    return traverse.owners(ingest.graph(spark, d, "User"), details).select("tx", "change_index", F.col("owner_type").alias("type"))


@add("SELECT DISTINCT event_type, lower(lpad(to_hex((list_reduce(list_transform(string_split(event_type, ''), lambda c: ascii(c)::HUGEINT), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT))::UBIGINT), 16, '0')) AS hash FROM events")
def fnv_hash(spark, d):
    return ingest.read(spark, d, "events").select("event_type", text.fnv1a_column(F.col("event_type")).alias("hash")).distinct()


@add("SELECT event_id, '[' || event_id || ',\"new\"]' AS list, '{\"k\":' || event_id || '}' AS members, NULL::VARCHAR AS scalar FROM events")
def json_set_and_serialize(spark, d):
    rows = ingest.read(spark, d, "events")
    n = F.col("event_id").cast("string")
    listed = json.set_item(F.array(n, F.lit("old")), 1, F.lit("new"))
    made = F.concat(F.lit("["), F.get(listed, F.lit(0)), F.lit(',"'), F.get(listed, F.lit(1)), F.lit('"]'))
    members = json.set_member(F.create_map(F.lit("k"), F.lit("0")), "k", n)
    shown = F.concat(F.lit('{"k":'), F.try_element_at(members, F.lit("k")), F.lit("}"))
    out = lambda c: json.serialize(json.parse(c))
    return rows.select("event_id", out(made).alias("list"), out(shown).alias("members"), out(n).alias("scalar"))


@add("SELECT '1Nationp' || n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN TIMESTAMP '2001-02-03 04:05:06' END AS created_date FROM nation")
def set_created_date(spark, d):
    nodes = ingest.graph(spark, d, "Nation")
    return mutate.set_created_date(nodes, F.lit("2001-02-03 04:05:06").cast("timestamp_ntz"), mutate.property_value("regionkey", "l") == 1).select("id", "created_date")
