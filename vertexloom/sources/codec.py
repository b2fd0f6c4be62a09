"""Nodes as JSON documents, and tagged values within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import kind_of
from ..functions.text import fold_column
from ..schema import PROPERTY

SHAPE = "type string, tags array<string>, groups array<string>, properties map<string, string>, createdDate timestamp_ntz"
#: Key that marks a date, binary or url value, beside ``value``.
TAG = "__codable_type"


def _quoted(text: Column) -> Column:
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _tagged(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f'{{"{TAG}":"{kind}","value":'), value, F.lit("}"))


def value_json(p: Column) -> Column:
    """A property's value as JSON: dates are epoch seconds, bytes base64."""
    seconds = (F.unix_micros(p["d"].cast("timestamp")) / 1e6).cast("string")
    return (
        F.when(p["kind"] == "string", _quoted(p["s"]))
        .when(p["kind"] == "url", _tagged("url", _quoted(p["s"])))
        .when(p["kind"] == "int", p["l"].cast("string"))
        .when(p["kind"] == "double", p["n"].cast("string"))
        .when(p["kind"] == "bool", (p["n"] == 1).cast("string"))
        .when(p["kind"] == "date", _tagged("date", seconds))
        .when(p["kind"] == "data", _tagged("data", _quoted(F.base64(p["b"]))))
        .when(p["kind"].isin("array", "dict"), p["j"])
        .otherwise(F.lit("null"))
    )


def encode() -> Column:
    """Each node as JSON with type, tags, groups, properties and (if there is
    one) createdDate."""
    members = F.array_join(F.transform("props", lambda p: F.concat(_quoted(p["name"]), F.lit(":"), F.coalesce(value_json(p), F.lit("null")))), ",")
    date = F.coalesce(F.concat(F.lit(',"createdDate":"'), F.date_format("created_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"')), F.lit(""))
    return F.concat(F.lit('{"type":'), _quoted(F.col("type")), F.lit(',"tags":'), F.to_json("tags"), F.lit(',"groups":'), F.to_json("groups"), F.lit(',"properties":{'), members, F.lit("}"), date, F.lit("}"))


def decode(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with type, tags, groups, properties (as JSON text or raw
    scalars) and created_date from the JSON in ``column``; missing tags and
    groups are empty, a missing date is now, invalid JSON is null."""
    read = F.from_json(column, SHAPE)
    none = F.array().cast("array<string>")
    return rows.withColumn("_n", read).select(*rows.columns, F.col("_n.type").alias("type"), F.coalesce("_n.tags", none).alias("tags"), F.coalesce("_n.groups", none).alias("groups"), F.col("_n.properties").alias("properties"), F.coalesce("_n.createdDate", F.current_timestamp().cast("timestamp_ntz")).alias("created_date"))


def _decoded(name: Column, value: Column) -> Column:
    """One property of a JSON value, with the kind that it was written as."""
    own = lambda path, kind: F.try_variant_get(value, path, kind)
    found = kind_of(value)
    tag = F.when(found == "object", own(f"$.{TAG}", "string"))
    tagged = F.coalesce(tag.isin("date", "data", "url"), F.lit(False))
    kind = F.when(tagged, tag).when(found == "object", "dict").otherwise(F.coalesce(found, F.lit("null")))
    number = F.when(found == "bool", own("$", "boolean").cast("double")).when(found.isin("int", "double"), own("$", "double"))
    text = F.when(kind == "url", own("$.value", "string")).when(kind == "string", own("$", "string"))
    slots = {
        "name": name,
        "name_fold": fold_column(name),
        "kind": kind,
        "s": text,
        "s_fold": fold_column(text),
        "n": number,
        "l": F.when(found == "bool", own("$", "boolean").cast("long")).when(found == "int", own("$", "long")),
        "d": F.when(kind == "date", F.timestamp_micros(F.round(own("$.value", "double") * 1e6).cast("long"))),
        "b": F.when(kind == "data", F.try_to_binary(own("$.value", "string"), F.lit("base64"))),
        "j": F.when(kind.isin("array", "dict"), F.to_json(value)),
        "app_data_version": F.lit(0),
    }
    return F.struct(*(slots[f.name].cast(f.dataType).alias(f.name) for f in PROPERTY))


def decode_properties(text: Column) -> Column:
    """The properties of a node's JSON with their kinds: tagged dates, binary
    values and urls, strings, whole numbers, fractions, truth values, arrays,
    dictionaries and nulls.  Invalid JSON has none; a tagged value that does
    not decode has empty slots."""
    members = F.try_variant_get(F.try_parse_json(text), "$.properties", "map<string, variant>")
    made = F.transform(F.map_entries(members), lambda e: _decoded(e["key"], e["value"]))
    return F.coalesce(made, F.array().cast("array<" + PROPERTY.simpleString() + ">"))
