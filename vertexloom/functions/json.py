"""JSON accessors over VARIANT columns.

Wrong kinds, missing keys and indexes out of range give null; invalid text
parses to null.  Two values are equal if their strings are (so 1 equals "1").
"""

from __future__ import annotations

from json import dumps, loads

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def stringify(value: Column) -> Column:
    """Scalars raw, containers as JSON; null as ``null``."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("null"))


def serialize(value: Column) -> Column:
    """JSON text of an object or array; null for anything else."""
    kind = F.schema_of_variant(value)
    return F.when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.to_json(value))


def item(value: Column, index: int) -> Column:
    return F.try_variant_get(value, f"$[{index}]", "variant") if index >= 0 else F.parse_json(F.lit(None).cast("string"))


def member(value: Column, key: str) -> Column:
    escaped = key.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(value, f'$["{escaped}"]', "variant")


def kind_of(value: Column) -> Column:
    """``string``, ``bool``, ``int``, ``double``, ``array`` or ``object``; null
    for anything else."""
    schema = F.schema_of_variant(value)
    known = (("STRING", "string"), ("BOOLEAN", "bool"), ("BIGINT", "int"), ("DECIMAL", "double"), ("DOUBLE", "double"), ("FLOAT", "double"), ("ARRAY", "array"), ("OBJECT", "object"))
    kind = F.lit(None).cast("string")
    for start, name in known:
        kind = F.when(F.startswith(schema, F.lit(start)), name).otherwise(kind)
    return kind


def typed(value: Column, kind: str) -> Column:
    """The value as a Spark type; null where it is of another kind.  A whole
    number counts as any number, a fraction as no whole number."""
    found, got = kind_of(value), F.try_variant_get(value, "$", kind)
    if kind in ("tinyint", "smallint", "int", "integer", "long", "bigint"):
        return F.when((found == "int") | ((found == "double") & (F.try_variant_get(value, "$", "double") == got)), got)
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.when(found.isin("int", "double"), got)
    return F.when(found == {"boolean": "bool"}.get(kind, kind), got) if kind in ("string", "boolean") else got


def literal(value) -> Column:
    """A JSON value of None, a string, number, bool, list or dict; a Column is
    a value already."""
    return value if isinstance(value, Column) else F.parse_json(F.lit(dumps(value)))


def is_null(value: Column) -> Column:
    """Whether there is no value, or the value null."""
    return value.isNull() | F.is_variant_null(value)


def description(text: str) -> str:
    """JSON text laid out over lines, members in order of their names."""
    return dumps(loads(text), indent=2, sort_keys=True, ensure_ascii=False)


def equal(left: Column, right: Column) -> Column:
    return stringify(left) == stringify(right)


def set_item(items: Column, index: int, new: Column) -> Column:
    """An array with one element replaced; unchanged if out of range."""
    return F.transform(items, lambda x, i: F.when(i == index, new).otherwise(x))


def set_member(members: Column, key: str, new: Column) -> Column:
    """A map with one key set."""
    return F.map_concat(F.map_filter(members, lambda k, _: k != key), F.create_map(F.lit(key), new))


def iterate(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with (pos, item) of each element of the array in ``value``, as
    strings, up to the first null (a string ``null`` counts as one)."""
    items = F.expr(f"try_cast(try_variant_get({value}, '$', 'array<variant>') as array<string>)")
    found = F.transform(items, lambda x: F.coalesce(x, F.lit("null")))
    end = F.array_position(found, "null")
    kept = F.when(end > 0, F.slice(found, 1, (end - 1).cast("int"))).otherwise(found)
    return rows.select("*", F.posexplode(kept).alias("pos", "item"))
