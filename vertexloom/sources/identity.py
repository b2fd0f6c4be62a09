"""Looking up remote record ids of nodes, in the order they were asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame


def record_ids(asked: DataFrame, mapping: DataFrame) -> DataFrame:
    """(pos, id, record_id) for each row of ``asked(pos, id)``; repeats are kept
    and an unknown id has a null record.  mapping: (id, record_id), an id once."""
    return asked.select("pos", "id").join(mapping.select("id", "record_id"), "id", "left").select("pos", "id", "record_id")
