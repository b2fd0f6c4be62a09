"""What a transaction is about to change, and what it did, in bounded reports."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_groups(changes: DataFrame, *, most: int = 20) -> tuple[DataFrame, int]:
    """(op, part, name, n) of the largest groups of changes, and how many
    groups are left out."""
    groups = changes.groupBy("op", "part", F.coalesce("name", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return groups.orderBy(F.desc("n"), "op", "part", "name").limit(most), max(0, groups.count() - most)


def pending_values(changes: DataFrame, *, most: int = 100, chars: int = 2048) -> DataFrame:
    """The first changes with their values, shortened: for debugging only."""
    return changes.orderBy("object_uri").limit(most).select("op", "object_uri", "name", F.substring("value", 1, chars).alias("value"))


@dataclass
class Trace:
    """Seconds since its start of each stage that a transaction passes."""

    stages: list[tuple[str, float]] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)
    outcome: str = "open"

    def mark(self, stage: str) -> None:
        self.stages.append((stage, time.monotonic() - self.began))


def traced(store, body) -> tuple[int | None, Trace]:
    """Run a transaction of ``store`` with a trace of it; errors go through."""
    trace = Trace()
    trace.mark("begin")

    def run(nodes: DataFrame) -> DataFrame:
        trace.mark("body")
        made = body(nodes)
        trace.mark("save")
        return made

    try:
        version = store.transaction(run)
    except Exception:
        trace.outcome = "failed"
        trace.mark("end")
        raise
    trace.outcome = "committed"
    trace.mark("end")
    return version, trace
