"""A store without files: the same calls, versions kept as plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..schema import NODES
from .store import StoreBusy, diff


class MemoryStore:
    def __init__(self, spark: SparkSession, author: str = "me"):
        self.spark, self.author, self._busy = spark, author, False
        self._versions = [spark.createDataFrame([], NODES)]
        self._log: list[DataFrame] = []

    @property
    def version(self) -> int:
        return len(self._versions) - 1

    def nodes(self, version: int | None = None) -> DataFrame:
        return self._versions[self.version if version is None else version]

    def changes(self, after: int = -1) -> list[DataFrame]:
        """One table of changes a version."""
        return self._log[max(0, after):]

    def transaction(self, body: Callable[[DataFrame], DataFrame]) -> int:
        if self._busy:
            raise StoreBusy("a transaction is open")
        self._busy = True
        try:
            before = self.nodes()
            after = body(before).select(before.columns)
            self._log.append(diff(before, after, self.version + 1, self.author))
            self._versions.append(after)
            return self.version
        finally:
            self._busy = False

    def read_snapshot(self, body: Callable[[DataFrame], object]):
        return body(self.nodes())

    def clear(self) -> int:
        return self.transaction(lambda nodes: nodes.where("false"))
