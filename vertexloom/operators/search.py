"""Search over one family of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..schema import NodeClass
from ..sources.lineage import cut, numbered
from .predicate import Predicate

_pool = ThreadPoolExecutor(max_workers=4, thread_name_prefix="search")


class Search:
    """``Search(nodes, NodeClass.ENTITY).where(p).run()``.

    Predicates given one after another are alternatives; none match nothing.
    The full predicate is applied before ``offset`` rows are skipped, in the
    order of ids.
    """

    def __init__(self, nodes: DataFrame, family: NodeClass, offset: int = 0):
        self.nodes, self.family, self.offset, self.predicate = nodes, family, offset, None

    def where(self, predicate: Predicate) -> Search:
        self.predicate = predicate if self.predicate is None else self.predicate | predicate
        return self

    def clear(self) -> Search:
        self.predicate = None
        return self

    def run(self) -> DataFrame:
        rows = self.nodes.where(f"node_class = {int(self.family)}")
        rows = rows.where("false") if self.predicate is None else rows.where(self.predicate.column())
        return numbered(rows, ["id"], "_place").where(F.col("_place") >= self.offset).drop("_place") if self.offset else rows

    def start(self) -> Future:
        """A future of the result as a written table; no row comes to the driver."""
        return _pool.submit(lambda: cut(self.run()))

    def batches(self, size: int) -> Iterator[list[Row]]:
        """The rows in lists of ``size``, one partition at a time."""
        rows = self.run().toLocalIterator(prefetchPartitions=True)
        while part := list(islice(rows, size)):
            yield part

    def __add__(self, other: Search) -> Search:
        if self.family != other.family or self.nodes is not other.nodes:
            raise ValueError("searches over different graphs or families")
        both = Search(self.nodes, self.family, self.offset)
        for side in (self, other):
            if side.predicate is not None:
                both.where(side.predicate)
        return both
