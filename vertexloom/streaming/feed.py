"""The change feed: from a log of committed changes to typed event reports.

The batch functions are plain DataFrame plans; ``Watch`` runs them over a
streaming read of the log with ``foreachBatch``.  A batch that raises before
it is delivered is not committed, and is read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.predicate import Predicate
from ..schema import CHANGES, EVENT_KINDS
from ..sources.lineage import numbered


def event_kind() -> Column:
    kind = F.lit(None).cast("string")
    for op, family, part, name in EVENT_KINDS:
        kind = F.when((F.col("op") == op) & (F.col("family") == family) & (F.col("part") == part), name).otherwise(kind)
    return kind


def event_rank() -> Column:
    rank = F.lit(None).cast("int")
    for i, (_, _, _, name) in enumerate(EVENT_KINDS):
        rank = F.when(F.col("event_kind") == name, i).otherwise(rank)
    return rank


def from_others(changes: DataFrame, me: str) -> DataFrame:
    """Changes by other authors; an unknown author counts as another."""
    return changes.where(F.col("author").isNull() | (F.col("author") != me))


def with_source(changes: DataFrame, me: str) -> DataFrame:
    return changes.withColumn("source", F.when(F.col("author") == me, "local").otherwise("cloud"))


def events(changes: DataFrame) -> DataFrame:
    """Changes as events; operations that mean none for their row are left out."""
    made = changes.withColumn("event_kind", event_kind()).where("event_kind is not null")
    return made.withColumn("rank", event_rank())


ORDER = ("tx", "rank", "object_uri", "name", "change_index")


def ordered(made: DataFrame, *, most_rows: int = 1_000_000) -> DataFrame:
    """Events with ``position`` within their transaction: by rank, object, name
    and place.  Transactions order the feed; numbering restarts in each.

    If a transaction (a bulk import) has more than ``most_rows`` events, rows
    are numbered by ranges of the whole order instead of a task a transaction.
    """
    return _placed(made, ORDER, most_rows)


def change_order(changes: DataFrame, *, most_rows: int = 1_000_000) -> DataFrame:
    """Changes with ``position`` within their transaction: by kind of change
    (insert, update, delete), object and place in the log."""
    kind = F.when(F.col("op") == "insert", 0).when(F.col("op") == "update", 1).otherwise(2)
    return _placed(changes.withColumn("_kind", kind), ("tx", "_kind", "object_uri", "change_index"), most_rows).drop("_kind")


def _placed(rows: DataFrame, by: tuple[str, ...], most_rows: int) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in by]
    if rows.groupBy("tx").count().where(F.col("count") > most_rows).isEmpty():
        return rows.withColumn("position", F.row_number().over(Window.partitionBy("tx").orderBy(*order[1:])))
    placed = numbered(rows, order, "_place")
    first = placed.groupBy("tx").agg(F.min("_place").alias("_first"))
    return placed.join(first, "tx").withColumn("position", (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first")


def not_captured(deletions: DataFrame, captured: DataFrame) -> DataFrame:
    """Deletions of objects that are not among those captured before a save."""
    return deletions.join(captured.select("object_uri").distinct(), "object_uri", "left_anti").select(deletions.columns)


def both_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes that carry their old and their new labels and properties: what a
    watch's predicate looks at, so that it also sees what was taken away."""
    o, n = old.alias("o"), new.alias("n")
    columns = []
    for name, kind in old.dtypes:
        a, b = F.col(f"o.{name}"), F.col(f"n.{name}")
        if kind.startswith("array"):
            empty = F.array().cast(kind)
            columns.append(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)).alias(name))
        else:
            columns.append(F.coalesce(b, a).alias(name))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(columns)


def matching(made: DataFrame, state: DataFrame, predicate: Predicate) -> DataFrame:
    """Events whose owner in ``state`` fits, and deletions of what no state
    tells of: these can't be judged and are not withheld."""
    owners = made.select(F.col("owner_id").alias("id")).distinct()
    known = state.join(owners, "id", "left_semi").select(F.col("id").alias("owner_id"), F.coalesce(predicate.column(), F.lit(False)).alias("_fits"))
    return made.join(known, "owner_id", "left").where(F.coalesce("_fits", F.col("op") == "delete")).select(made.columns)


def gated(made: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Events from ``resolved`` with ``gate``: a local event whose owner is
    missing or not valid (``verdicts(root, valid)``) is ``dropped``; a cloud
    report that holds such an event is ``withheld`` as a whole; all else is
    ``delivered``.  Owners that the report itself deletes are not judged."""
    deleted = made.where("op = 'delete' and part = 'node' and owner_id is not null").select("tx", "owner_id", F.lit(True).alias("_gone")).distinct()
    told = verdicts.select(F.col("root").alias("owner_id"), "valid")
    x = made.join(deleted, ["tx", "owner_id"], "left").join(told, "owner_id", "left")
    bad = (F.col("op") != "delete") & F.col("_gone").isNull() & (F.coalesce(F.col("problem") == "missing_owner", F.lit(False)) | ~F.coalesce("valid", F.lit(True)))
    x = x.withColumn("_bad", bad)
    failing = x.where("_bad and source = 'cloud'").select("tx", "source", F.lit(True).alias("_failing")).distinct()
    gate = F.when(F.col("_failing"), "withheld").when(F.col("_bad"), "dropped").otherwise("delivered")
    return x.join(failing, ["tx", "source"], "left").withColumn("gate", gate).select(*made.columns, "gate")


class ReportWithheld(Exception):
    """A cloud report has an owner that is missing or not valid; it is read again."""


def surviving(changes: DataFrame, me: str) -> DataFrame:
    """Remote changes that are not superseded.

    An object that this author deleted (and that nobody inserted again) hides
    all remote changes of it; one that a remote author deleted hides remote
    inserts and updates but not the deletions.
    """
    at = F.struct("tx", "change_index")
    mine = F.coalesce(F.col("author") == me, F.lit(False))
    state = changes.groupBy("object_uri").agg(
        F.max(F.when(mine & (F.col("op") == "delete"), at)).alias("local_delete"),
        F.max(F.when(F.col("op") == "insert", at)).alias("insert"),
        F.bool_or(~mine & (F.col("op") == "delete")).alias("remote_deleted"),
    )
    gone = F.coalesce(F.col("local_delete").isNotNull() & (F.col("insert").isNull() | (F.col("local_delete") > F.col("insert"))), F.lit(False))
    return from_others(changes, me).join(state.select("object_uri", gone.alias("gone"), "remote_deleted"), "object_uri").where(~F.col("gone") & ((F.col("op") == "delete") | ~F.col("remote_deleted"))).select(*changes.columns)


def resolved(made: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with ``owner_type`` and ``problem``: a detail without its owner is
    ``unmaterialized`` if it is a deletion, else ``missing_owner``."""
    owner = nodes.select(F.col("id").alias("owner_id"), F.col("type").alias("owner_type"))
    found = made.join(owner, "owner_id", "left")
    return found.withColumn("problem", F.when(F.col("owner_type").isNotNull(), None).when(F.col("op") == "delete", "unmaterialized").otherwise("missing_owner"))


def unmaterialized(made: DataFrame, nodes: DataFrame) -> DataFrame:
    """Deletions of details whose owners are gone, in the order of their URIs."""
    return resolved(made, nodes).where("problem = 'unmaterialized'").select(made.columns).orderBy("object_uri", "tx", "change_index")


def transactions(changes: DataFrame) -> DataFrame:
    """(tx, ts, changes, position): transactions by number, time and place of
    their first change, numbered from 0."""
    found = changes.groupBy("tx").agg(F.min("ts").alias("ts"), F.min("change_index").alias("_first"), F.count(F.lit(1)).alias("changes"))
    return numbered(found, ["tx", "ts", "_first"], "position").drop("_first")


def reports(made: DataFrame) -> DataFrame:
    """(report_id, source, events, first_rank, last_rank) of each transaction."""
    return made.groupBy(F.col("tx").alias("report_id"), "source").agg(F.count(F.lit(1)).alias("events"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


def history_summary(changes: DataFrame, *, most_groups: int = 64, most_chars: int = 128) -> DataFrame:
    """(author, part, op, n) by count of changes: a report of at most ``most_groups`` groups."""
    shown = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, most_chars)
    return changes.groupBy(shown("author").alias("author"), shown("part").alias("part"), "op").agg(F.count(F.lit(1)).alias("n")).orderBy("author", "part", "op").limit(most_groups)


def history_between(changes: DataFrame, start, end, *, most: int = 512, most_groups: int = 64, most_chars: int = 128) -> DataFrame:
    """(author, part, op, n, total, truncated): a bounded summary of the changes
    from ``start`` through ``end``.  Changes are counted first; of more than
    ``most`` only the first by transaction and place are summed up, which
    ``truncated`` tells."""
    ranged = changes.where(F.col("ts").between(start, end))
    total = ranged.count()
    first = ranged.orderBy("tx", "change_index").limit(most) if total > most else ranged
    return history_summary(first, most_groups=most_groups, most_chars=most_chars).withColumns({"total": F.lit(total).cast("long"), "truncated": F.lit(total > most)})


def missing_transactions(changes: DataFrame, after: int) -> bool:
    """Whether the log no longer starts right after the cursor."""
    first = changes.where(F.col("tx") > after).agg(F.min("tx")).first()[0]
    return first is not None and first > after + 1


def newest_transaction(changes: DataFrame) -> DataFrame:
    """One row, (tx): the newest by time, then by number; null if there is none."""
    return changes.agg(F.max(F.struct("ts", "tx")).alias("m")).select("m.tx")


def newest(changes: DataFrame) -> int | None:
    return changes.agg(F.max("tx")).first()[0]


def initial_imports(events_: DataFrame) -> DataFrame:
    """(store, identifier): the first import of each store that ended well, if
    the store was empty when it began (``store, identifier, at, ok, empty``)."""
    best = events_.where("ok").groupBy("store").agg(F.min(F.struct("at", "identifier", "empty")).alias("m"))
    return best.where("m.empty").select("store", "m.identifier")


def lifecycle(rows: DataFrame) -> DataFrame:
    """One start and one finish of each identifier (``identifier, phase``)."""
    return rows.dropDuplicates(["identifier", "phase"])


@dataclass
class Watch:
    """A running watch over a log: delivers ordered events of one family.

    It starts when it is made.  Predicates given one after another are
    alternatives over the owner's old and new state; none match everything.
    ``nodes`` and ``before`` give the new and the old state, as tables or as
    functions that read them for each batch.  superseded: cloud changes that a
    batch itself outdates are left out.  valid: tells (root, valid) of owners;
    with it, local events of invalid owners are dropped and a batch with a
    failing cloud report raises, so that it is read again.
    ``pause`` and ``resume`` keep the place by the query's checkpoint.
    """

    spark: SparkSession
    log: str
    checkpoint: str
    deliver: Callable[[DataFrame, int], None]
    me: str
    family: int | None = None
    sources: tuple[str, ...] = ("local", "cloud")
    nodes: DataFrame | Callable[[], DataFrame] | None = None
    predicate: Predicate | None = None
    before: DataFrame | Callable[[], DataFrame] | None = None
    superseded: bool = False
    valid: Callable[[DataFrame], DataFrame] | None = None
    query: StreamingQuery | None = field(default=None, init=False)

    def __post_init__(self):
        self.resume()

    def where(self, predicate: Predicate) -> Watch:
        self.predicate = predicate if self.predicate is None else self.predicate | predicate
        return self

    def clear(self) -> Watch:
        self.predicate = None
        return self

    def resume(self) -> Watch:
        if self.query is None or not self.query.isActive:
            stream = self.spark.readStream.schema(CHANGES).parquet(self.log)
            self.query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).start()
        return self

    def pause(self) -> Watch:
        if self.query is not None:
            self.query.stop()
        return self

    def drain(self) -> Watch:
        self.query.processAllAvailable()
        return self

    def _batch(self, batch: DataFrame, number: int) -> None:
        read = lambda state: state() if callable(state) else state
        if self.superseded:
            mine = F.coalesce(F.col("author") == self.me, F.lit(False))
            batch = batch.where(mine).unionByName(surviving(batch, self.me))
        made = with_source(events(batch), self.me).where(F.col("source").isin(*self.sources))
        if self.family is not None:
            made = made.where(F.col("family") == self.family)
        if self.nodes is not None:
            nodes = read(self.nodes)
            state = nodes if self.before is None else both_states(read(self.before), nodes)
            made = resolved(made, state)
            if self.predicate is not None:
                made = matching(made, state, self.predicate)
            if self.valid is not None:
                made = gated(made, self.valid(made.select(F.col("owner_id").alias("id")).where("id is not null").distinct()))
                if not made.where("gate = 'withheld'").isEmpty():
                    raise ReportWithheld(f"batch {number}")
                made = made.where("gate = 'delivered'").drop("gate")
        self.deliver(ordered(made), number)
