"""Live queries: a query's result, delivered again whenever a change could alter it.

Changes come as a stream of rows with ``_op`` (add, update, remove), each micro-batch one set of changes. A batch matters if
the query has no filter, if a changed row meets the filters, or if a changed key is among those delivered last: then the row
may leave the result. What matters is decided with two semi-joins and a limit; only then is the query run again. The keys
delivered last are a table, never a driver-side set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def relevant(changes: DataFrame, condition: Column | None) -> DataFrame:
    """The changed rows that meet the filters (all, without filters)."""
    return changes if condition is None else changes.where(condition)


def leaving(changes: DataFrame, delivered: DataFrame, keys: Sequence[str], condition: Column | None) -> DataFrame:
    """The changed rows that were in the last result and no longer meet the filters, or are removed."""
    hit = changes.join(delivered.select(*keys).distinct(), list(keys), "left_semi")
    if condition is None:
        return hit.where("_op = 'remove'")
    return hit.where((F.col("_op") == "remove") | ~F.coalesce(condition, F.lit(False)))


def matters(changes: DataFrame, delivered: DataFrame | None, keys: Sequence[str], condition: Column | None) -> bool:
    """An empty set of changes means that something unknown happened: it matters."""
    if changes.isEmpty() or condition is None:
        return True
    if not relevant(changes, condition).isEmpty():
        return True
    return delivered is not None and not changes.join(delivered.select(*keys), list(keys), "left_semi").isEmpty()


class LiveQuery:
    """``run`` gives the whole current result; ``deliver`` gets it at the start and after each batch that matters."""

    def __init__(self, run: Callable[[], DataFrame], keys: Sequence[str], deliver: Callable[[DataFrame], None], condition: Column | None = None) -> None:
        self.run, self.keys, self.deliver, self.condition = run, list(keys), deliver, condition
        self.delivered: DataFrame | None = None
        self.deliveries = 0

    def refresh(self) -> None:
        result = self.run().persist()
        self.deliver(result)
        if set(self.keys) <= set(result.columns):
            old, self.delivered = self.delivered, result.select(*self.keys).persist()
            self.delivered.count()
            if old is not None:
                old.unpersist()
        result.unpersist()
        self.deliveries += 1

    def on_changes(self, changes: DataFrame) -> bool:
        if not matters(changes, self.delivered, self.keys, self.condition):
            return False
        self.refresh()
        return True

    def subscribe(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Follow a stream of changes. A batch that is repeated after a failure delivers the same result again."""
        self.refresh()

        def each(batch: DataFrame, _: int) -> None:
            batch.persist()
            self.on_changes(batch)
            batch.unpersist()

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
