"""Streaming twin of ingest: each micro-batch goes through the batch classifier, and the trades it touches are evaluated again as a whole.

No event-time watermark: a late or out-of-order revision is just another row, never dropped, and duplicates must stay visible as conflicts.
A batch that is run again after a failure only finds replays, so results stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import reconcile as R
from ..operators.tables import Store


def start(deliveries: DataFrame, store: Store, checkpoint: str, on_facts: Callable[[DataFrame, int], None] | None = None, config=None, **trigger) -> StreamingQuery:
    """Ingest a stream of deliveries (engine columns). on_facts gets the break facts of all trades that the batch touched."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            store.ingest(batch)
            if on_facts:
                on_facts(touched_facts(batch, store, config), number)
        finally:
            batch.unpersist()

    return deliveries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def touched_facts(batch: DataFrame, store: Store, config=None) -> DataFrame:
    """Facts of the trades in a batch over all that is stored of them."""
    inbox = store.read("source_event_inbox")
    conflicts = store.read("source_event_conflicts").select(*inbox.columns) if store.exists("source_event_conflicts") else inbox.limit(0)
    mine = R.unite(inbox, conflicts).join(batch.select(*R.TRADE).distinct(), list(R.TRADE), "left_semi")
    return R.reconcile(R.without_superseded(mine), config)
