"""Arrival windows on a stream: a trade whose window ends without a required source breaks, though nothing more of it is delivered.

Each trade is a key with a small state: which kinds it has, its own watermark (the last ingest time), its product. Whatever comes in sets one timer to the end of the window that ends first; when the
stream's event time passes it, the kinds that are missing by then are reported, each once, and the timer goes to the next end. So only time that passes on other trades makes the break. The batch rule over all
that came in, evaluated at the stream's time, finds the same.

Defined cases: a source that comes after its break has been reported changes nothing here (the batch evaluates the trade again); one that comes before, even late, moves the window, as its
ingest time moves the trade's watermark; kinds with no configured window are due at the watermark; null ingest times are left out, as they have no place in event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.reference_data import REQUIRED_KINDS, Config
from ..operators.reconcile import TRADE

OUT = "tenant_id string, portfolio_id string, lineage_id string, kind string, expected_by timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Arrivals(StatefulProcessor):
    """State of a trade: seen and reported (kinds, joined by a comma), watermark (ms), product."""

    def __init__(self, windows: dict[tuple[str, str], int]):
        self.windows = windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trade = handle.getValueState("trade", "seen string, reported string, watermark long, product string")

    def _due(self, state: tuple) -> dict[str, int]:
        """Missing kinds that are not reported, and when (ms) each is due."""
        seen, reported, watermark, product = state
        open_kinds = [k for k in REQUIRED_KINDS if k not in seen.split(",") and k not in reported.split(",")]
        return {k: watermark + 1000 * self.windows.get((product, k), 0) for k in open_kinds}

    def _set(self, state: tuple) -> None:
        self.trade.update(state)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if due := self._due(state):
            self.handle.registerTimer(min(due.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, reported, watermark, product = self.trade.get() if self.trade.exists() else ("", "", 0, "")
        kinds = {k for k in seen.split(",") if k}
        for batch in rows:
            kinds |= set(batch["kind"].dropna())
            watermark = max(watermark, int(batch["ingest_ms"].max()))
            named = batch["product_type"].dropna()
            product = named.iloc[0] if not product and len(named) else product
        self._set((",".join(sorted(kinds)), reported, watermark, product))
        yield pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.trade.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        late = {k: at for k, at in self._due(state).items() if at <= now}
        reported = ",".join(sorted({*state[1].split(","), *late} - {""}))
        self._set((state[0], reported, state[2], state[3]))
        yield pd.DataFrame(
            {"tenant_id": key[0], "portfolio_id": key[1], "lineage_id": key[2], "kind": list(late), "expected_by": [datetime.fromtimestamp(at / 1000, UTC).replace(tzinfo=None) for at in late.values()]}
        )

    def close(self) -> None:
        pass


def missing_sources(deliveries: DataFrame, config: Config | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of missing sources (OUT) from a stream of deliveries. delay: how much earlier than the latest ingest time others may still come in."""
    spark = deliveries.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    timed = deliveries.where("ingest_time is not null").withWatermark("ingest_time", delay)
    rows = timed.select(*TRADE, "kind", "product_type", "ingest_time", F.unix_millis("ingest_time").alias("ingest_ms"))
    return rows.groupBy(*TRADE).transformWithStateInPandas(Arrivals((config or Config()).windows), OUT, "Append", "EventTime")
