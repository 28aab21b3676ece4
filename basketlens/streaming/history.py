"""Change-only price history of a stream: each item and branch keeps its last price as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: Where keyed state of this kind can be kept.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
KEY = ["product_id", "store_id"]
CHANGES = "product_id long, store_id long, price decimal(10,2), seen timestamp_ntz, seq long, before decimal(10,2)"
_STATE = "price decimal(10,2), seen timestamp_ntz, seq long"


class LastPrice(StatefulProcessor):
    """Puts out a row where the price differs from the one before of its key, in the order of ``seen, seq``.

    A row that is no later than the stored one came too late and changes nothing; rows without a price or a time are no sightings.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows)).dropna(subset=["price", "seen", "seq"]).sort_values(["seen", "seq"], kind="stable")
        stored = self.last.get() if self.last.exists() else None
        if stored is not None:
            at = (pd.Timestamp(stored[1]), stored[2])
            new = new[[(s, q) > at for s, q in zip(new["seen"], new["seq"], strict=True)]]
        if len(new):
            before = new["price"].shift(1)
            before.iloc[0] = stored[0] if stored is not None else None
            changed = new[[b is None or pd.isna(b) or b != p for b, p in zip(before, new["price"], strict=True)]]
            end = new.iloc[-1]
            self.last.update((end["price"], end["seen"].to_pydatetime(), int(end["seq"])))
            if len(changed):
                yield pd.DataFrame({"product_id": key[0], "store_id": key[1], "price": changed["price"], "seen": changed["seen"], "seq": changed["seq"], "before": before[changed.index]})

    def close(self) -> None:
        pass


def price_history(log: DataFrame) -> DataFrame:
    """Changes of a streamed log ``product_id, store_id, price, seen, seq``; ``seq`` orders rows of one time.

    One row of state for each item and branch, whatever the length of the log.
    """
    rows = log.select(*KEY, log["price"].cast("decimal(10,2)").alias("price"), log["seen"].cast("timestamp_ntz").alias("seen"), log["seq"].cast("long").alias("seq"))
    return rows.groupBy(*KEY).transformWithStateInPandas(LastPrice(), CHANGES, "Append", "None")


def write_history(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append changes to a Parquet table once each; starts again where the checkpoint stands, and ends when all input is read."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
