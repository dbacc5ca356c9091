"""Items of orders used up by a stream of payments: what is left of each order is state, kept by groups of orders, and expires by order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.subset_sum import first_subset

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "tx_id long, order_id long, items array<int>, code string, left_cents long"


#: Orders whose ids agree but for so many low bits share a key. Calls to the state and a group's frames cost the same for one order and for
#: many, so orders one by one would take a multiple of the time of the search itself. A payment writes its group's state, 256 orders at most.
TOGETHER_BITS = 8


class _Items(StatefulProcessor):
    """State of a group of orders: of each the places and cents of the items that are left, and the event time after which it is forgotten."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("orders", "order_id array<bigint>, until array<bigint>, size array<int>, idx array<int>, cents array<bigint>")

    def _held(self) -> tuple[dict, dict]:
        """By order: the items left, and the time that it is kept for."""
        if not self.state.exists():
            return {}, {}
        ids, until, size, idx, cents = self.state.get()
        items = zip(idx, cents)
        return {k: list(islice(items, n)) for k, n in zip(ids, size)}, dict(zip(ids, until))

    def _hold(self, left: dict, until: dict, timer: int | None) -> None:
        """Keep what is left; the group's one timer (``timer`` so far) is that of the order to be forgotten first."""
        then = min(until.values(), default=None)
        if then != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if then is not None:
                self.handle.registerTimer(then)
        if not left:
            self.state.clear()
            return
        items = [x for v in left.values() for x in v]
        self.state.update((list(left), [until[k] for k in left], [len(v) for v in left.values()], [int(i) for i, _ in items], [int(c) for _, c in items]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(rows).sort_values(["seq", "tx_id"], kind="stable")
        left, until = self._held()
        timer = min(until.values(), default=None)
        found_of = []
        for order_id, amount, idx, cents in zip(*(arrived[c].tolist() for c in ("order_id", "amount", "idx", "item_cents"))):
            if order_id not in left:
                left[order_id] = list(zip(idx.tolist(), cents.tolist()))
            items = left[order_id]
            found = first_subset(items, amount) if items else None
            code = None if found else "used_up" if not items else "no_subset"
            if found:
                left[order_id] = items = [x for x in items if x[0] not in found]
            found_of.append((found, code, sum(c for _, c in items)))
        # each order is kept for a time from its last payment known
        ms = arrived["ts"].to_numpy("datetime64[ns]").astype("int64") // 10**6
        for order_id, last in zip(arrived["order_id"].tolist(), ms.tolist()):
            until[order_id] = max(until.get(order_id, last + self.keep_ms), last + self.keep_ms)
        self._hold(left, until, timer)
        items, code, sums = zip(*found_of)
        yield pd.DataFrame({"tx_id": arrived["tx_id"].to_numpy(), "order_id": arrived["order_id"].to_numpy(), "items": items, "code": code, "left_cents": sums})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        left, until = self._held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        until = {k: t for k, t in until.items() if t > now}
        self._hold({k: left[k] for k in until}, until, None)  # the timer that expired is gone
        return iter([])


def use_up(payments: DataFrame, orders: DataFrame, delay: str = "2 days", keep_days: int = 90) -> DataFrame:
    """(tx_id, order_id, items, code, left_cents) for each payment (tx_id, seq, ts, order_id, cents) of an order that is known.

    payments may be a stream; orders (order_id, items as group_orders gives them) are a table. A payment takes the first subset of the
    order's items that are left; code says why it takes none: ``no_subset``, or ``used_up`` once nothing is left. Payments of
    unknown orders are left out. Within a batch payments of an order go by seq, then tx_id, so a stream whose batches keep that
    order gives the rows of one batch. An order is forgotten ``keep_days`` of event time after its last payment; a stream
    then starts with all items again. Needs ``spark.sql.streaming.stateStore.providerClass`` to be STORE.
    """
    items = orders.select("order_id", F.transform("items", lambda x: x["idx"].cast("int")).alias("idx"), F.transform("items", lambda x: x["cents"]).alias("item_cents"))
    met = payments.withWatermark("ts", delay).select("tx_id", "seq", "ts", "order_id", F.abs("cents").alias("amount")).join(items, "order_id")
    return met.withColumn("together", F.shiftright("order_id", TOGETHER_BITS)).groupBy("together").transformWithStateInPandas(_Items(keep_days * 86_400_000), RESULT, "append", "eventTime")
