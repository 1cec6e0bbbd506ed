"""Per-user state: the times of the last day and the known values, for patterns of rows as they arrive.

Kept per user: the times of the newest 24 hours and of `LATE` before them, so that a row that comes up to that much late
is still counted exactly, and one entry per known value. With `ttl_ms` both are forgotten when nothing has written them for
that long; such a stream looks at its state all the time, so it needs a trigger that goes on, not availableNow.
A micro-batch's rows of one user are ordered by (time, id) before they meet the state, so the
input limit of the stream (files or offsets per trigger) bounds what is held at once.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskflow import config as C
from riskflow.functions.times import HOUR_US, micros
from riskflow.operators.values import KNOWN_FIELDS

OUTPUT = ("transaction_id {id}, user_id {user}, count_24h long, rapid_succession boolean, "
          "is_new_device int, is_new_location int, is_new_merchant int")


LATE = 24 * HOUR_US
_HORIZON = C.RECENT_HOURS * HOUR_US


class UserState(StatefulProcessor):
    def __init__(self, ttl_ms=None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle):
        self.recent = handle.getValueState("recent", "times array<bigint>", self.ttl_ms)
        self.known = handle.getMapState("known", "field string, value string", "since bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["t", "transaction_id"], kind="stable")
        seen = np.array(self.recent.get()[0] if self.recent.exists() else [], dtype=np.int64)
        own = batch["t"].to_numpy(dtype=np.int64)
        times = np.concatenate([seen, own])
        order = np.argsort(times, kind="stable")
        times = times[order]
        # place of each row of the batch among all times: number of earlier rows
        place = np.empty(len(times), dtype=np.int64)
        place[order] = np.arange(len(times))
        place = place[len(seen):]
        count = place - np.searchsorted(times, own - _HORIZON, side="left")
        third = times[np.maximum(place - C.RAPID_ROWS, 0)]
        first = times[np.maximum(place - 1, 0)]
        rapid = ((place >= C.RAPID_ROWS) & (third >= own - _HORIZON)
                 & (first - third < C.RAPID_HOURS * HOUR_US))
        out = {"transaction_id": batch["transaction_id"].to_numpy(), "user_id": [key[0]] * len(batch),
               "count_24h": count, "rapid_succession": rapid}
        for field, column in KNOWN_FIELDS.items():
            out[f"is_new_{field}"] = self._new(field, batch[column], own)
        self.recent.update((times[times >= times[-1] - _HORIZON - LATE].tolist(),))
        yield pd.DataFrame(out)

    def _new(self, field, values, own):
        """1 for the first row of every value that is in no earlier batch; remembers these values."""
        firsts = (~values.duplicated()).to_numpy() & values.notna().to_numpy() & (values != "").to_numpy()
        fresh = np.zeros(len(values), dtype=np.int32)
        for i in np.flatnonzero(firsts):  # once per distinct value
            entry = (field, values.iat[i])
            if not self.known.containsKey(entry):
                self.known.updateValue(entry, (int(own[i]),))
                fresh[i] = 1
        return fresh

    def close(self):
        """Nothing is open between batches."""


def follow_users(txn: DataFrame, ttl_ms=None) -> DataFrame:
    """Stream of transactions -> stream of their history facts. Rows without user or time are dropped before."""
    kinds = dict(txn.dtypes)
    rows = (txn.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
            .select("user_id", "transaction_id", micros("ts").alias("t"), *KNOWN_FIELDS.values()))
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=UserState(ttl_ms), outputStructType=OUTPUT.format(id=kinds["transaction_id"], user=kinds["user_id"]),
        outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
