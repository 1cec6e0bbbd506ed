"""History features of a stream: what `operators.point_in_time` says about each row, from keyed state instead of the history.

Kept per user: the rows of the newest seven days and of `LATE` before them, the sums of all rows older than these, and one entry per known
value. So the state does not grow with the stream, and no micro-batch reads anything but its own rows. A row that comes up to `LATE` after
a newer one of its user is counted exactly itself; what was said about the newer ones stays said. Amounts are exact decimals.

The event time of the stream is a clock as well: a timer of each user, set for the time when the oldest row kept leaves the
horizon, moves such rows into the sums, so a user that nobody hears of any more keeps sums only. Rows more than
`LATE` behind the stream's newest row are dropped by the engine, as the watermark has it; widen `late` for a stream that has them.

A micro-batch's rows of one user are ordered by (time, id) before they meet the state, so the input limit of the stream bounds
what is held at once. A row without a user or a time is nobody's history and passes with zeros, as in a batch.

A user has a few rows in a micro-batch, and a frame for them costs far more than their history does. So they cross to Python and back as
rows (`ByRows`), and what the state begins with comes as one row of a user. Each column still costs a conversion both ways: the row's own
columns pass as one text, an array of their values, that nobody looks into; columns of nested and binary types pass as they are.

State may begin with a history: `seed` makes its starting point from a table, which is read once, when the stream starts for the first time.
"""

import pickle
from bisect import bisect_left
from decimal import Decimal
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskflow import config as C
from riskflow.functions.times import DAY_US, HOUR_US, micros
from riskflow.operators import point_in_time as pit
from riskflow.operators import profiles
from riskflow.operators.values import KNOWN_FIELDS

LATE = "1 day"
FEATURES = ("hist_count long, hist_avg_amount double, hist_fraud long, previous_fraudulent_activity int, count_24h long, "
            "count_7d long, avg_transaction_amount_7d double, failed_transaction_count_7d int, daily_transaction_count int, "
            "rapid_succession boolean, " + ", ".join(f"is_new_{f} int" for f in KNOWN_FIELDS))
SPREAD = 256  # groups of rows that are nobody's

_WEEK = 7 * DAY_US
_ROW = "own_columns"  # the columns of _PLAIN types, as one text; a frame renames columns that begin with an underscore
_PLAIN = {"string", "bigint", "int", "smallint", "tinyint", "boolean", "double", "float", "date", "timestamp", "timestamp_ntz"}
_FACTS = ("t", "tie", "day", "amount", "amounts", "failed", "fraud")
_ROWS = ("times", "ids", "row_amounts", "counted", "failed", "frauds")
_KEPT = ("t", "tie", "amount", "amounts", "failed", "fraud")  # the same of a row that comes in
_ZERO = Decimal(0)
_TYPES = {x.split()[0]: {"double": "float64", "boolean": "bool"}.get(x.split()[1], "int64") for x in FEATURES.split(", ")}


class UserHistory(StatefulProcessor):
    def __init__(self, id_type, carried, late_us):
        self.id_type, self.carried, self.kept_us = id_type, carried, _WEEK + late_us

    def init(self, handle: StatefulProcessorHandle):
        self.handle = handle
        known = ", ".join(f"{f} array<string>" for f in KNOWN_FIELDS)
        self.state = handle.getValueState("history", (
            f"n bigint, amount decimal(38,10), amounts bigint, fraud bigint, times array<bigint>, ids array<{self.id_type}>, "
            f"row_amounts array<decimal(38,10)>, counted array<bigint>, failed array<bigint>, frauds array<bigint>, {known}, timer bigint"))

    # --- state <-> plain values
    def _read(self):
        """(sums of old rows, kept rows in order, known values, time of the timer or 0)."""
        if not self.state.exists():
            return [0, _ZERO, 0, 0], [], {f: set() for f in KNOWN_FIELDS}, 0
        s = self.state.get()
        return list(s[:4]), list(zip(*s[4:10])), {f: set(v) for f, v in zip(KNOWN_FIELDS, s[10:-1])}, s[-1]

    def _write(self, sums, rows, known, timer):
        """Rows before the horizon go into the sums; a timer waits for the oldest of the others."""
        if rows:
            end = rows[-1][0] - self.kept_us
            at = bisect_left(rows, end, key=lambda r: r[0])
            sums, rows = self._summed(sums, rows[:at]), rows[at:]
            if not timer:
                timer = (rows[0][0] + self.kept_us) // 1000 + 1
                self.handle.registerTimer(timer)
        columns = [list(c) for c in zip(*rows)] or [[] for _ in _ROWS]
        self.state.update((*sums, *columns, *[sorted(known[f]) for f in KNOWN_FIELDS], timer))

    @staticmethod
    def _summed(sums, rows):
        return [sums[0] + len(rows), sums[1] + sum((r[2] for r in rows), _ZERO), sums[2] + sum(r[3] for r in rows),
                sums[3] + sum(r[5] for r in rows)]

    # --- events
    def begin(self, old, rows, values):
        """The state of a user of whom nothing is known: sums of old rows, newest rows, values of each field."""
        sums, kept, known, timer = self._read()
        sums = [a + b for a, b in zip(sums, old)]
        for f, v in values.items():
            known[f].update(v)
        self._write(sums, sorted(kept + rows, key=lambda x: x[:2]), known, timer)

    def told(self, key, own, days, values):
        """Features of the rows of one user, given in order, and the flags of their values; the state then knows these rows."""
        if key[0] is None or key[1] >= 0:
            return [(0, None, 0, 0, 0, 0, None, 0, 0, False)] * len(own), {f: [0] * len(own) for f in KNOWN_FIELDS}
        sums, kept, known, timer = self._read()
        every = sorted([(r, False, 0) for r in kept] + [(r, True, d) for r, d in zip(own, days)], key=lambda x: x[0][:2])
        times = [r[0] for r, _, _ in every]
        amount, amounts, failed, fraud = ([zero, *accumulate(r[i] for r, _, _ in every)] for i, zero in ((2, _ZERO), (3, 0), (4, 0), (5, 0)))
        out = []
        for p, (r, new, day) in enumerate(every):
            if not new:
                continue
            t = r[0]
            week, last_day, today = (bisect_left(times, x) for x in (t - _WEEK, t - C.RECENT_HOURS * HOUR_US, day))
            n_all, of_week = sums[2] + amounts[p], amounts[p] - amounts[week]
            hist_fraud = sums[3] + fraud[p]
            rapid = (p >= C.RAPID_ROWS and times[p - C.RAPID_ROWS] >= t - C.RECENT_HOURS * HOUR_US
                     and times[p - 1] - times[p - C.RAPID_ROWS] < C.RAPID_HOURS * HOUR_US)
            out.append((sums[0] + p, float(sums[1] + amount[p]) / n_all if n_all else None, hist_fraud, int(hist_fraud > 0), p - last_day,
                        p - week, float(amount[p] - amount[week]) / of_week if of_week else None, failed[p] - failed[week],
                        p - today, rapid))
        fresh = {f: self._fresh(known[f], values[f]) for f in KNOWN_FIELDS}
        self._write(sums, [r for r, _, _ in every], known, timer)
        return out, fresh

    def handleInputRows(self, key, rows, timerValues):
        batch = self._in_order(list(rows))
        own = list(zip(*[batch[c].tolist() for c in _KEPT]))
        yield self._out(batch, *self.told(key, own, batch["day"].tolist(), {f: batch[c].tolist() for f, c in KNOWN_FIELDS.items()}))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        sums, rows, known, _ = self._read()
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        at = bisect_left(rows, now - self.kept_us, key=lambda r: r[0])
        sums, rows = self._summed(sums, rows[:at]), rows[at:]
        self._write(sums, rows, known, 0)
        yield from ()

    @staticmethod
    def _fresh(known, values):
        """1 for the first row of every value that no earlier batch had; remembers these values."""
        out = []
        for v in values:
            new = isinstance(v, str) and v != "" and v not in known
            if new:
                known.add(v)
            out.append(int(new))
        return out

    @staticmethod
    def _in_order(frames):
        """The rows of one user in one frame, by (t, tie)."""
        batch = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        at = list(zip(batch["t"].tolist(), batch["tie"].tolist()))
        order = sorted(range(len(at)), key=at.__getitem__)
        return batch if order == list(range(len(at))) else batch.take(order)

    def _out(self, batch, features, fresh):
        """One frame, made at once: a column at a time costs more than all the rest of a user's work."""
        columns = dict(zip(_TYPES, zip(*features))) | {f"is_new_{f}": v for f, v in fresh.items()}
        return pd.DataFrame({c: batch[c].array for c in self.carried} | {c: np.array(columns[c], dtype=k) for c, k in _TYPES.items()}, copy=False)

    def close(self):
        """Nothing is open between batches."""


class Packed:
    """A handle whose value state is kept as bytes: the engine converts any other state value by value, each time it is read or written.

    Each question to the engine costs more than its answer, so what is known of the state of the key at hand is not asked again.
    """

    def __init__(self, handle):
        self.registerTimer, self.handle = handle.registerTimer, handle
        self.key = self.there = self.value = None

    def getValueState(self, name, _):
        self.state = self.handle.getValueState(name, "packed binary")
        return self

    def turn_to(self, key, there=None):
        """The key at hand, and whether it is known to have a state."""
        if self.key != (key,):
            self.key, self.there, self.value = (key,), there, None

    def exists(self):
        if self.there is None:
            self.there = self.state.exists()
        return self.there

    def get(self):
        return pickle.loads(self.state.get()[0] if self.value is None else self.value)

    def update(self, value):
        self.there, self.value = True, pickle.dumps(value, pickle.HIGHEST_PROTOCOL)
        self.state.update((self.value,))


class ByRows(StatefulProcessor):
    """`UserHistory` for rows in place of frames, with packed state."""

    def __init__(self, history: UserHistory, carried):
        self.history, self.carried = history, carried

    def init(self, handle: StatefulProcessorHandle):
        self.packed = Packed(handle)
        self.history.init(self.packed)

    def handleInitialState(self, key, initialState, timerValues):
        self.packed.turn_to(key, there=False)
        rows = [tuple(r[c] for c in _KEPT) for r in initialState.rows]
        old = [initialState[c] for c in ("n", "amount", "amounts", "fraud")]
        self.history.begin(old, rows, {f: initialState[f"known_{f}"] for f in KNOWN_FIELDS})

    def handleInputRows(self, key, rows, timerValues):
        self.packed.turn_to(key)
        rows = list(rows)
        at = rows[0].__fields__.index
        rows.sort(key=itemgetter(at("t"), at("tie")))
        values = {f: [r[at(c)] for r in rows] for f, c in KNOWN_FIELDS.items()}
        features, fresh = self.history.told(key, list(map(itemgetter(*map(at, _KEPT)), rows)), [r[at("day")] for r in rows], values)
        made, own = Row(*self.carried, *_TYPES), [at(c) for c in self.carried]
        for r, found, flags in zip(rows, features, zip(*fresh.values())):
            yield made(*[r[i] for i in own], *found, *flags)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.packed.turn_to(key, there=True)
        return self.history.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self):
        """Nothing is open between batches."""


def _facts(txn: DataFrame) -> DataFrame:
    """The numbers that a row adds to its user's history."""
    have = set(txn.columns)
    flag = lambda c: c if c in have else "CAST(NULL AS INT)"
    none = "''" if dict(txn.dtypes)["transaction_id"] == "string" else "0"
    return txn.withColumns({
        "t": F.coalesce(micros("ts"), F.lit(0)), "tie": F.expr(f"coalesce(transaction_id, {none})"), "day": F.coalesce(F.unix_micros(F.date_trunc("day", "ts")), F.lit(0)),
        "amount": F.expr(f"CAST(IF({pit.READABLE}, coalesce(CAST(transaction_amount AS DOUBLE), 0D), 0D) AS DECIMAL(38,10))"),
        "amounts": F.expr(f"CAST({pit.READABLE} AS BIGINT)"), "failed": F.expr(f"coalesce(CAST({flag('is_failed')} AS BIGINT), 0)"),
        "fraud": F.expr(f"coalesce(CAST({flag('fraud_label')} = 1 AS BIGINT), 0)")})


def seed(history: DataFrame, late=LATE) -> DataFrame:
    """What the state of each user should begin with, in one row: its newest rows, the sums of the older ones and its known values."""
    rows = _facts(history.where("user_id IS NOT NULL AND ts IS NOT NULL"))
    newest = rows.groupBy("user_id").agg(F.max("t").alias("newest"))
    horizon = F.col("newest") - F.lit(_WEEK + interval_us(late))
    marked = rows.join(newest, "user_id").withColumn("recent", F.col("t") >= horizon)
    kept = F.when(F.col("recent"), F.struct(*_KEPT))
    totals = {"n": F.lit(1).cast("bigint")} | {c: F.col(c) for c in ("amount", "amounts", "fraud")}
    of_rows = marked.groupBy("user_id").agg(F.collect_list(kept).alias("rows"), *[F.sum(F.when(~F.col("recent"), v)).alias(c) for c, v in totals.items()])
    values = profiles.known_values(history.where("user_id IS NOT NULL"))
    of_values = values.groupBy("user_id").agg(*[F.collect_list(F.when(F.col("field") == f, F.col("value"))).alias(f"known_{f}") for f in KNOWN_FIELDS])
    every = of_rows.join(of_values, "user_id", "full")  # either may lack a user: rows without a time, rows without a known value
    kinds = dict(every.dtypes)
    return every.select("user_id", *[F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in totals],
                        *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("rows", *(f"known_{f}" for f in KNOWN_FIELDS))])


def interval_us(text: str) -> int:
    """Microseconds of a duration such as `1 day` or `90 minutes`."""
    return int(pd.Timedelta(text).value // 1000)


def follow_history(txn: DataFrame, start: DataFrame = None, late=LATE) -> DataFrame:
    """Stream of transactions -> the same rows with their history features (`FEATURES`). `start` is the result of `seed`."""
    kinds = dict(txn.dtypes)
    alone = F.col("user_id").isNull() | F.col("ts").isNull()
    absent = {c: F.lit(None).cast("string") for c in KNOWN_FIELDS.values() if c not in kinds}
    plain = [c for c, k in kinds.items() if k in _PLAIN or k.startswith("decimal")]
    text = [(F.unix_micros(c) if kinds[c] == "timestamp" else F.col(c)).cast("string") for c in plain]
    others = {c: k for c, k in kinds.items() if c not in plain}
    packed = txn.withColumns(absent).withColumn(_ROW, F.to_json(F.array(*text)))
    rows = _facts(packed).withColumn("alone", F.when(alone, F.pmod(F.xxhash64("transaction_id"), F.lit(SPREAD))).otherwise(-1))
    rows = rows.withColumn("of_user", F.when(~alone, F.col("user_id"))).withColumn("clock", F.col("ts")).withWatermark("clock", late)
    # a frame has no whole numbers next to nulls: known values that are such numbers pass as text
    rows = rows.withColumns({c: F.col(c).cast("string") for c in KNOWN_FIELDS.values() if kinds.get(c) == "bigint"})
    rows = rows.select(*dict.fromkeys([_ROW, *others, *_FACTS, *KNOWN_FIELDS.values(), "of_user", "clock"]), F.col("alone").cast("bigint").alias("alone"))
    schema = ", ".join(f"`{c}` {k}" for c, k in {_ROW: "string", **others}.items()) + ", " + FEATURES
    begin = None
    if start is not None:
        begin = start.select(F.col("user_id").alias("of_user"), F.lit(-1).cast("bigint").alias("alone"), *[c for c in start.columns if c != "user_id"])
        begin = begin.groupBy("of_user", "alone")
    carried = [_ROW, *others]
    out = rows.groupBy("of_user", "alone").transformWithState(
        statefulProcessor=ByRows(UserHistory(kinds["transaction_id"], carried, interval_us(late)), carried), outputStructType=schema,
        outputMode="Append", timeMode="EventTime", initialState=begin)
    out = out.withColumn(_ROW, F.from_json(_ROW, "array<string>"))

    def unpacked(i, c):
        value = F.get(_ROW, F.lit(i))
        return (F.timestamp_micros(value.cast("bigint")) if kinds[c] == "timestamp" else value.cast(kinds[c])).alias(c)

    own = {c: unpacked(i, c) for i, c in enumerate(plain)} | {c: F.col(c) for c in others}
    return out.select(*[own[c] for c in kinds], *[x.split()[0] for x in FEATURES.split(", ")])
