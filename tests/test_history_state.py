"""Keyed history state of a stream: the state itself with a stand-in for its store, and whole streams."""

from decimal import Decimal

import pandas as pd
from pyspark.sql import Row

from riskflow.functions.times import DAY_US, HOUR_US
from riskflow.streaming import history_state, jobs
from tests.test_point_in_time import as_rows, make


class Store:
    """A value state and the timers of one user."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, ms):
        self.timers.append(ms)


def processor():
    store = Store()
    p = history_state.UserHistory("bigint", ["transaction_id"], DAY_US)
    p.init(store)
    return p, store


def batch(*rows):
    """Rows (id, time in hours, amount)."""
    return pd.DataFrame([{"transaction_id": i, "tie": i, "t": int(h * HOUR_US), "day": int(h // 24 * 24 * HOUR_US), "amount": Decimal(a), "amounts": 1,
                          "failed": i % 2, "fraud": int(i == 1), "device_type": "d", "location": None, "merchant_category": f"m{i}"} for i, h, a in rows])


def run(p, *rows, key=(7, -1)):
    out = pd.concat(list(p.handleInputRows(key, iter([batch(r) for r in rows]), None)))
    return {int(r.transaction_id): r for r in out.itertuples()}


def test_state_holds_eight_days_and_sums_of_the_rest():
    p, store = processor()
    for day in range(100):
        got = run(p, (day, 24 * day + 1, 10), (1000 + day, 24 * day + 2, 30))
        assert got[day].hist_count == 2 * day and got[1000 + day].hist_count == 2 * day + 1
        assert got[day].count_7d == min(2 * day, 14) and got[1000 + day].daily_transaction_count == 1
        assert len(store.value[4]) <= 2 * 9
    assert store.value[0] == 200 - len(store.value[4]) and store.value[1] + sum(store.value[6]) == 4000
    assert len(store.timers) == 1 and len(store.value[-2]) == 200


def test_timers_take_rows_out_until_none_is_left():
    p, store = processor()
    run(p, (1, 1, 5), (2, 30, 6), (3, 100, 7))
    fired = 0
    while store.timers:
        at = store.timers.pop()
        list(p.handleExpiredTimer((7, -1), None, type("Info", (), {"getExpiryTimeInMs": lambda self, at=at: at})()))
        fired += 1
    assert fired == 3 and store.value[4] == [] and store.value[:4] == (3, Decimal(18), 3, 1) and store.value[-1] == 0
    got = run(p, (4, 1000, 1))[4]
    assert (got.hist_count, got.hist_avg_amount, got.count_7d, got.previous_fraudulent_activity) == (3, 6.0, 0, 1)


def test_a_late_row_is_counted_exactly_itself():
    p, _ = processor()
    run(p, (1, 10, 5), (2, 30, 6), (3, 31, 8))
    late = run(p, (9, 12, 100))[9]
    assert (late.hist_count, late.count_7d, late.avg_transaction_amount_7d, late.count_24h, late.daily_transaction_count) == (1, 1, 5.0, 1, 1)
    after = run(p, (4, 32, 1))[4]
    assert (after.hist_count, after.avg_transaction_amount_7d, after.daily_transaction_count) == (4, 119 / 4, 2)


def test_edges_belong_to_the_horizon():
    p, _ = processor()
    got = run(p, (1, 0, 5), (2, 24, 6), (3, 168, 7), (4, 168.5, 8))
    assert [got[i].count_24h for i in (1, 2, 3, 4)] == [0, 1, 0, 1] and [got[i].count_7d for i in (2, 3, 4)] == [1, 2, 2]


def test_rows_of_nobody_keep_no_state():
    p, store = processor()
    got = run(p, (1, 1, 5), (2, 2, 5), key=(None, 3))
    assert store.value is None and all(r.hist_count == 0 and r.is_new_device == 0 and pd.isna(r.hist_avg_amount) for r in got.values())


def test_rows_without_user_or_time_pass(spark, tmp_path):
    jobs.use_keyed_state(spark)
    rows = sorted(make(60, 5, 0.5, days=20), key=lambda r: (r[2], r[0]))
    whole = as_rows(spark, rows)
    odd = whole.limit(2).selectExpr("transaction_id + 1000 AS transaction_id", *[
        "CAST(NULL AS {}) AS user_id".format(dict(whole.dtypes)["user_id"]) if c == "user_id" else c for c in whole.columns[1:]])
    timeless = whole.limit(2).selectExpr("transaction_id + 2000 AS transaction_id", *[
        "CAST(NULL AS TIMESTAMP) AS ts" if c == "ts" else c for c in whole.columns[1:]])
    whole.union(odd).union(timeless).write.parquet(str(tmp_path / "in"))
    out = history_state.follow_history(spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in")))
    got = {r.transaction_id: r for r in jobs.read_back(out, jobs.run_to_end(out)).collect()}
    assert len(got) == 64 and all(got[i].hist_count == 0 and got[i].hist_avg_amount is None for i in got if i >= 1000)
    assert out.columns[:len(whole.columns)] == whole.columns


def test_a_users_rows_leave_in_one_frame_made_at_once(monkeypatch):
    p, _ = processor()
    rows = [(3, 5, 30), (1, 1, 10), (2, 1, 20)]
    monkeypatch.setattr(pd.DataFrame, "__setitem__", None)  # no column is added to a frame
    out, = p.handleInputRows((7, -1), iter([batch(*rows[:2]), batch(rows[2])]), None)
    assert out["transaction_id"].tolist() == [1, 2, 3] and out["hist_count"].tolist() == [0, 1, 2]
    assert out.index.tolist() == [0, 1, 2] and out["hist_avg_amount"].isna().tolist() == [True, False, False]
    assert {str(k) for k in out.dtypes[1:]} == {"int64", "float64", "bool"}


def test_own_columns_pass_as_one_text_and_come_back_whole(spark, tmp_path, monkeypatch):
    carried, made = [], history_state.UserHistory

    def noted(id_type, columns, late):
        carried.append(columns)
        return made(id_type, columns, late)

    monkeypatch.setattr(history_state, "UserHistory", noted)
    jobs.use_keyed_state(spark)
    rows = spark.sql("""
        SELECT id AS transaction_id, IF(id < 6, 1, 2) AS user_id, timestamp_micros(1704067200000001 + id * 3600000000) AS ts,
               element_at(array(0.1D, -0.0D, CAST('NaN' AS DOUBLE), CAST('Infinity' AS DOUBLE), 1e300, NULL, 5e-324, 1D / 3), CAST(id AS INT) + 1) AS transaction_amount,
               element_at(array('a"b', '', NULL, 'null', '[1,"x"]', 'line\n\t\\\\ \u0001', '\u20ac\U0001F600', ' x '), CAST(id AS INT) + 1) AS device_type,
               IF(id % 2 = 0, 9007199254740993 + id, NULL) AS large, CAST(id AS TINYINT) AS tiny, id % 3 = 0 AS flag, CAST(id / 7 AS FLOAT) AS ratio,
               CAST('123456789012345678.000000000000000001' AS DECIMAL(38,18)) + id AS exact, date_add(DATE'1582-10-01', CAST(id AS INT) * 60000) AS day,
               TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS clock_time, IF(id = 3, NULL, array(id, NULL)) AS list, CAST(NULL AS TIMESTAMP) AS never
        FROM range(8)""")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = history_state.follow_history(stream)
    assert [set(c) for c in carried] == [{"own_columns", "list"}]
    assert out.dtypes[:len(rows.dtypes)] == rows.dtypes
    got = jobs.read_back(out, jobs.run_to_end(out))
    seen = lambda df: sorted(map(repr, df.select(*rows.columns).collect()))
    assert seen(got) == seen(spark.read.parquet(str(tmp_path / "in")))
    counts = {r.transaction_id: r.hist_count for r in got.collect()}
    assert [counts[i] for i in range(8)] == [0, 1, 2, 3, 4, 5, 0, 1]


class Engine(Store):
    """The store as the engine has it: it counts what it is asked, and of a state it keeps bytes only."""

    def __init__(self):
        super().__init__()
        self.asked = []

    def exists(self):
        self.asked.append("exists")
        return self.value is not None

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        assert [type(v) for v in value] == [bytes]
        self.value = value


def by_rows():
    engine = Engine()
    p = history_state.ByRows(history_state.UserHistory("bigint", ["transaction_id"], DAY_US), ["transaction_id"])
    p.init(engine)
    return p, engine


def test_rows_say_what_frames_say():
    (p, engine), (frames, _) = by_rows(), processor()
    for rows in ([(2, 30, 20), (1, 10, 5)], [(3, 31, 8), (9, 12, 100)], [(4, 300, 1), (5, 300.5, 3), (6, 301, 7)]):
        frame = batch(*rows)
        want = frames.handleInputRows((7, -1), iter([frame]), None)
        got = p.handleInputRows((7, -1), iter([Row(**r) for r in frame.to_dict("records")]), None)
        want = [{k: None if pd.isna(v) else v for k, v in r.items()} for r in pd.concat(list(want)).to_dict("records")]
        assert [r.asDict() for r in got] == want
    assert engine.asked.count("update") == 3 and len(engine.timers) == 1
    nobody = list(p.handleInputRows((None, 3), iter([Row(**r) for r in batch((8, 1, 5)).to_dict("records")]), None))
    assert nobody[0].hist_count == 0 and nobody[0].is_new_device == 0 and engine.asked.count("update") == 3


def test_a_user_that_begins_with_a_history_is_asked_for_nothing():
    p, engine = by_rows()
    kept = [Row(t=int(h * HOUR_US), tie=i, amount=Decimal(a), amounts=1, failed=0, fraud=0) for i, h, a in ((12, 250, 6), (11, 240, 4))]
    start = Row(n=3, amount=Decimal(30), amounts=3, fraud=1, rows=[r.asDict() for r in kept], known_device=["d"], known_location=[], known_merchant=["m1"])
    p.handleInitialState((7, -1), start, None)
    got = list(p.handleInputRows((7, -1), iter([Row(**r) for r in batch((1, 251, 9), (2, 252, 1)).to_dict("records")]), None))
    assert [(r.hist_count, r.hist_avg_amount, r.count_7d, r.is_new_device, r.is_new_merchant) for r in got] == [(5, 8.0, 2, 0, 0), (6, 49 / 6, 3, 0, 1)]
    assert engine.asked == ["update", "update"]


def test_seed_is_one_row_of_a_user(spark):
    rows = as_rows(spark, make(60, 5, 0.5, days=20))
    timeless = rows.limit(1).selectExpr("transaction_id + 2000 AS transaction_id", "concat(user_id, 'x') AS user_id", *[
        "CAST(NULL AS TIMESTAMP) AS ts" if c == "ts" else c for c in rows.columns[2:]])
    got = {r.user_id: r for r in history_state.seed(rows.union(timeless)).collect()}
    users = {r.user_id for r in rows.where("user_id IS NOT NULL").collect()}
    assert users <= set(got) and len(got) == len(users) + 1
    counts = {r.user_id: r["count"] for r in rows.groupBy("user_id").count().collect()}
    assert all(got[u].n + len(got[u].rows) == counts[u] for u in users)
    only, = (got[u] for u in got if u not in users)
    assert (only.n, only.amount, only.rows) == (0, 0, []) and any(only[c] for c in ("known_device", "known_location", "known_merchant"))


def test_users_that_are_numbers_stay_apart_next_to_rows_of_nobody(spark, tmp_path):
    jobs.use_keyed_state(spark)
    rows = spark.sql("""SELECT id AS transaction_id, IF(id % 5 = 4, NULL, id % 5) AS user_id, timestamp_micros(1704067200000000 + id * 3600000000) AS ts,
                        10D AS transaction_amount, 'd' AS device_type FROM range(40)""")
    rows.write.parquet(str(tmp_path / "in"))
    out = history_state.follow_history(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    got = {r.transaction_id: r for r in jobs.read_back(out, jobs.run_to_end(out)).collect()}
    assert [got[i].hist_count for i in range(40)] == [0 if i % 5 == 4 else i // 5 for i in range(40)]
    assert [got[i].is_new_device for i in range(40)] == [int(i < 4) for i in range(40)]
