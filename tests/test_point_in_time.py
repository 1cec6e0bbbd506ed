"""History features against a plain restatement, with users that hold most of all rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskflow.operators import history, patterns, skew
from riskflow.operators import point_in_time as pit


@pytest.fixture(autouse=True)
def small_keys_can_be_hot(monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)


SCHEMA = ("transaction_id long, user_id string, ts timestamp, transaction_amount double, is_failed int, "
          "fraud_label int, device_type string, location string, merchant_category string")
START = datetime(2024, 1, 1)


def make(n, seed, hot_share, days=20, ties=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rnd.random() < hot_share else f"u{rnd.randrange(12)}"
        t = START + timedelta(microseconds=rnd.randrange(days * 86_400_000_000))
        if rnd.random() < 0.3:  # bursts
            t = START + timedelta(days=rnd.randrange(days), minutes=rnd.randrange(90))
        if ties:
            t = t.replace(minute=0, second=0, microsecond=0)
        rows.append((i, user, t, rnd.randrange(1, 400000) / 100, int(rnd.random() < 0.1), int(rnd.random() < 0.05),
                     rnd.choice(["a", "b", "", None]), f"l{rnd.randrange(30)}", f"m{rnd.randrange(5)}"))
    return rows


def near(x):
    return pytest.approx(x, abs=1e-9)


def expected(rows):
    out = {}
    by_user = {}
    for r in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        past = by_user.setdefault(r[1], [])
        t = r[2]
        day = [p for p in past if p[2].date() == t.date()]
        h24 = [p for p in past if p[2] >= t - timedelta(hours=24)]
        d7 = [p for p in past if p[2] >= t - timedelta(days=7)]
        newest = past[::-1][:3]
        rapid = len(newest) == 3 and newest[2][2] >= t - timedelta(hours=24) and \
            newest[0][2] - newest[2][2] < timedelta(hours=1)
        out[r[0]] = dict(
            hist_count=len(past), hist_fraud=sum(p[5] for p in past), count_24h=len(h24), count_7d=len(d7),
            avg7=near(sum(p[3] for p in d7) / len(d7)) if d7 else None,
            avg=near(sum(p[3] for p in past) / len(past)) if past else None,
            failed=sum(p[4] for p in d7), daily=len(day), prior=int(any(p[5] for p in past)), rapid=rapid,
            new=[int(bool(r[c]) and all(p[c] != r[c] for p in past)) for c in (6, 7, 8)])
        past.append(r)
    return out


def actual(df):
    return {r.transaction_id: dict(
        hist_count=r.hist_count, hist_fraud=r.hist_fraud, count_24h=r.count_24h, count_7d=r.count_7d,
        avg7=r.avg_transaction_amount_7d, avg=r.hist_avg_amount,
        failed=r.failed_transaction_count_7d, daily=r.daily_transaction_count, prior=r.previous_fraudulent_activity,
        rapid=r.rapid_succession, new=[r.is_new_device, r.is_new_location, r.is_new_merchant])
        for r in df.collect()}


def as_rows(spark, rows):
    # naive times are meant as UTC, the session zone
    fixed = [r[:2] + (r[2].replace(tzinfo=timezone.utc) if r[2] else None,) + r[3:] for r in rows]
    return spark.createDataFrame(fixed, SCHEMA)


@pytest.mark.parametrize("n, share, ties", [(600, 0.0, False), (900, 0.4, False), (900, 0.9, False), (500, 0.5, True)])
def test_history_features(spark, n, share, ties):
    rows = make(n, n, share, ties=ties)
    df = as_rows(spark, rows)
    hot = pit.busy_users(df)
    assert bool(hot) == (share > 0)
    got = actual(pit.point_in_time(df, hot=hot))
    want = expected(rows)
    assert got == want


def test_one_instant_holds_all_rows_of_a_hot_user(spark):
    rows = [(i, "hot", START, 1.0, 0, 0, "a", "b", "c") for i in range(50)]
    got = actual(pit.point_in_time(as_rows(spark, rows)))
    assert got == expected(rows)


def test_rows_without_time_stay_and_count_for_nobody(spark):
    rows = make(200, 5, 0.6)
    blank = [(1000 + i, u, None, 5.0, 1, 1, "zz", "l1", "m1") for i, u in enumerate(["hot", "u1", "new"])]
    got = actual(pit.point_in_time(as_rows(spark, rows + blank)))
    want = expected(rows)
    assert {k: v for k, v in got.items() if k < 1000} == want
    assert len(got) == 203


def test_horizon_edges(spark):
    t = START + timedelta(days=10)
    rows = [(1, "u", t - timedelta(days=7), 10.0, 1, 0, "a", "b", "c"),
            (2, "u", t - timedelta(days=7, microseconds=1), 99.0, 1, 0, "a", "b", "c"),
            (3, "u", t - timedelta(hours=24), 20.0, 0, 0, "a", "b", "c"),
            (4, "u", t - timedelta(hours=24, microseconds=1), 20.0, 0, 0, "a", "b", "c"),
            (5, "u", t, 1.0, 0, 0, "a", "b", "c"),
            (6, "u", t.replace(hour=23, minute=59, second=59, microsecond=999999), 1.0, 0, 0, "a", "b", "c"),
            (7, "u", t + timedelta(days=1), 1.0, 0, 0, "a", "b", "c")]
    got = actual(pit.point_in_time(as_rows(spark, rows)))
    assert got == expected(rows)
    assert got[5]["count_24h"] == 1 and got[5]["count_7d"] == 3 and got[5]["daily"] == 0
    assert got[6]["daily"] == 1 and got[7]["daily"] == 0


def test_rapid_needs_less_than_one_hour(spark):
    def rows(user, last):
        base = 100 * int(user[1:])
        return [(base, user, START, 1.0, 0, 0, "a", "b", "c"), (base + 1, user, START + timedelta(minutes=30), 1.0, 0, 0, "a", "b", "c"),
                (base + 2, user, START + last, 1.0, 0, 0, "a", "b", "c"),
                (base + 3, user, START + timedelta(hours=2), 1.0, 0, 0, "a", "b", "c")]
    exact, just = rows("u1", timedelta(hours=1)), rows("u2", timedelta(minutes=59, seconds=59, microseconds=999999))
    got = {r.transaction_id: r.rapid_succession for r in pit.point_in_time(as_rows(spark, exact + just)).collect()}
    assert got[103] is False and got[203] is True


def test_small_keys_stay_whole(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot") for i in range(301)] + [(i, None) for i in range(500)], "id long, user string")
    hot = skew.hot_keys(rows, "user")  # rows without a key are no key
    assert [(r.user, r["size"], r.pieces) for r in hot.frame.collect()] == [("hot", 301, 4)]
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 301)
    assert not skew.hot_keys(rows, "user")


def slices(spark, rows):
    """Events per slice of the hot user."""
    df = as_rows(spark, rows).withColumn("__t", F.unix_micros("ts"))
    hot = pit.busy_users(df)
    sliced = pit._sliced(pit._events(df, "user_id", pit.EVERYTHING), hot, "user_id")
    return [r["count"] for r in sliced.where("user_id = 'hot'").groupBy("slice").count().collect()]


def spread(n, minutes):
    return [(i, "hot", START + timedelta(minutes=minutes * i / n), 1.0, 0, 0, "a", "b", "c") for i in range(n)]


@pytest.mark.parametrize("rows", [
    spread(3000, 60 * 24 * 20),
    [(9999, "hot", datetime(1970, 1, 2), 1.0, 0, 0, "a", "b", "c")] + spread(3000, 60 * 24 * 20),
    spread(3000, 60) + [(9999, "hot", START + timedelta(days=900), 1.0, 0, 0, "a", "b", "c")],
    spread(3000, 0)], ids=["even", "one old row", "burst", "one microsecond"])
def test_slices_are_even(spark, monkeypatch, rows):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 300)
    got = slices(spark, rows)
    assert len(got) >= 10 and max(got) <= 2 * sum(got) / len(got), got


def test_old_row_and_burst_of_a_hot_user(spark):
    rows = [(9999, "hot", datetime(1970, 1, 2), 7.0, 0, 1, "z", "b", "c")] + spread(700, 45)
    assert actual(pit.point_in_time(as_rows(spark, rows))) == expected(rows)


def test_rows_without_a_user_have_no_history(spark):
    rows = make(300, 8, 0.7)
    nobody = [(1000 + i, None, START + timedelta(hours=i // 50), 5.0, 1, 1, "zz", "l1", "m1") for i in range(200)]
    got = actual(pit.point_in_time(as_rows(spark, rows + nobody)))
    assert {k: v for k, v in got.items() if k < 1000} == expected(rows)
    nothing = dict(hist_count=0, hist_fraud=0, count_24h=0, count_7d=0, avg7=None, avg=None, failed=0, daily=0, prior=0,
                   rapid=False, new=[0, 0, 0])
    assert all(got[1000 + i] == nothing for i in range(200))


def test_odd_amounts(spark):
    odd = [float("nan"), float("inf"), -float("inf"), 1e13, 4e-7, None, 1e300, 2.0, 4.0]
    rows = [(i, "u", START + timedelta(hours=i), x, 0, 0, "a", "b", "c") for i, x in enumerate(odd)]
    got = actual(pit.point_in_time(as_rows(spark, rows)))
    assert [got[i]["hist_count"] for i in range(9)] == list(range(9))
    assert [got[i]["avg"] for i in (1, 2, 3, 4)] == [None, None, None, 1e13]
    assert got[5]["avg7"] == near((1e13 + 4e-7) / 2) and got[6]["avg"] == near((1e13 + 4e-7) / 3)
    assert got[8]["avg7"] == near((1e13 + 4e-7 + 2) / 4)


def test_hot_snapshot_patterns_equal_those_of_single_users(spark):
    """The patterns of a user with most of the rows are those that a table of this user alone gives."""
    df = as_rows(spark, make(800, 3, 0.5)).selectExpr("*", "'Online' AS transaction_type")
    as_of = "2024-01-15 00:00:00"

    def found(rows):
        return {r.transaction_id: [(p.code, p.message) for p in r.patterns] for r in patterns.detect_snapshot(
            rows.where(f"ts >= '{as_of}'"), rows.where(f"ts < '{as_of}'"), as_of).collect()}
    whole, parts = found(df), {}
    for user in ("hot", "u3", "u7"):
        parts |= found(df.where(f"user_id = '{user}'"))
    assert parts and all(whole[i] == p for i, p in parts.items())
    assert {code for p in whole.values() for code, _ in p} >= {"new_location", "fraud_history"}


def test_all_features_take_one_shuffle(spark):
    plan = pit.point_in_time(as_rows(spark, make(100, 9, 0.0)), hot=skew.NONE_HOT)._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_newest_rows_are_limited_before_the_shuffle(spark):
    plan = history.newest(as_rows(spark, make(100, 9, 0.5)), 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1
