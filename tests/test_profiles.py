"""Profiles, value lists and snapshots on hand-written rows."""

from pyspark.sql import functions as F

from riskflow.operators import history, patterns, profiles, values

SCHEMA = ("transaction_id int, user_id string, ts string, transaction_amount double, location string, "
          "device_type string, merchant_category string, card_type string, fraud_label int, is_weekend int, "
          "previous_fraudulent_activity int, account_balance double, transaction_type string")


def table(spark, rows):
    full = []
    for i, (user, ts, amount, *rest) in enumerate(rows):
        location, device, merchant, card, fraud = (rest + [None] * 5)[:5]
        full.append((i, user, ts, amount, location, device, merchant, card, fraud or 0, 0, fraud or 0, float(i), "Online"))
    return spark.createDataFrame(full, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def test_training_profile(spark):
    df = table(spark, [
        ("u", "2024-01-01 10:00:00", 100.0, "B", "d2", "m", "Visa"), ("u", "2024-01-01 11:00:00", 200.0, "A", "d1", "m", "Amex"),
        ("u", "2024-01-02 10:00:00", 10001.0, "A", "d2", "n", "Amex", 1), ("u", "2024-01-03 09:00:00", 50.0, "B", None, "o", "Visa"),
        ("u", "2024-01-03 09:30:00", 50.0, "C", "d3", "p", None)])
    p = profiles.training_profile(df).first()
    assert p.account_age_days == 1 and p.total_transactions == 5  # 47.5 hours are one whole day
    assert p.transaction_frequency == 5.0 and p.fraud_history_count == 1
    assert [tuple(x) for x in p.typical_locations] == [("B", 2), ("A", 2), ("C", 1)]  # a tie keeps the first seen
    assert p.home_location == "A" and p.typical_card_type == "Amex"  # a tie takes the smallest
    assert [tuple(x) for x in p.typical_merchants] == [("m", 2), ("n", 1), ("o", 1)]
    assert [tuple(x) for x in p.active_hours] == [(10, 2), (9, 2), (11, 1)]
    assert p.known_devices == ["d2", "d1", None, "d3"]
    assert p.reference_photo_path == "photos/reference/u.jpg"


def test_photo_pointer_needs_more_than_the_limit(spark):
    p = profiles.training_profile(table(spark, [("u", "2024-01-01 10:00:00", 10000.0)])).first()
    assert p.reference_photo_path is None and p.transaction_frequency == 1.0 and p.home_location is None


def test_serving_profile_lists(spark):
    rows = [("u", f"2024-01-01 10:{i:02d}:00", float(i), f"L{i:02d}", "", "m", "Visa", int(i == 3)) for i in range(12)]
    p = profiles.serving_profile(table(spark, rows), "2024-01-02 10:05:00").first()
    assert p.n_locations == 12 and p.known_locations == [f"L{i:02d}" for i in range(10)]
    assert p.known_devices == [] and p.fraud_history == 1 and p.account_balance == 11.0
    assert p.recent_24h_count == 7 and (p.min_transaction, p.max_transaction) == (0.0, 11.0)


def test_user_without_history(spark):
    past = table(spark, [("u", "2024-01-01 10:00:00", 10.0, "A", "d", "m")])
    current = table(spark, [("other", "2024-01-05 10:00:00", 10.0, "A", "d", "m")])
    r = profiles.enrich(current, profiles.serving_profile(past, "2024-01-05 00:00:00")).first()
    assert r.total_transactions == 0 and r.avg_transaction_amount == 0.0 and r.known_devices == []
    found = patterns.detect_snapshot(current, past, "2024-01-05 00:00:00").first()
    assert [p.code for p in found.patterns] == ["new_device", "new_location", "first_merchant"]


def test_known_value_beyond_the_short_list(spark):
    past = table(spark, [("u", f"2024-01-01 10:{i:02d}:00", 10.0, f"L{i:02d}", "d", "m") for i in range(12)])
    current = table(spark, [("u", "2024-01-05 10:00:00", 50.0, "L11", "", None)])
    as_of = "2024-01-05 00:00:00"
    assert [p.code for p in patterns.detect_snapshot(current, past, as_of).first().patterns] == []
    short = patterns.detect_snapshot(current, past, as_of, cut_lists_first=True).first()
    assert [p.message for p in short.patterns] == ["⚠️ New location: L11"]


def test_amount_and_velocity_rules(spark):
    as_of = "2024-01-02 00:00:00"
    past = table(spark, [("u", f"2024-01-01 0{i // 6}:{i % 6}0:00", 10.0, "A", "d", "m", "v", int(i < 2)) for i in range(11)])
    exact, above = ("u", as_of, 50.0, "A", "d", "m"), ("u", as_of, 59.99, "A", "d", "m")
    out = {r.transaction_id: [p.message for p in r.patterns]
           for r in patterns.detect_snapshot(table(spark, [exact, above]), past, as_of).collect()}
    rest = ["⚠️ High velocity: 11 transactions in last 24 hours", "🚨 User has 2 previous fraud flags",
            "⚠️ Multiple transactions within 1 hour"]
    assert out[0] == rest
    assert out[1] == ["⚠️ Amount 5x higher than user average ($10.00)"] + rest


def test_timeline(spark):
    past = table(spark, [("u", f"2024-01-01 10:{i:02d}:00", 1000.0 + i, "A", "d", "m") for i in range(7)])
    current = table(spark, [("u", "2024-01-05 10:00:00", 1234.5, "B", "d", "n")])
    as_of = "2024-01-05 00:00:00"

    def events(**kw):
        joined = profiles.enrich(current, history.history_snapshot(past, as_of, **kw))
        return [e.event for e in joined.select(history.timeline().alias("t")).first().t]

    assert events() == [f"${1000 + i:,.2f} at m (A)" for i in range(2, 7)] + ["CURRENT: $1,234.50 at n (B)"]
    assert events(oldest_first_bug=True)[:5] == [f"${1000 + i:,.2f} at m (A)" for i in (4, 3, 2, 1, 0)]
    assert len(events(limit=3)) == 4


def test_newest_keeps_the_limit_and_the_days(spark):
    df = table(spark, [("u", f"2024-01-{d:02d} 10:00:00", 1.0) for d in range(1, 31)])
    assert [r.transaction_id for r in history.newest(df, 3).orderBy("rank").collect()] == [29, 28, 27]
    assert history.newest(df, 50, "2024-01-30 10:00:00", days=7).count() == 8


def test_lists_count_missing_values(spark):
    df = table(spark, [("u", "2024-01-01 10:00:00", 1.0, None), ("u", "2024-01-01 11:00:00", 1.0, None), ("u", "2024-01-01 12:00:00", 1.0, "A")])
    counts = values.value_counts(df, {"location": "location"})
    assert [(r.value, r.n) for r in values.top_values(counts, 3).orderBy("rank").collect()] == [(None, 2), ("A", 1)]
    assert values.modes(counts).first().value == "A"
