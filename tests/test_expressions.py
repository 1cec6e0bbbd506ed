"""Row-level formulas at their boundaries."""

import random

from pyspark.sql import functions as F

from riskflow.functions import scores, text, times
from riskflow.operators import features


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_number_formats_equal_python(spark):
    rnd = random.Random(1)
    xs = [0.125, 2.675, 1.005, 1234567.885, 0.5, -3.14159, 1e-7] + [round(rnd.random() * 1e5, rnd.choice([3, 5])) for _ in range(500)]
    assert column(spark, xs, "double", text.money("x")) == [f"{x:,.2f}" for x in xs]
    assert column(spark, xs, "double", text.plain("x")) == [f"{x:.2f}" for x in xs]
    assert column(spark, xs, "double", text.rounded("x", 4)) == [round(x, 4) for x in xs]


def test_score_and_band_edges(spark):
    assert column(spark, [29, 30, 69, 70, None], "int", scores.risk_band("x")) == ["LOW", "MEDIUM", "MEDIUM", "HIGH", None]
    ps = [0.29, 0.3, 0.999, 1.0, 0.57]
    assert column(spark, ps, "double", scores.score_percent("x")) == [int(p * 100) for p in ps]


def test_deviation_edges(spark):
    assert column(spark, [0.0, None, 50.0], "double", scores.deviation_training(F.lit(100.0), "x")) == [100.0, None, 2.0]
    assert column(spark, [0.0, None, 50.0], "double", scores.deviation_serving(F.lit(20.0), "x")) == [0.0, None, 0.6]


def test_high_value_is_strict(spark):
    assert column(spark, [1000.0, 1000.01], "double", scores.high_value_serving("x")) == [0, 1]
    assert column(spark, [80.0, 80.01], "double", scores.high_value_training("x", F.lit(100.0))) == [0, 1]


def test_unusual_hours(spark):
    hours = [f"2024-01-06 {h:02d}:59:59" for h in range(24)]
    serving = column(spark, hours, "string", times.unusual_hour_serving(F.col("x").cast("timestamp")))
    training = column(spark, hours, "string", times.unusual_hour_training(F.col("x").cast("timestamp")))
    assert [h for h in range(24) if serving[h]] == [0, 1, 2, 3, 4, 5, 23]
    assert [h for h in range(24) if training[h]] == [2, 3, 4, 5, 6]


def test_request_time_uses_the_written_clock_or_as_of(spark):
    df = spark.createDataFrame([("2024-01-01T23:10:00+05:00",), ("2024-01-06T04:00:00Z",), ("soon",), (None,)], "timestamp string")
    out = features.with_time_features(features.with_request_time(df, "2024-01-03 12:00:00")).collect()
    assert [(r.hour_of_day, r.day_of_week, r.is_weekend, r.is_unusual_hour) for r in out] == [
        (23, 0, 0, 1), (4, 5, 1, 1), (12, 2, 0, 0), (12, 2, 0, 0)]
    assert [str(r.ts) for r in out[:2]] == ["2024-01-01 18:10:00", "2024-01-06 04:00:00"]
    assert str(out[0].wall_time) == "2024-01-01 23:10:00" and str(out[3].ts) == "2024-01-03 12:00:00"


def test_within_24_hours(spark):
    stamps = ["2024-01-09 12:00:00", "2024-01-09 11:59:59.999999", "2024-01-11 00:00:00", None]
    got = column(spark, stamps, "string", times.within_hours(F.col("x").cast("timestamp"), times.as_time("2024-01-10 12:00:00")))
    assert got == [True, False, True, False]


# amount, unusual hour, type, merchant, location, authentication -> score; worked out by hand
SCORES = [
    ((5000.01, 0, None, None, None, None), 0.3), ((5000.0, 0, None, None, None, None), 0.2),
    ((2000.01, 0, None, None, None, None), 0.2), ((2000.0, 0, None, None, None, None), 0.1),
    ((1000.01, 0, None, None, None, None), 0.1), ((1000.0, 0, None, None, None, None), 0.0),
    ((10.0, 0, None, None, None, None), 0.0), ((9.99, 0, None, None, None, None), 0.05),
    ((50.0, 1, None, None, None, None), 0.2), ((50.0, 0, "WITHDRAWAL", None, None, None), 0.15),
    ((50.0, 0, "Transfer", None, None, None), 0.15), ((50.0, 0, "purchase", None, None, None), 0.05),
    ((50.0, 0, "ATM Withdrawal", None, None, None), 0.0), ((50.0, 0, None, "Consumer Electronics", None, None), 0.15),
    ((50.0, 0, None, "CRYPTOcurrency", None, None), 0.15), ((50.0, 0, None, "Jewelry and travel", None, None), 0.15),
    ((50.0, 0, None, "Retail", None, None), 0.0), ((50.0, 0, None, None, "Unknown", None), 0.1),
    ((50.0, 0, None, None, "INTERNATIONAL zone", None), 0.1), ((50.0, 0, None, None, "Tokyo", None), 0.0),
    ((50.0, 0, None, None, None, "None"), 0.1), ((50.0, 0, None, None, None, "Password"), 0.1),
    ((50.0, 0, None, None, None, "PIN"), 0.0), ((6000.0, 1, "transfer", "travel", "unknown", "none"), 1.0),
    ((1500.0, 1, "Purchase", "Grocery", "International", "password"), 0.55)]


def test_heuristic_score(spark):
    df = spark.createDataFrame([r for r, _ in SCORES], "transaction_amount double, is_unusual_hour int, transaction_type string, "
                                                       "merchant_category string, location string, authentication_method string")
    got = [round(r[0], 9) for r in df.select(scores.heuristic_risk()).collect()]
    assert got == [want for _, want in SCORES]


def test_rounding_of_what_is_no_finite_number(spark):
    got = column(spark, [float("inf"), float("nan"), None, 1.005], "double", text.rounded("x", 2))
    assert got[0] == float("inf") and got[1] != got[1] and got[2:] == [None, 1.0]


def test_defaults_fill_absent_columns_only(spark):
    df = spark.createDataFrame([(1, 250.0, None)], "transaction_id int, transaction_amount double, location string") \
        .withColumn("ts", F.lit("2024-01-06 03:00:00").cast("timestamp"))
    r = features.model_input(features.assemble_defaults(df)).first()
    assert (r.location, r.transaction_type, r.card_type, r.account_balance) == (None, "Purchase", "Credit", 50000.0)
    assert (r.amount_deviation_ratio, r.is_high_value, r.is_weekend, r.hour_of_day) == (0.25, 0, 1, 3)
    assert len(r) == 22


def test_missing_model_inputs_become_zero(spark):
    r = features.model_input(spark.createDataFrame([(7.5,)], "Transaction_Amount double")).first()
    assert r.transaction_amount == 7.5 and sum(1 for v in r if v == 0) == 21
