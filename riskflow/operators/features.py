"""Feature tables: time features, first-seen flags, the enhanced training table and the model input."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions import scores, times
from riskflow.operators import point_in_time as pit


def with_time_features(df: DataFrame, ts=None, mode="serving") -> DataFrame:
    """hour_of_day, day_of_week, is_weekend and the unusual-hour flag of one of the two modes.

    They are those of the written clock, `wall_time`, where the table has it, else of `ts`.
    """
    ts = ts or ("wall_time" if "wall_time" in df.columns else "ts")
    unusual = times.unusual_hour_serving(ts) if mode == "serving" else times.unusual_hour_training(ts)
    return df.withColumns({"hour_of_day": times.hour_of_day(ts), "day_of_week": times.day_of_week(ts),
                           "is_weekend": times.is_weekend(ts), "is_unusual_hour": unusual})


def with_request_time(df: DataFrame, as_of, text="timestamp") -> DataFrame:
    """`ts`, the instant that a request's time names (for order, windows and dates), and `wall_time`, the clock as it
    is written (for hour and weekday); `as_of` where there is no readable time."""
    now = times.as_time(as_of)
    return df.withColumns({"ts": F.coalesce(times.instant(text), now),
                           "wall_time": F.coalesce(times.wall_clock(text).cast("timestamp"), now)})


def first_seen_flags(txn: DataFrame, hot=None) -> DataFrame:
    """is_new_device, is_new_location, is_new_merchant: no earlier row of the user has the value."""
    return pit.point_in_time(txn, parts=(pit.FIRST,), hot=hot)


def high_value_training(txn: DataFrame) -> DataFrame:
    """is_high_value: above 0.8 of the user's own maximum, this row included; `user_max_amount` if the history pass left it."""
    if "user_max_amount" not in txn.columns:
        tops = txn.groupBy("user_id").agg(F.max("transaction_amount").alias("user_max_amount"))
        txn = txn.join(tops, "user_id", "left")
    return txn.withColumn("is_high_value", scores.high_value_training("transaction_amount", "user_max_amount")) \
        .drop("user_max_amount")


def enhance(txn: DataFrame, mode="training") -> DataFrame:
    """The raw table plus the six calculated features.

    training    reproduces the batch script: ratio to the average, share of the user's maximum,
                is_new_device always 0 because the device list contains the row itself
    serving     fixed amount threshold and relative distance; is_new_device constant 0
    consistent  what a model should be trained on and scored with: serving formulas, and
                is_new_device from the user's earlier rows
    """
    out = with_time_features(txn, mode="training" if mode == "training" else "serving")
    if mode == "training":
        ratio = scores.deviation_training("transaction_amount", "avg_transaction_amount_7d")
        out = high_value_training(out).withColumn("is_new_device", scores.new_device_training())
    else:
        ratio = F.coalesce(scores.deviation_serving("transaction_amount", "avg_transaction_amount_7d"),
                           F.lit(0.0))
        out = out.withColumn("is_high_value", scores.high_value_serving("transaction_amount"))
        if mode == "serving":
            out = out.withColumn("is_new_device", F.lit(0))
        elif "is_new_device" not in out.columns:
            out = first_seen_flags(out).drop("is_new_location", "is_new_merchant")
    return out.withColumn("amount_deviation_ratio", ratio)


def with_history_features(txn: DataFrame, first_seen=False, hot=None, top=False) -> DataFrame:
    """Adds the raw columns that depend on history: daily count, 7-day average and failures, prior fraud.

    first_seen adds is_new_device in the same pass, which `enhance` in mode "consistent" then uses; top adds
    user_max_amount, which mode "training" uses up.
    """
    added = ["daily_transaction_count", "avg_transaction_amount_7d", "failed_transaction_count_7d",
             "previous_fraudulent_activity"] + (["is_new_device"] if first_seen else []) + (["user_max_amount"] if top else [])
    parts = (pit.ALL, pit.LAST_7D, pit.TODAY) + ((pit.FIRST,) if first_seen else ()) + ((pit.TOP,) if top else ())
    full = pit.point_in_time(txn.drop(*added), parts=parts, hot=hot)
    return full.select(*[c for c in txn.columns if c not in added], *added)


def assemble_defaults(requests: DataFrame) -> DataFrame:
    """The 22 model inputs of a request when nothing is known about its user.

    A default stands in only for a column the request table lacks, never for a null. Needs `ts`.
    """
    have = {c.lower() for c in requests.columns}
    constants = {
        "account_balance": F.lit(C.DEFAULT_ACCOUNT_BALANCE), "previous_fraudulent_activity": F.lit(0),
        "daily_transaction_count": F.lit(C.DEFAULT_DAILY_COUNT),
        "avg_transaction_amount_7d": F.lit(C.DEFAULT_AVG_AMOUNT_7D), "failed_transaction_count_7d": F.lit(0),
        "card_age": F.lit(C.DEFAULT_CARD_AGE), "ip_address_flag": F.lit(0), "transaction_distance": F.lit(0),
        "is_new_device": F.lit(0)}
    absent = {c: F.lit(v) for c, v in C.FEATURE_DEFAULTS.items() if c not in have}
    if "transaction_amount" not in have:
        absent["transaction_amount"] = F.lit(0.0)
    out = with_time_features(requests.withColumns({**constants, **absent}))
    return out.withColumns({
        "amount_deviation_ratio": scores.deviation_serving("transaction_amount", "avg_transaction_amount_7d"),
        "is_high_value": scores.high_value_serving("transaction_amount")})


def model_input(df: DataFrame, keep=()) -> DataFrame:
    """The 22 model inputs in their fixed order; a missing column becomes 0."""
    have = {c.lower() for c in df.columns}
    return df.select(*keep, *[F.col(c).alias(c.lower()) if c.lower() in have else F.lit(0).alias(c.lower())
                              for c in C.MODEL_FEATURES])


def training_features(df: DataFrame) -> list:
    """Names of the feature columns: everything that is not excluded."""
    excluded = {c.lower() for c in C.EXCLUDED_FEATURES} | {"ts", "wall_time"}
    return [c for c in df.columns if c.lower() not in excluded]
