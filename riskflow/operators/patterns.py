"""The seven behaviour patterns, as messages per transaction and as a long table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions.text import plain, template
from riskflow.operators import history, profiles, values
from riskflow.operators import point_in_time as pit


def _rules(amount, average, velocity, new_device, new_location, new_merchant, frauds, rapid,
           velocity_limit) -> dict:
    """Pattern code -> (condition, values shown in the message), in rule order."""
    average = F.coalesce(average, F.lit(0.0))
    times_average = (amount / F.nullif(average, F.lit(0.0))).cast("long")
    return {
        "amount_anomaly": ((average > 0) & (amount > average * C.AMOUNT_ANOMALY_FACTOR),
                           [times_average, plain(average)]),
        "high_velocity": (velocity > velocity_limit, [velocity]),
        "new_device": (new_device, [F.col("device_type")]),
        "new_location": (new_location, [F.col("location")]),
        "first_merchant": (new_merchant, [F.col("merchant_category")]),
        "fraud_history": (frauds > 0, [frauds]),
        "rapid_succession": (rapid, []),
    }


def _with_patterns(df: DataFrame, rules: dict) -> DataFrame:
    """Adds `patterns`, the list of (code, message) structs in rule order."""
    found = [F.when(F.coalesce(condition, F.lit(False)),
                    F.struct(F.lit(code).alias("code"),
                             template(C.PATTERN_FORMATS[code], *shown).alias("message")))
             for code, (condition, shown) in rules.items()]
    return df.withColumn("patterns", F.array_compact(F.array(*found)))


def user_snapshot(past: DataFrame, as_of, limit=C.HISTORY_LIMIT, oldest_first_bug=False, known=None) -> DataFrame:
    """Everything known about a user at one moment: profile, newest rows, recent counts. One row per user.

    `known` (profiles.known_values) may be given as a stored table."""
    return profiles.serving_profile(past, as_of, balance=False, known=known).join(
        history.history_snapshot(past, as_of, limit, oldest_first_bug), "user_id", "left")


def new_against(current: DataFrame, known: DataFrame) -> DataFrame:
    """new_device, new_location, new_merchant: the value is not in `known`, all values of the users' history.

    One narrow row per transaction and field meets the known values; only the unknown ones, usually few, go
    back to the transactions.
    """
    long = values.field_values(current, values.KNOWN_FIELDS, keep=("transaction_id",)).where("value != ''")
    unknown = long.join(known, ["user_id", "field", "value"], "left_anti")
    flags = unknown.groupBy("transaction_id").agg(*[
        F.expr(f"count_if(field = '{f}') > 0").alias(f"new_{f}") for f in values.KNOWN_FIELDS])
    return current.join(flags, "transaction_id", "left").fillna(False, [f"new_{f}" for f in values.KNOWN_FIELDS])


def detect_snapshot(current: DataFrame, past: DataFrame, as_of, velocity_limit=C.VELOCITY_LIMIT,
                    cut_lists_first=False, snapshot=None, known=None) -> DataFrame:
    """Current transactions against the history before `as_of`, with the user's snapshot columns.

    `snapshot` (user_snapshot) and `known` (profiles.known_values) may be given, read from tables that were
    written once; then the history is not read at all.

    New values are tested against all values of the history. cut_lists_first=True tests against the short
    display lists instead, which flags values of users with long lists although they are known.
    """
    snapshot = user_snapshot(past, as_of) if snapshot is None else snapshot
    shown = current.join(snapshot, "user_id", "left")
    zero = {**profiles.ZERO_PROFILE, "history_count": 0, "velocity_count": 0, "rapid_succession": False}
    nothing = F.array().cast("array<string>")
    shown = shown.fillna({c: v for c, v in zero.items() if c in shown.columns}).withColumns(
        {c: F.coalesce(c, nothing) for c in ("known_devices", "known_locations", "known_merchants")})
    if cut_lists_first:
        shown = shown.withColumns({
            f"new_{f}": F.expr(f"coalesce({c}, '') != '' AND NOT array_contains(known_{f}s, coalesce({c}, ''))")
            for f, c in values.KNOWN_FIELDS.items()})
    else:
        shown = new_against(shown, profiles.known_values(past) if known is None else known)
    rules = _rules(F.col("transaction_amount"), F.col("avg_transaction_amount"), F.col("velocity_count"),
                   F.col("new_device"), F.col("new_location"), F.col("new_merchant"),
                   F.col("fraud_history"), F.col("rapid_succession"), velocity_limit)
    return _with_patterns(shown, rules)


def detect_point_in_time(txn: DataFrame, velocity_limit=C.VELOCITY_LIMIT, history_limit=C.HISTORY_LIMIT) -> DataFrame:
    """Every transaction against its user's earlier rows.

    The 24-hour count is taken over at most `history_limit` newest rows, as in the snapshot form.
    """
    df = pit.point_in_time(txn, parts=(pit.ALL, pit.LAST_24H, pit.TIMES, pit.FIRST))
    rules = _rules(F.col("transaction_amount"), F.col("hist_avg_amount"),
                   F.least("count_24h", F.lit(history_limit)),  # the rule looks at that many newest rows
                   F.col("is_new_device") == 1, F.col("is_new_location") == 1, F.col("is_new_merchant") == 1,
                   F.col("hist_fraud"), F.col("rapid_succession"), velocity_limit)
    return _with_patterns(df, rules)


def long_form(df: DataFrame) -> DataFrame:
    """One row per transaction and pattern."""
    return df.select("transaction_id", F.inline("patterns").alias("pattern_code", "detail"))


def pattern_counts(df: DataFrame) -> DataFrame:
    return long_form(df).groupBy("pattern_code").agg(F.count(F.lit(1)).alias("n"))


def messages(patterns="patterns") -> Column:
    return F.transform(patterns, lambda p: p["message"])
