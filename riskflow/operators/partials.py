"""Profiles that are kept up to date: per-day partial results that add up to the profiles of the whole history.

A part holds, for some rows of a user's day, numbers that can be merged: counts, sums, extremes, the count and first time of each value,
and the newest rows. Merging parts in any order gives what one pass over all their rows gives (sums of doubles up to rounding), so a
profile needs the parts, a row per user and day and one per value, and never the rows again.

Rows without a time have the null day. Rows without a user are a user of their own, as in the profiles.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.operators import history, profiles, values

FIELDS = {"location": "location", "merchant": "merchant_category", "card": "card_type", "device": "device_type"}
NEWEST = C.HISTORY_DEFAULT_LIMIT
USER, DAY = ["user_id"], ["user_id", "day"]

#: name -> (what rows give, how parts merge)
_TOTALS = {
    "n": ("count(1)", "sum"), "n_amounts": ("count(transaction_amount)", "sum"), "amount": ("sum(transaction_amount)", "sum"),
    "least": ("min(transaction_amount)", "min"), "most": ("max(transaction_amount)", "max"), "first_ts": ("min(ts)", "min"),
    "last_ts": ("max(ts)", "max"), "prior_fraud": ("sum(previous_fraudulent_activity)", "sum"), "weekend": ("sum(is_weekend)", "sum"),
    "n_weekend": ("count(is_weekend)", "sum"), "n_fraud": ("count_if(fraud_label = 1)", "sum"),
    "newest": ("max(named_struct('ts', ts, 'transaction_id', transaction_id, 'account_balance', account_balance))", "max")}
_OPTIONAL = {"previous_fraudulent_activity": "int", "is_weekend": "int", "fraud_label": "int", "account_balance": "double"}


def _dated(txn: DataFrame) -> DataFrame:
    absent = {c: F.lit(None).cast(k) for c, k in _OPTIONAL.items() if c not in txn.columns}
    return txn.withColumns({**absent, "day": F.to_date("ts")})


def totals(txn: DataFrame) -> DataFrame:
    """user_id, day and the mergeable numbers of each user's day."""
    return _dated(txn).groupBy(*DAY).agg(*[F.expr(rows).alias(c) for c, (rows, _) in _TOTALS.items()])


def merged_totals(parts: DataFrame, by=USER) -> DataFrame:
    return parts.groupBy(*by).agg(*[F.expr(f"{how}({c})").alias(c) for c, (_, how) in _TOTALS.items()])


def value_parts(txn: DataFrame) -> DataFrame:
    """user_id, day, field, value, n, first."""
    long = values.field_values(_dated(txn), {**FIELDS, "hour": F.hour("ts")}, keep=("day", "ts"))
    return long.groupBy(*DAY, "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))


def merged_values(parts: DataFrame, by=USER) -> DataFrame:
    return parts.groupBy(*by, "field", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def newest_parts(txn: DataFrame, limit=NEWEST) -> DataFrame:
    """The newest `limit` rows of each user's day."""
    rows = _dated(txn)
    order = "row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, transaction_id DESC)"
    return rows.withColumn("place", F.expr(order)).where(F.col("place") <= limit).drop("place")


def merged_newest(parts: DataFrame, limit=NEWEST) -> DataFrame:
    """The newest `limit` rows of each user with their rank."""
    return history.newest(parts.drop("day"), limit)


def training_profile(total: DataFrame, counts: DataFrame, photo_root="photos/reference") -> DataFrame:
    """`profiles.training_profile` from merged totals and values."""
    base = total.select(
        "user_id", F.col("n").alias("total_transactions"), (F.col("amount") / F.col("n_amounts")).alias("avg_transaction_amount"),
        profiles.whole_days(F.col("first_ts"), F.col("last_ts")).alias("account_age_days"), F.col("prior_fraud").alias("fraud_history_count"),
        F.col("most").alias("highest_transaction"), (F.col("weekend") / F.col("n_weekend")).alias("weekend_transaction_ratio"))
    return profiles.with_ratios(base, photo_root).join(profiles.behaviour_lists(counts), "user_id", "left")


def serving_profile(total: DataFrame, counts: DataFrame, recent: DataFrame = None) -> DataFrame:
    """`profiles.serving_profile` from merged totals and values; `recent` (profiles.recent_counts) adds the rows of the last
    24 hours, which end at an instant and not at midnight: a bounded read of the history."""
    nulls = F.col("n") > F.col("n_amounts")  # a missing amount counts as 0
    zero = F.when(nulls, F.lit(0.0))
    base = total.select(
        "user_id", F.col("n").alias("total_transactions"), (F.coalesce("amount", F.lit(0.0)) / F.col("n")).alias("avg_transaction_amount"),
        F.least("least", zero).alias("min_transaction"), F.greatest("most", zero).alias("max_transaction"), F.col("n_fraud").alias("fraud_history"),
        F.col("newest.account_balance").alias("account_balance"))
    if recent is not None:
        base = base.join(recent.withColumnRenamed("recent_count", "recent_24h_count"), "user_id", "left").fillna({"recent_24h_count": 0})
    known = counts.where(F.col("field").isin(*values.KNOWN_FIELDS) & (F.col("value") != "")).select("user_id", "field", "value")
    return base.join(profiles.known_lists(known), "user_id", "left")
