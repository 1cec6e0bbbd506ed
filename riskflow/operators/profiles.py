"""One row per user: the training profile and the serving profile."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions import times
from riskflow.operators import values
from riskflow.operators.history import newest


def whole_days(first, last):
    """Completed days between two timestamps."""
    return F.timestamp_diff("DAY", first, last)


def training_profile(txn: DataFrame, photo_root="photos/reference", lists=True) -> DataFrame:
    """Behaviour baseline per user.

    lists=False leaves out the top-3 lists, the modes and the known devices, which need a second aggregation.
    """
    base = txn.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.avg("transaction_amount").alias("avg_transaction_amount"),
        whole_days(F.min("ts"), F.max("ts")).alias("account_age_days"),
        F.sum("previous_fraudulent_activity").alias("fraud_history_count"),
        F.max("transaction_amount").alias("highest_transaction"),
        F.avg("is_weekend").alias("weekend_transaction_ratio"))
    base = with_ratios(base, photo_root)
    if not lists:
        return base
    counts = values.value_counts(txn, {"location": "location", "merchant": "merchant_category",
                                       "card": "card_type", "device": "device_type", "hour": F.hour("ts")})
    return base.join(behaviour_lists(counts), "user_id", "left")


def with_ratios(base: DataFrame, photo_root="photos/reference") -> DataFrame:
    """What follows from a user's totals."""
    return base.withColumns({
        "transaction_frequency": F.col("total_transactions") / F.greatest(F.col("account_age_days"), F.lit(1)),
        "reference_photo_path": F.when(F.col("highest_transaction") > C.REFERENCE_PHOTO_AMOUNT,
                                       F.concat(F.lit(photo_root + "/"), F.col("user_id").cast("string"), F.lit(".jpg")))})


def behaviour_lists(counts: DataFrame) -> DataFrame:
    """Top-3 lists, modes and known devices per user from one table of value counts."""
    frequent = W.partitionBy("user_id", "field").orderBy(F.desc("n"), F.asc("first"), F.asc("value"))
    # null values never win a mode
    common = W.partitionBy("user_id", "field").orderBy(F.col("value").isNull(), F.desc("n"), F.asc("value"))
    seen = W.partitionBy("user_id", "field").orderBy(F.asc("first"), F.asc("value"))
    ranked = counts.select("*", F.row_number().over(frequent).alias("by_count"),
                           F.row_number().over(common).alias("by_mode"),
                           F.row_number().over(seen).alias("by_first"))
    kept = ranked.where((F.col("by_count") <= C.TOP_VALUES) | (F.col("by_mode") == 1) |
                        (F.col("field") == "device"))

    def top(field, kind="string"):
        item = F.struct("by_count", F.col("value").cast(kind).alias("value"), F.col("n").alias("count"))
        chosen = F.collect_list(F.when((F.col("field") == field) & (F.col("by_count") <= C.TOP_VALUES), item))
        return F.transform(F.array_sort(chosen), lambda x: F.struct(x["value"].alias("value"),
                                                                    x["count"].alias("count")))

    def mode(field):
        return F.max(F.when((F.col("field") == field) & (F.col("by_mode") == 1), F.col("value")))

    devices = F.collect_list(F.when(F.col("field") == "device", F.struct("by_first", "value")))
    return kept.groupBy("user_id").agg(
        top("location").alias("typical_locations"), mode("location").alias("home_location"),
        F.transform(F.array_sort(devices), lambda x: x["value"]).alias("known_devices"),
        top("merchant").alias("typical_merchants"), mode("card").alias("typical_card_type"),
        top("hour", "int").alias("active_hours"))


def known_values(txn: DataFrame) -> DataFrame:
    """Distinct non-empty devices, locations and merchants of each user: (user_id, field, value)."""
    return (values.field_values(txn, values.KNOWN_FIELDS)
            .where(F.col("value") != "").distinct())


def known_lists(known: DataFrame, length=C.PROFILE_LIST_LENGTH) -> DataFrame:
    """Sorted lists for display, cut to `length`, and the full number of distinct values."""
    order = W.partitionBy("user_id", "field").orderBy("value")
    ranked = known.withColumn("rank", F.row_number().over(order))
    names = {"device": "devices", "location": "locations", "merchant": "merchants"}
    shown = [F.sort_array(F.collect_list(F.when((F.col("field") == f) & (F.col("rank") <= length),
                                                F.col("value")))).alias(f"known_{n}") for f, n in names.items()]
    number = [F.count_if(F.col("field") == f).alias(f"n_{n}") for f, n in names.items()]
    return ranked.groupBy("user_id").agg(*shown, *number)


def serving_profile(history: DataFrame, as_of=None, lists=True, balance=True, known=None) -> DataFrame:
    """Profile read when a transaction is scored.

    `as_of` adds `recent_24h_count`: rows of the last 24 hours, without any cap. The balance is that of the
    newest row; it takes a pass of its own, in which every task keeps one row per user. `known` (known_values) may be
    given as a stored table.
    """
    as_of_count = [] if as_of is None else [
        F.count_if(times.within_hours("ts", times.as_time(as_of))).alias("recent_24h_count")]
    amount = F.coalesce("transaction_amount", F.lit(0.0))
    base = history.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.avg(amount).alias("avg_transaction_amount"),
        F.min(amount).alias("min_transaction"), F.max(amount).alias("max_transaction"),
        F.count_if(F.col("fraud_label") == 1).alias("fraud_history"),
        *as_of_count)
    if balance and "account_balance" in history.columns:
        last = newest(history.select("user_id", "ts", "transaction_id", "account_balance"), 1)
        base = base.join(last.select("user_id", "account_balance"), "user_id", "left")
    known = known_values(history) if known is None else known
    return base.join(known_lists(known), "user_id", "left") if lists else base


def recent_counts(history: DataFrame, as_of, hours=C.RECENT_HOURS) -> DataFrame:
    """Rows of each user in the last hours, without a cap; a plain bound on `ts`, which a scan can use."""
    return (history.where(F.col("ts") >= times.as_time(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("recent_count")))


ZERO_PROFILE = {"total_transactions": 0, "avg_transaction_amount": 0.0, "min_transaction": 0.0,
                "max_transaction": 0.0, "fraud_history": 0, "recent_24h_count": 0}


def enrich(txn: DataFrame, profile: DataFrame) -> DataFrame:
    """Transactions with their user's profile; a user without history gets the zero profile."""
    clash = [c for c in profile.columns if c in txn.columns and c != "user_id"]
    joined = txn.join(profile.drop(*clash), "user_id", "left")
    zero = {c: v for c, v in ZERO_PROFILE.items() if c in joined.columns}
    lists = {c: F.coalesce(c, F.array().cast("array<string>"))
             for c in ("known_devices", "known_locations", "known_merchants") if c in joined.columns}
    return joined.fillna(zero).withColumns(lists) if lists else joined.fillna(zero)


def dataset_statistics(txn: DataFrame) -> DataFrame:
    """Rows, users and label shares of a table: one row."""
    per_user = txn.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("fraud_label").alias("fraud"))
    return per_user.agg(
        F.sum("n").alias("n_transactions"), F.count("user_id").alias("n_users"),
        F.sum("fraud").alias("n_fraud"), (F.sum("n") - F.sum("fraud")).alias("n_legitimate"),
        (F.sum("fraud") / F.sum("n")).alias("fraud_rate"))
