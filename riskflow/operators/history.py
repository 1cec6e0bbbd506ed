"""Bounded views of each user's newest transactions, as of one moment."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions import times
from riskflow.functions.text import money, template


def newest(history: DataFrame, limit=C.HISTORY_DEFAULT_LIMIT, as_of=None, days=None) -> DataFrame:
    """The newest `limit` rows per user with their rank; optionally only rows since `as_of - days`.

    The limit is a rank filter, so each map task already drops all but its `limit` newest rows per user
    before the shuffle (WindowGroupLimit).
    """
    if days is not None:
        history = history.where(F.col("ts") >= times.as_time(as_of) - F.make_dt_interval(F.lit(days)))
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("transaction_id"))
    return history.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def event_text(amount, merchant, location, prefix=""):
    text = template(C.TIMELINE_EVENT_FORMAT, money(F.coalesce(amount, F.lit(0.0))),
                    F.coalesce(merchant, F.lit("Unknown")), F.coalesce(location, F.lit("Unknown")))
    return F.concat(F.lit(prefix), text) if prefix else text


def history_snapshot(history: DataFrame, as_of, limit=C.HISTORY_LIMIT, oldest_first_bug=False) -> DataFrame:
    """One row per user over the newest `limit` rows, in a single shuffle.

    history_count, velocity_count (rows of the last 24 h), rapid_succession, recent_transactions (newest 5,
    newest first) and past_events (5 entries of the timeline).

    The timeline shows the newest five events in time order. oldest_first_bug=True gives what a list that is
    sorted newest first yields when its last five entries are taken: the five oldest of the newest rows.
    """
    now = times.as_time(as_of)
    rows = newest(history.select("user_id", "transaction_id", "ts", "transaction_amount", "merchant_category",
                                 "location", "transaction_type", "fraud_label"), limit)
    recent = times.within_hours("ts", now)
    flag = F.coalesce("fraud_label", F.lit(0)).cast("int").alias("fraud_flag")
    brief = F.struct("rank", F.coalesce("transaction_amount", F.lit(0.0)).alias("amount"),
                     F.col("merchant_category").alias("merchant"), F.col("ts").alias("time"), flag)
    event = F.struct(
        "rank", F.col("ts").alias("time"),
        event_text(F.col("transaction_amount"), F.col("merchant_category"), F.col("location")).alias("event"),
        F.coalesce("transaction_type", F.lit("Unknown")).alias("type"), flag)
    fields = ["time", "event", "type", "fraud_flag"]
    snapshot = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("history_count"),
        F.count_if(recent).alias("velocity_count"),
        F.max(F.when(F.col("rank") == 1, times.micros("ts"))).alias("newest"),
        F.max(F.when(F.col("rank") == C.RAPID_ROWS, times.micros("ts"))).alias("third"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= C.RECENT_LENGTH, brief))).alias("briefs"),
        F.array_sort(F.collect_list(event if oldest_first_bug else
                                    F.when(F.col("rank") <= C.TIMELINE_LENGTH, event))).alias("events"))
    chosen = (F.slice("events", -F.least(F.size("events"), F.lit(C.TIMELINE_LENGTH)),
                      C.TIMELINE_LENGTH) if oldest_first_bug else F.reverse("events"))
    rapid = (F.col("velocity_count") >= C.RAPID_ROWS) & \
            (F.col("newest") - F.col("third") < C.RAPID_HOURS * times.HOUR_US)
    return snapshot.select(
        "user_id", "history_count", "velocity_count",
        F.coalesce(rapid, F.lit(False)).alias("rapid_succession"),
        F.transform("briefs", lambda x: F.struct(*[x[f].alias(f) for f in
                                                   ("amount", "merchant", "time", "fraud_flag")]))
        .alias("recent_transactions"),
        F.transform(chosen, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("past_events"))


def timeline(past_events="past_events", now="ts"):
    """Past events plus the current transaction as the last entry."""
    current = F.struct(
        F.col(now).cast("timestamp").alias("time"),
        event_text(F.col("transaction_amount"), F.col("merchant_category"), F.col("location"),
                   C.TIMELINE_CURRENT_PREFIX).alias("event"),
        F.coalesce("transaction_type", F.lit("Unknown")).alias("type"), F.lit(0).alias("fraud_flag"))
    nothing = F.array().cast("array<struct<time:timestamp,event:string,type:string,fraud_flag:int>>")
    return F.concat(F.coalesce(past_events, nothing), F.array(current))
