"""Bringing the monitor, evidence and photo branches together per transaction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions import scores
from riskflow.functions.text import rounded
from riskflow.operators import history, patterns, replies


def required(df: DataFrame, column="user_id"):
    """(rows with the field, rows without it plus an `error`): a bad row never stops the others."""
    present = F.coalesce(F.col(column).cast("string"), F.lit("")) != ""
    return df.where(present), df.where(~present).withColumn("error", F.lit(f"{column} is required"))


def monitor_result(scored: DataFrame, reply="reply") -> DataFrame:
    """Needs fraud_probability, the feature columns and the model reply of each transaction.

    A reply that stops the branch leaves only the error: score and verdict are null then.
    """
    parsed = replies.parse_monitor(scored, reply)
    good = F.col("error").isNull()
    analysis = F.struct("verdict", "risk_factors", "recommended_action", "reasoning")
    return parsed.select(
        "transaction_id",
        F.when(good, F.struct(scores.prediction("fraud_probability").alias("prediction"),
                              scores.feature_summary().alias("feature_summary"),
                              analysis.alias("analysis"))).alias("monitor"),
        F.when(good, F.col("verdict")).alias("monitor_verdict"),
        F.when(good, scores.score_percent("fraud_probability")).alias("final_score"),
        F.col("error").alias("monitor_error"))


def evidence_package(detected: DataFrame, summary="llm_summary") -> DataFrame:
    """(transaction_id, evidence, n_patterns) from the output of patterns.detect_snapshot."""
    text = F.coalesce(F.col(summary) if summary in detected.columns else F.lit(None).cast("string"),
                      F.lit(C.SUMMARY_FALLBACK))
    nothing = F.array().cast("array<struct<amount:double,merchant:string,time:timestamp,fraud_flag:int>>")
    profile = F.struct(
        F.col("user_id"), F.col("total_transactions"),
        rounded("avg_transaction_amount", 2).alias("avg_transaction_amount"),
        F.struct(rounded("min_transaction", 2).alias("min"), rounded("max_transaction", 2).alias("max"))
        .alias("transaction_range"),
        F.col("known_devices"),
        F.slice("known_locations", 1, C.EVIDENCE_LIST_LENGTH).alias("known_locations"),
        F.col("fraud_history"))
    activity = F.struct(F.col("history_count").alias("total_count"), F.col("recent_24h_count"),
                        F.coalesce("recent_transactions", nothing).alias("recent_transactions"))
    package = F.struct(profile.alias("user_profile"), activity.alias("transaction_history"),
                       history.timeline().alias("timeline"), patterns.messages().alias("detected_patterns"),
                       text.alias("summary"))
    return detected.select("transaction_id", package.alias("evidence"), F.size("patterns").alias("n_patterns"))


def evidence_branch(current: DataFrame, detect) -> DataFrame:
    """(transaction_id, evidence, n_patterns, evidence_error): a row without a user has the error in place of the
    evidence. detect(rows) gives the output of patterns.detect_snapshot."""
    valid, bad = required(current)
    good = evidence_package(detect(valid)).withColumn("evidence_error", F.lit(None).cast("string"))
    return good.unionByName(bad.select("transaction_id", F.col("error").alias("evidence_error")), allowMissingColumns=True)


def combine(txn: DataFrame, monitor: DataFrame, evidence: DataFrame, photo: DataFrame,
            assessment: DataFrame) -> DataFrame:
    """Fan-in on the transaction id; every side is optional, a failed side does not remove the transaction.

    photo: transaction_id, is_authentic, error, ...; assessment: output of replies.parse_assessment.
    """
    shot = F.struct(*[c for c in photo.columns if c != "transaction_id"])
    photo = photo.select("transaction_id", shot.alias("biometric"))
    said = F.struct(*[c for c in assessment.columns if c not in ("transaction_id", "reply")])
    assessment = assessment.select("transaction_id", said.alias("assessment"))
    joined = txn.select("transaction_id", "user_id")
    for side in (monitor, evidence, photo, assessment):
        joined = joined.join(side, "transaction_id", "left")
    present = F.struct(F.lit(True).alias("fraud_detection"), F.lit(True).alias("evidence_collection"),
                       photo_verified().alias("biometric_verification"))
    return joined.withColumn("agents_analyzed", present)


def photo_verified():
    """A photo was checked and the check did not fail."""
    return F.col("biometric").isNotNull() & F.col("biometric.error").isNull()


def summary(combined: DataFrame) -> DataFrame:
    """Flat result row per transaction."""
    return combined.select(
        "transaction_id", "user_id", F.col("assessment.final_verdict").alias("final_verdict"),
        F.col("assessment.confidence_score").alias("confidence"),
        F.col("assessment.risk_level").alias("risk_level"),
        F.coalesce("final_score", F.lit(0)).alias("ml_fraud_score"),
        F.coalesce("n_patterns", F.lit(0)).alias("suspicious_patterns"),
        photo_verified().alias("photo_verified"),
        F.col("assessment.recommended_action").alias("recommended_action"))
