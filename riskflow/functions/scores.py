"""Row-level feature and score expressions (no shuffle, all inside whole-stage code generation)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions.text import rounded
from riskflow.functions.times import col


def deviation_training(amount, average) -> Column:
    """Amount over the 7-day average; an average of 0 counts as 1, a missing one stays missing."""
    average = col(average)
    return col(amount) / F.when(average == 0, F.lit(1.0)).otherwise(average)


def deviation_serving(amount, average) -> Column:
    """Relative distance from the 7-day average; 0 where the average is 0."""
    average = col(average)
    return F.when(average == 0, F.lit(0.0)).otherwise(
        F.abs(col(amount) - average) / F.nullif(average, F.lit(0.0)))


def high_value_serving(amount, threshold=C.HIGH_VALUE_AMOUNT) -> Column:
    return (col(amount) > threshold).cast("int")


def high_value_training(amount, user_max) -> Column:
    return (col(amount) > F.coalesce(col(user_max), F.lit(0.0)) * C.HIGH_VALUE_SHARE_OF_MAX).cast("int")


def new_device_training() -> Column:
    """The device list of a user includes the row itself, so no device is ever new."""
    return F.lit(0)


def _lowered(c) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def _contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def heuristic_risk(amount="transaction_amount", unusual_hour="is_unusual_hour", kind="transaction_type",
                   merchant="merchant_category", location="location",
                   authentication="authentication_method") -> Column:
    """Additive score between 0 and 1 from six independent factors."""
    amount = F.coalesce(col(amount), F.lit(0.0))
    size = reduce(lambda case, step: case.when(amount > step[0], F.lit(step[1])), C.AMOUNT_STEPS, F)
    size = size.when(amount < C.TINY_AMOUNT, F.lit(C.TINY_AMOUNT_RISK)).otherwise(F.lit(0.0))
    kind = _lowered(kind)
    by_type = reduce(lambda case, t: case.when(kind == t[0], F.lit(t[1])), C.TYPE_RISK.items(), F)
    factors = [
        size,
        F.when(col(unusual_hour) == 1, F.lit(C.UNUSUAL_HOUR_RISK)).otherwise(F.lit(0.0)),
        by_type.otherwise(F.lit(0.0)),
        F.when(_contains_any(_lowered(merchant), C.RISKY_MERCHANT_WORDS),
               F.lit(C.RISKY_MERCHANT_RISK)).otherwise(F.lit(0.0)),
        F.when(_contains_any(_lowered(location), C.RISKY_LOCATION_WORDS),
               F.lit(C.RISKY_LOCATION_RISK)).otherwise(F.lit(0.0)),
        F.when(_lowered(authentication).isin(C.WEAK_AUTHENTICATION),
               F.lit(C.WEAK_AUTHENTICATION_RISK)).otherwise(F.lit(0.0)),
    ]
    return F.least(reduce(lambda a, b: a + b, factors), F.lit(1.0))


def score_percent(probability) -> Column:
    """0..100, truncated."""
    return (col(probability) * 100).cast("int")


def risk_band(score) -> Column:
    score = col(score)
    return (F.when(score < C.LOW_BELOW, "LOW").when(score < C.MEDIUM_BELOW, "MEDIUM")
            .when(score.isNotNull(), "HIGH"))


def confidence(probability) -> Column:
    return F.greatest(col(probability), 1 - col(probability))


def predicted(probability, threshold=C.EVALUATION_THRESHOLD) -> Column:
    return (col(probability) >= threshold).cast("int")


def prediction(probability) -> Column:
    """Struct of everything reported about one probability."""
    return F.struct(
        rounded(probability, 4).alias("fraud_probability"),
        score_percent(probability).alias("fraud_score"),
        risk_band(score_percent(probability)).alias("risk_level"),
        rounded(confidence(probability), 4).alias("model_confidence"))


def predicted_label(probability) -> Column:
    """1 from the cut on that a single prediction uses."""
    return (col(probability) >= C.LABEL_THRESHOLD).cast("int")


def feature_summary(amount="transaction_amount", kind="transaction_type", merchant="merchant_category",
                    unusual="is_unusual_hour", hour="hour_of_day", high="is_high_value") -> Column:
    return F.struct(
        col(amount).alias("amount"), col(kind).alias("type"), col(merchant).alias("merchant"),
        F.coalesce(col(unusual), F.lit(0)).cast("int").alias("time_based_risk"),
        F.coalesce(col(hour), F.lit(0)).cast("int").alias("hour"),
        F.coalesce(col(high), F.lit(0)).cast("int").alias("is_high_value"))
