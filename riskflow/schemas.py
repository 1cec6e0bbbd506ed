"""Explicit schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

from riskflow import config as C

_TEXT = {"transaction_id", "user_id", "transaction_type", "device_type", "location", "merchant_category",
         "card_type", "authentication_method"}
_NUMBER = {"transaction_amount", "account_balance", "avg_transaction_amount_7d", "transaction_distance",
           "risk_score", "amount_deviation_ratio"}
_WHOLE = {c.lower() for c in C.RAW_COLUMNS + C.MODEL_FEATURES} - _TEXT - _NUMBER - {"timestamp"}


def canonical(name: str) -> str:
    """Column name used inside the package for a column of the raw file."""
    return "ts" if name == "Timestamp" else name.lower()


def _type(name: str) -> T.DataType:
    name = name.lower()
    return T.DoubleType() if name in _NUMBER else T.IntegerType() if name in _WHOLE else T.StringType()


def transaction_file(header) -> T.StructType:
    """Schema of a raw or enhanced file with these columns. The time, and unknown columns, stay text."""
    return T.StructType([T.StructField(c, _type(c)) for c in header])


# The raw table inside the package: short names, parsed time.
TRANSACTIONS = T.StructType([
    T.StructField(canonical(c), T.TimestampType() if c == "Timestamp" else _type(c)) for c in C.RAW_COLUMNS])

REQUEST = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("transaction_amount", T.DoubleType()), T.StructField("transaction_type", T.StringType()),
    T.StructField("merchant_category", T.StringType()), T.StructField("card_type", T.StringType()),
    T.StructField("device_type", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("authentication_method", T.StringType()), T.StructField("photo_path", T.StringType()),
    T.StructField("timestamp", T.StringType())])

# Numbers shown in messages are read as text, so that 90 stays "90" and 90.5 stays "90.5".
BIOMETRIC = """
    verification_result STRING,
    face_comparison STRUCT<match: BOOLEAN, similarity: STRING, confidence: DOUBLE>,
    quality_check STRUCT<is_real: BOOLEAN, confidence: DOUBLE, quality_score: STRING,
        quality_metrics: STRUCT<brightness: DOUBLE, sharpness: DOUBLE>,
        pose: MAP<STRING, DOUBLE>, emotions: ARRAY<STRUCT<type: STRING, confidence: DOUBLE>>>,
    liveness_check STRUCT<is_live: BOOLEAN, liveness_score: DOUBLE, confidence: DOUBLE,
        checks: MAP<STRING, BOOLEAN>>,
    reason STRING
"""

MONITOR_REPLY = "verdict STRING, risk_factors ARRAY<STRING>, recommended_action STRING, reasoning STRING"
PHOTO_REPLY = "verdict STRING, risk_assessment ARRAY<STRING>, recommended_action STRING, reasoning STRING"
ASSESSMENT_REPLY = """
    final_verdict STRING, confidence_score STRING, risk_level STRING, risk_summary STRING,
    key_findings ARRAY<STRING>, risk_factors ARRAY<STRING>, positive_indicators ARRAY<STRING>,
    decision_reasoning STRING, recommended_action STRING, agent_consensus STRING,
    confidence_breakdown STRUCT<ml_model_confidence: DOUBLE, behavioral_analysis_confidence: DOUBLE,
        biometric_confidence: DOUBLE, overall_confidence: DOUBLE>
"""
