"""The driver's tables as canonical transactions, photo-check responses and model replies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-25 00:00:00"

_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str, location=True, balance=False, where="true") -> DataFrame:
    """One transaction per event. The two columns that need a join are optional; `where` filters the events."""
    return from_events(table(spark, folder, "events").where(where),
                       table(spark, folder, "nation") if location else None,
                       table(spark, folder, "customer") if balance else None)


def past_and_current(spark: SparkSession, folder: str, **columns):
    """Transactions before and from AS_OF; the time filter reaches the scan."""
    return (transactions(spark, folder, where=f"ts < TIMESTAMP_NTZ '{AS_OF}'", **columns),
            transactions(spark, folder, where=f"ts >= TIMESTAMP_NTZ '{AS_OF}'", **columns))


def from_events(events: DataFrame, nation: DataFrame = None, customer: DataFrame = None) -> DataFrame:
    """Works on a batch and on a stream of events."""
    e = events.withColumn("k", F.expr("try_cast(regexp_extract(props, '[0-9]+', 0) AS INT)"))
    columns = ["event_id AS transaction_id", "user_id", "CAST(ts AS TIMESTAMP) AS ts",
               "value * 25 AS transaction_amount", """
        CASE event_type WHEN 'purchase' THEN 'Purchase' WHEN 'signup' THEN 'Withdrawal' WHEN 'click' THEN 'Transfer'
             WHEN 'view' THEN 'Online' ELSE 'ATM Withdrawal' END AS transaction_type""",
               "CASE k % 3 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Desktop' ELSE 'Tablet' END AS device_type", """
        CASE k DIV 20 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Travel' WHEN 2 THEN 'Retail' WHEN 3 THEN 'Grocery'
             ELSE 'Jewelry' END AS merchant_category""",
               "CAST(event_id % 20 = 0 AS INT) AS ip_address_flag", """
        CASE k % 4 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Mastercard' WHEN 2 THEN 'Amex' ELSE 'Discover' END AS card_type""",
               "CAST((user_id * 37) % 1500 AS INT) AS card_age", "k * 25D AS transaction_distance", """
        CASE event_id % 4 WHEN 0 THEN 'Password' WHEN 1 THEN 'PIN' WHEN 2 THEN 'Biometric' ELSE 'None' END
             AS authentication_method""",
               "CAST(event_id % 100 AS DOUBLE) AS risk_score", "CAST(event_type = 'error' AS INT) AS is_failed",
               "CAST(event_type = 'error' OR value * 25 > 2500 AS INT) AS fraud_label",
               "CAST(weekday(ts) >= 5 AS INT) AS is_weekend", "k"]
    if nation is not None:  # a fixed 25 rows
        places = F.broadcast(nation.selectExpr("n_nationkey AS __place", "n_name AS location"))
        e = e.withColumn("__place", F.expr("k % 25")).join(places, "__place", "left")
        columns.append("location")
    if customer is not None:
        e = e.join(customer.selectExpr("c_custkey AS user_id", "c_acctbal AS account_balance"), "user_id", "left")
        columns.append("account_balance")
    return e.selectExpr(*columns)


def with_photo_path(txn: DataFrame) -> DataFrame:
    """Transactions authenticated by biometrics come with a photo."""
    path = F.concat(F.lit("photos/"), F.col("transaction_id").cast("string"), F.lit(".jpg"))
    return txn.withColumn("photo_path", F.when(F.col("authentication_method") == "Biometric", path))


def biometric_json(txn: DataFrame) -> DataFrame:
    """(transaction_id, response) for every transaction: some keys are missing, some checks fail."""
    return txn.selectExpr("transaction_id", "k", """concat(
        '{"verification_result":"', IF(k % 5 = 0, 'FAILED', 'VERIFIED'),
        '","face_comparison":{"match":', k >= 20, ',"similarity":', k, ',"confidence":90}',
        ',"quality_check":{"is_real":', k % 7 != 0, ',"confidence":80',
        IF(k % 2 = 0, concat(',"quality_score":', k), ''),
        IF(k % 6 = 0, ',"emotions":[{"type":"CALM","confidence":61.5},{"type":"SAD","confidence":3}]', ''),
        IF(k % 10 = 0, ',"pose":{"roll":1.5,"yaw":-2.25,"pitch":0}', ''),
        '},"liveness_check":{"is_live":', k % 11 != 0, ',"confidence":70,"checks":{',
        CASE k % 4 WHEN 0 THEN '"eyes_open":true,"no_sunglasses":false' WHEN 1 THEN '"eyes_open":false'
                   ELSE '"eyes_open":true' END, '}}}') AS response""")


def monitor_replies(txn: DataFrame) -> DataFrame:
    """(transaction_id, reply): valid, invalid and trailing-text replies, and one that is no object."""
    return txn.selectExpr("transaction_id", "k", """
        CASE k % 10 WHEN 0 THEN 'not json' WHEN 1 THEN '{"verdict":"REJECTED"} extra text'
                    WHEN 2 THEN '{"risk_factors":[]}' WHEN 3 THEN '["APPROVED"]'
                    ELSE concat('{"verdict":"', IF(k > 70, 'REJECTED', 'APPROVED'), '"}') END AS reply""")


def assessment_replies(txn: DataFrame) -> DataFrame:
    return txn.selectExpr("transaction_id", "k", """
        CASE k % 10 WHEN 0 THEN concat('Sorry, no decision for ', k) WHEN 1 THEN '12'
        ELSE concat('{"final_verdict":"', CASE WHEN k > 70 THEN 'REJECTED' WHEN k > 40 THEN 'REVIEW' ELSE 'APPROVED' END,
                    '","confidence_score":', k, ',"risk_level":"',
                    CASE WHEN k > 70 THEN 'HIGH' WHEN k > 40 THEN 'MEDIUM' ELSE 'LOW' END,
                    '","key_findings":["a","b"],"recommended_action":"act ', k, '"}') END AS reply""")
