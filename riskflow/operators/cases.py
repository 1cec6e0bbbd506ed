"""Escalation: case records, evidence documents and alerts of high-risk transactions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions.text import money, template
from riskflow.operators.ranks import numbered


def high_risk(scored: DataFrame, min_score=C.MEDIUM_BELOW) -> DataFrame:
    """Score in the HIGH band, or a REJECTED verdict. Needs risk_score (0..100) and status."""
    return scored.where((F.col("risk_score") >= min_score) | (F.col("status") == "REJECTED"))


def with_case_ids(risky: DataFrame, taken: DataFrame = None) -> DataFrame:
    """Case ids PREFIX-YYYYMMDD-number, unique per day, in (ts, transaction_id) order.

    Cases are numbered per day and minute of the day, then shifted by the cases of the earlier minutes. The rows
    are read twice for this, so checkpoint them first when they are expensive.
    `taken` (case_date, last_number), a row per day, continues the numbering of days that have cases already.
    """
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    dated = risky.withColumn("case_date", F.to_date("ts"))
    ranked = numbered(dated, "case_date", minute, ["ts", "transaction_id"], "__n")
    start = F.lit(C.CASE_NUMBER_START - 1)
    if taken is not None:
        ranked = ranked.join(taken, "case_date", "left")
        start = F.coalesce("last_number", start)
    out = ranked.withColumn("case_number", (F.col("__n") + start).cast("long"))
    case_id = F.concat_ws("-", F.lit(C.CASE_ID_PREFIX), F.date_format("case_date", "yyyyMMdd"),
                          F.col("case_number").cast("string"))
    return out.withColumn("case_id", case_id).drop("__n", "__n_of", "last_number")


def evidence_bucket(case_id="case_id"):
    """The cases of a day are spread over a few folders by their number: a folder per case would be millions of tiny files."""
    return F.pmod(F.element_at(F.split(case_id, "-"), -1).cast("long"), F.lit(C.EVIDENCE_BUCKETS)).cast("int")


def evidence_path(root="evidence"):
    """Folder that holds a case's evidence document: <root>/case_date=<day>/bucket=<number of the case, modulo>."""
    return F.concat(F.lit(root + "/case_date="), F.date_format("case_date", "yyyy-MM-dd"), F.lit("/bucket="),
                    evidence_bucket().cast("string"))


def case_records(cases: DataFrame, report="fraud_report", root="evidence") -> DataFrame:
    """Nine fields per case, plus the date the table is partitioned by and the number within it."""
    return cases.select(
        "case_id", "transaction_id", "user_id", "risk_score", "status",
        F.coalesce("transaction_amount", F.lit(0.0)).alias("amount"), F.col(report).alias("fraud_report"),
        evidence_path(root).alias("evidence_path"), F.col("ts").cast("timestamp").alias("created_at"),
        "case_date", "case_number")


def evidence_documents(cases: DataFrame, evidence: DataFrame, assessment: DataFrame,
                       report="fraud_report") -> DataFrame:
    """One JSON document per case: the transaction, its assessment, its evidence and the report."""
    txn_fields = [c for c in ("transaction_id", "user_id", "transaction_amount", "transaction_type",
                              "merchant_category", "card_type", "device_type", "location",
                              "authentication_method") if c in cases.columns]
    said = F.struct(*[c for c in assessment.columns if c != "transaction_id"])
    joined = (cases.join(evidence.select("transaction_id", "evidence"), "transaction_id", "left")
              .join(assessment.select("transaction_id", said.alias("risk_assessment")), "transaction_id", "left"))
    document = F.to_json(F.struct(
        "case_id", "transaction_id", F.col("ts").alias("timestamp"),
        F.struct(*txn_fields).alias("transaction_data"), "risk_assessment", "evidence",
        F.col(report).alias("fraud_report")))
    return joined.select("case_date", "case_id", document.alias("document"))


def alerts(records: DataFrame, excerpt=C.REPORT_EXCERPT) -> DataFrame:
    """(case_id, subject, message): the message names the case and quotes the start of the report."""
    nothing = F.lit("")
    message = template(C.ALERT_MESSAGE_FORMAT, F.col("case_id"), F.coalesce(F.col("transaction_id").cast("string"), nothing),
                       money("amount"), F.coalesce(F.col("risk_score").cast("int").cast("string"), nothing),
                       F.coalesce("status", nothing), F.col("evidence_path"),
                       F.coalesce(F.substring("fraud_report", 1, excerpt), nothing))
    return records.select("case_id", "case_date", template(C.ALERT_SUBJECT_FORMAT, F.col("case_id"))
                          .alias("subject"), message.alias("message"))
