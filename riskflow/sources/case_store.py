"""Case, evidence and alert tables of which a reader sees whole writes only.

Every attempt at a write stages its cases, alerts and evidence documents in folders of its own, by day, and then commits with one row
in a log: (seq, write_id, attempt). Readers take what the newest entry of each write names, so a write that breaks off between its tables
shows nothing, and a repeated one replaces its earlier attempt in one step. An entry is written at the next free place of the log as it
was when the attempt began, and is never replaced: of two writers that number the cases of a day at once, the second fails and is repeated.
No write reads more than the days it touches.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators import cases
from riskflow.session import shared_dir
from riskflow.sources import tables


LOG = "seq INT, write_id INT, attempt STRING"


def _none_at(e: AnalysisException) -> bool:
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _existing(spark: SparkSession, path: str, days: list):
    """The part of a table that is in the folders of some days, if there is any: one scan."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/case_date={{{','.join(map(str, days))}}}")
    except AnalysisException as e:
        if _none_at(e):
            return None
        raise


def log(spark: SparkSession, root: str) -> DataFrame:
    """The commits: a row per attempt that was finished."""
    try:
        return spark.read.schema(LOG).json(f"{root}/log/*")
    except AnalysisException as e:
        if _none_at(e):
            return spark.createDataFrame([], LOG)
        raise


def committed(rows: DataFrame, root: str) -> DataFrame:
    """Those rows of a table (write_id, attempt) that belong to the newest commit of their write."""
    newest = log(rows.sparkSession, root).groupBy("write_id").agg(F.max_by("attempt", "seq").alias("attempt"))
    return rows.join(newest, ["write_id", "attempt"], "left_semi")


def _commit(spark: SparkSession, root: str, seq: int, write_id: int, attempt: str):
    spark.createDataFrame([(seq, write_id, attempt)], LOG).coalesce(1).write.mode("error").json(f"{root}/log/{seq}")


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    return committed(spark.read.parquet(f"{root}/cases"), root).drop("attempt")


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    return committed(spark.read.parquet(f"{root}/alerts"), root).drop("attempt")


def evidence_folder(root: str, write_id: int, attempt: str) -> str:
    return f"{root}/evidence/write_id={write_id}/attempt={attempt}"


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """case_id and document of every case in a folder: one that a case record names, or any above it. `path` is the file."""
    return (spark.read.schema("case_id STRING, document STRING").json(path).select(
        "case_id", "document", F.col("_metadata.file_path").alias("path")))


def _write_evidence(documents: DataFrame, folder: str):
    """JSON lines in the folders that the case records name (cases.evidence_path)."""
    (documents.select("case_date", cases.evidence_bucket().alias("bucket"), "case_id", "document")
     .hint("rebalance", "case_date", "bucket").write.mode("overwrite").partitionBy("case_date", "bucket").json(folder))


def _stage(rows: DataFrame, path: str, write_id: int, attempt: str):
    (rows.withColumns({"write_id": F.lit(write_id), "attempt": F.lit(attempt)}).hint("rebalance", "case_date").write.mode("append")
     .partitionBy("case_date", "write_id", "attempt").parquet(path))


def write_cases(judged: DataFrame, write_id: int, root: str, min_score=None, documents=None):
    """Writes the cases and alerts of one batch of judged transactions (risk_score, status, fraud_report), and the evidence
    documents that `documents` (cases next to the columns of `judged` -> case_date, case_id, document) makes of them.

    Safe to repeat, any write at any time: a transaction that has a case keeps its number, and new ones are numbered
    after the last of their day. Copies of a transaction in the batch are reduced to the earliest row; a transaction that has
    a case from another write does not get a second one.
    """
    spark = judged.sparkSession
    attempt = uuid.uuid4().hex
    last = log(spark, root).agg(F.max("seq")).first()[0]
    risky = cases.high_risk(judged) if min_score is None else cases.high_risk(judged, min_score)
    risky = tables.drop_repeated(risky).withColumn("case_date", F.to_date("ts"))
    shared_dir(spark)
    risky = risky.checkpoint()  # the scoring behind it runs once, and a lost executor does not repeat it
    days = [r[0] for r in risky.select("case_date").distinct().collect()]  # a row per day
    before = _existing(spark, f"{root}/cases", days) if days and last is not None else None
    taken = kept = None
    fresh = risky.drop("case_date")
    if before is not None:
        before = committed(before, root).select("transaction_id", "case_id", "case_number", "case_date", "write_id")
        taken = before.groupBy("case_date").agg(F.max("case_number").alias("last_number"))
        own = before.where(F.col("write_id") == write_id).select("transaction_id", "case_id", "case_number")
        kept = risky.join(own, "transaction_id")
        fresh = fresh.join(before.select("transaction_id"), "transaction_id", "left_anti")
    numbered = cases.with_case_ids(fresh, taken)
    if kept is not None:
        numbered = numbered.unionByName(kept.select(*numbered.columns))
    folder = evidence_folder(root, write_id, attempt)
    records = cases.case_records(numbered, root=folder)
    _stage(records, f"{root}/cases", write_id, attempt)
    if days:
        staged = _existing(spark, f"{root}/cases", days)  # None where every row has a case already
        staged = records.limit(0) if staged is None else staged.where((F.col("write_id") == write_id) & (F.col("attempt") == attempt)).select(*records.columns)
        _stage(cases.alerts(staged), f"{root}/alerts", write_id, attempt)
        if documents is not None:
            opened = risky.drop("case_date").join(staged.select("transaction_id", "case_id", "case_date"), "transaction_id")
            _write_evidence(documents(opened), folder)
    else:
        _stage(cases.alerts(records), f"{root}/alerts", write_id, attempt)
    _commit(spark, root, 0 if last is None else last + 1, write_id, attempt)
