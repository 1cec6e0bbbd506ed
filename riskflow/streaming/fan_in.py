"""Fan-in of a stream: requests and the answers of their branches arrive apart and are put together per transaction.

`gather` waits for every answer up to a time limit: a chain of stream-stream left outer joins on the id and the time, so the state holds a
request for `limit` (and `late`) of event time and an answer no longer. A request leaves when its answers are there; for an answer
that does not come in time it leaves with a null in its place, once the watermark has passed the limit, and the branch is reported as failed. No
request is lost. A source that falls silent holds the watermark back, and with it the requests that still wait. An answer that is delivered twice gives two rows; `windows.first_copies` takes copies out before.

`writer` turns what was gathered into the assessment of each transaction, with the same operators as a batch.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators import assess, biometrics, patterns, replies
from riskflow.streaming.jobs import replace_folder

LIMIT, LATE = "1 hour", "10 minutes"
ANSWERS = ("monitor", "photo", "assessment")


def gather(requests: DataFrame, answers: dict, limit=LIMIT, late=LATE) -> DataFrame:
    """`requests` (transaction_id, ts, ...) with a column for each of `answers`: name -> stream of (transaction_id, answered_at, text).

    An answer counts if its time is at most `late` before that of its request and `limit` after it.
    """
    out = requests.withWatermark("ts", late)
    for name, stream in answers.items():
        own = stream.select(F.col("transaction_id").alias(f"{name}_of"), F.col("answered_at").alias(f"{name}_at"), F.col("text").alias(name))
        own = own.withWatermark(f"{name}_at", late)
        near = F.expr(f"{name}_of = transaction_id AND {name}_at >= ts - INTERVAL {late} AND {name}_at <= ts + INTERVAL {limit}")
        out = out.join(own, near, "leftOuter").drop(f"{name}_of", f"{name}_at")
    return out


def assessed(gathered: DataFrame, score, as_of, users: DataFrame, known: DataFrame) -> DataFrame:
    """The combined result of each gathered row (columns of `ANSWERS`, photo_path). score(rows) adds fraud_probability and the
    columns of the feature summary; `users` and `known` are the output of `batch.snapshot`."""
    rows = gathered.drop(*ANSWERS)
    evidence = assess.evidence_branch(rows, lambda found: patterns.detect_snapshot(found, None, as_of, snapshot=users, known=known))
    monitor = assess.monitor_result(score(gathered.drop("photo", "assessment")), "monitor")
    asked = gathered.where(F.col("photo").isNotNull() | F.col("photo_path").isNotNull())
    photo = biometrics.flatten(asked.select("transaction_id", F.col("photo").alias("response"))).drop("response")
    said = replies.parse_assessment(gathered.select("transaction_id", F.col("assessment").alias("reply")))
    return assess.combine(rows, monitor, evidence, photo, said)


def report(combined: DataFrame) -> DataFrame:
    """Flat result and the errors of the branches."""
    flat = assess.summary(combined)
    errors = combined.select("transaction_id", "monitor_error", "evidence_error", F.col("biometric.error").alias("photo_error"),
                             F.col("assessment.error").alias("assessment_error"))
    return flat.join(errors, "transaction_id")


def writer(score, as_of, users: DataFrame, known: DataFrame, write=replace_folder):
    """foreachBatch writer of `report` for gathered rows.

    The branches read the rows of a micro-batch a dozen times, and where a micro-batch only ends waiting the engine does not find what
    was persisted and runs the joins and their state again for each. So they are written once, to a folder that the next micro-batch
    replaces and that readers of `path` do not see, and read back.
    """
    def write_report(batch: DataFrame, batch_id: int, path: str):
        stored = f"{path}/_gathered"
        batch.write.mode("overwrite").parquet(stored)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(stored)
        if batch_id and rows.isEmpty():  # nothing left the joins
            return
        write(report(assessed(rows, score, as_of, users, known)), batch_id, path)
    return write_report
