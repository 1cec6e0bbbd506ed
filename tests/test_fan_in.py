"""Fan-in of a stream: the branches read stored rows, so the joins of a micro-batch run once."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskflow.operators import features
from riskflow.plans import batch
from riskflow.streaming import fan_in, jobs

START, END = datetime(2024, 1, 10), datetime(2030, 1, 1)
TXN = ("transaction_id long, user_id string, ts timestamp, transaction_amount double, transaction_type string, account_balance double, device_type string, "
       "location string, merchant_category string, authentication_method string, photo_path string, fraud_label int, is_failed int")


def txn(i, at):
    return i, f"u{i % 3}", at, 10.0 * i, "Online", 5.0, "Mobile", "Lima", "Travel", "PIN", None, 0, 0


def test_rows_that_waited_are_joined_once(spark, tmp_path):
    jobs.use_keyed_state(spark)
    rows = [txn(i, START + timedelta(minutes=i)) for i in range(20)]
    spark.createDataFrame([*rows, txn(-1, END)], TXN).write.parquet(str(tmp_path / "asked"))
    answers = {}
    for name in fan_in.ANSWERS:  # every second answer is missing
        said = [(i, r[2], "no reply") for i, r in enumerate(rows) if i % 2] + [(-1, END, None)]
        spark.createDataFrame(said, "transaction_id long, answered_at timestamp, text string").write.parquet(str(tmp_path / name))
        answers[name] = spark.readStream.schema("transaction_id long, answered_at timestamp, text string").parquet(str(tmp_path / name))
    past = spark.createDataFrame([txn(100 + i, START - timedelta(days=1, minutes=i)) for i in range(9)], TXN)
    users, known = batch.snapshot(past, str(START), str(tmp_path / "snapshot"))
    plans = []

    def write(found, i, to):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        jobs.replace_folder(found, i, to)

    gathered = fan_in.gather(spark.readStream.schema(TXN).parquet(str(tmp_path / "asked")), answers)
    report = fan_in.writer(lambda found: features.with_time_features(found).withColumns({"fraud_probability": F.lit(0.5), "is_high_value": F.lit(0)}),
                          str(START), users, known, write)
    path = jobs.run_to_end(gathered, lambda found, i, to: report(found.where("transaction_id >= 0"), i, to))
    got = sorted(r.transaction_id for r in spark.read.parquet(path).collect())
    assert got == list(range(20))
    assert plans and not any("ExistingRDD" in p for p in plans)
