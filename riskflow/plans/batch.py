"""The batch jobs: profiles, enhanced table, training, scoring, escalation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions import scores
from riskflow.operators import assess, biometrics, cases, features, metrics, patterns, profiles, scenarios, training
from riskflow.sources import case_store, tables


def prepare(txn: DataFrame, out: str, mode="training"):
    """Raw transactions in; profiles (JSON), the enhanced table (Parquet and CSV) and scenarios (JSON) out."""
    tables.write_json(profiles.training_profile(txn), f"{out}/user_profiles")
    enhanced = features.enhance(txn, mode)
    enhanced.write.mode("overwrite").parquet(f"{out}/transactions_enhanced")
    stored = txn.sparkSession.read.schema(enhanced.schema).parquet(f"{out}/transactions_enhanced")
    tables.write_csv(tables.raw_names(stored), f"{out}/transactions_enhanced_csv")
    tables.write_json(scenarios.scenario_samples(stored), f"{out}/demo_scenarios")
    return stored


def train(enhanced: DataFrame, out: str, trees=C.TREES, label="fraud_label"):
    """Enhanced transactions (a stored table: it is read twice) in; the saved model and result tables out."""
    spark = enhanced.sparkSession
    split_path = f"{out}/split"  # written once: fitting and evaluating read it many times
    training.stratified_split(enhanced, label).write.mode("overwrite").partitionBy("split").parquet(split_path)
    rows = spark.read.parquet(split_path)
    train_rows = rows.where(F.col("split") == "train")
    balance = metrics.class_balance(train_rows, label).first()
    model = training.fit(train_rows, label, trees=trees, fraud_ratio=balance["fraud_ratio"], encoders_from=rows)
    scored = training.score(rows.where(F.col("split") != "train"), model, keep=["transaction_id", label, "split"])
    scored_path = f"{out}/scored"  # written once: every measure reads it several times, and the trees are walked once per row
    scored.write.mode("overwrite").partitionBy("split").parquet(scored_path)
    stored = spark.read.schema(scored.schema).parquet(scored_path)
    tested, validated = (stored.where(F.col("split") == part).drop("split") for part in ("test", "validation"))
    auc = metrics.auc(tested, "fraud_probability", label)
    importance = training.feature_importance(model, spark)
    metadata = training.model_metadata(spark, auc.first()["auc"] or 0.0, balance["fraud_ratio"] or 0.0,
                                       balance["negatives"] + balance["positives"])
    tables.save_model(model, metadata, importance, out)
    return {"model": model, "auc": auc, "validation_auc": metrics.auc(validated, "fraud_probability", label),
            "confusion": metrics.confusion_matrix(tested, "fraud_probability", label),
            "report": metrics.classification_report(tested, "fraud_probability", label),
            "importance": importance, "metadata": metadata, "tested": tested}


def score(requests: DataFrame, model, history: DataFrame = None) -> DataFrame:
    """Requests with fraud_probability.

    Without `history` every request gets the default features; with it, the features come from the user's
    earlier rows, by the definitions the model is trained on in mode "consistent".
    """
    if history is None:
        ready = features.assemble_defaults(requests)
    else:
        shared = [c for c in requests.columns if c in history.columns]
        flags = [c for c in ("is_failed", "fraud_label") if c in history.columns and c not in requests.columns]
        past = tables.history_of(history, requests).select(*shared, *flags).withColumn("__asked", F.lit(False))
        both = past.unionByName(requests.withColumn("__asked", F.lit(True)), allowMissingColumns=True)
        full = features.enhance(features.with_history_features(both, first_seen=True), "consistent")
        ready = with_defaults(full.where("__asked").drop("__asked"))
    return training.score(ready, model)


def with_defaults(enhanced: DataFrame) -> DataFrame:
    """Defaults of the model inputs that neither the request nor its history has."""
    given = {c.lower() for c in enhanced.columns}
    absent = {"account_balance": C.DEFAULT_ACCOUNT_BALANCE, "card_age": C.DEFAULT_CARD_AGE,
              "ip_address_flag": 0, "transaction_distance": 0.0}
    return enhanced.withColumns({c: F.lit(v) for c, v in absent.items() if c not in given})


def snapshot(history: DataFrame, as_of, out: str):
    """Writes what is known about the users at one moment; assess_batch then need not read the history.

    Returns (user snapshot, known values), both clustered by user.
    """
    def write(df, name):
        df.repartitionByRange("user_id").sortWithinPartitions("user_id").write.mode("overwrite").parquet(f"{out}/{name}")
        return history.sparkSession.read.schema(df.schema).parquet(f"{out}/{name}")

    known = write(profiles.known_values(history), "known_values")
    return write(patterns.user_snapshot(history, as_of, known=known), "user_snapshot"), known


def assess_batch(current: DataFrame, scored: DataFrame, history: DataFrame, responses: DataFrame,
                 monitor_replies: DataFrame, assessment: DataFrame, as_of, known_at=None, photo_replies=None) -> DataFrame:
    """The complete result per transaction: scored = output of `score`; responses = photo-check JSON texts;
    assessment = output of replies.parse_assessment; known_at = output of `snapshot`, in place of the history;
    photo_replies = what the model said about the photo checks. A branch that fails leaves its error."""
    users, known = known_at or (None, None)
    evidence = assess.evidence_branch(current, lambda rows: patterns.detect_snapshot(
        rows, history, as_of, snapshot=users, known=known))
    monitor = assess.monitor_result(scored.join(monitor_replies, "transaction_id", "left"))
    return assess.combine(current, monitor, evidence, biometrics.photo_result(responses, photo_replies), assessment)


def escalate(judged: DataFrame, evidence: DataFrame, assessment: DataFrame, root: str, write_id: int):
    """Cases, alerts and evidence documents of one run, committed together. Needs risk_score, status and fraud_report."""
    case_store.write_cases(judged, write_id, root, documents=lambda opened: cases.evidence_documents(opened, evidence, assessment))
    return case_store.read_cases(judged.sparkSession, root).where(F.col("write_id") == write_id)


def judged_by_model(scored: DataFrame, status: DataFrame) -> DataFrame:
    """risk_score and status for escalation: the model score, and the verdict of the final assessment."""
    return scored.join(status.select("transaction_id", "status"), "transaction_id", "left").withColumns({
        "risk_score": scores.score_percent("fraud_probability"),
        "status": F.coalesce("status", F.lit(C.REPLY_VERDICT))})
