"""Scoring and escalation of a stream of requests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions import scores
from riskflow.operators import features, profiles, training
from riskflow.plans.batch import with_defaults
from riskflow.sources import case_store, model_store
from riskflow.streaming import history_state
from riskflow.streaming.jobs import replace_folder


def score_rows(requests: DataFrame, model=None) -> DataFrame:
    """Probability, score and band. Without a model the heuristic score takes its place."""
    ready = features.assemble_defaults(requests)
    scored = (training.score(ready, model) if model is not None
              else ready.withColumn("fraud_probability", F.round(scores.heuristic_risk(), 4)))
    return scored.withColumns({"fraud_score": scores.score_percent("fraud_probability"),
                               "risk_level": scores.risk_band(scores.score_percent("fraud_probability"))})


def score_stream(requests: DataFrame, profile: DataFrame, model=None) -> DataFrame:
    """Stream of requests (with `ts`) -> scores next to the profile numbers; a plain stream-static join.

    Right for profiles small enough to broadcast: each micro-batch reads the profile again. For large ones use
    `score_writer`.
    """
    return score_rows(profiles.enrich(requests, profile), model)


def score_writer(profile: DataFrame, model=None, columns=None, write=replace_folder):
    """foreachBatch writer that scores a micro-batch against a large profile table.

    The profile is first cut to the users of the batch, where it is read if they are few.
    """
    def write_scores(batch: DataFrame, batch_id: int, path: str):
        batch.persist()
        try:
            near = profile.join(batch.select("user_id").distinct(), "user_id", "left_semi")
            scored = score_rows(profiles.enrich(batch, near), model)
            write(scored.select(*columns) if columns else scored, batch_id, path)
        finally:
            batch.unpersist()
    return write_scores


def model_stream(requests: DataFrame, model, history: DataFrame = None, late=history_state.LATE) -> DataFrame:
    """Stream of requests scored by a trained model with what is known about their users: the rows of `history`, read once
    when the stream starts for the first time, and the requests before, kept as keyed state.

    Every request is scored against the rows before its own time that have arrived. Nothing is read twice.
    """
    begin = history_state.seed(history, late) if history is not None else None
    known = history_state.follow_history(requests, begin, late)
    scored = training.score(with_defaults(features.enhance(known, "consistent")), model)
    return scored.withColumns({"fraud_score": scores.score_percent("fraud_probability"),
                               "risk_level": scores.risk_band(scores.score_percent("fraud_probability"))})


def current_model_writer(root: str, columns=None, write=replace_folder):
    """foreachBatch writer that scores requests with history features (`history_state.follow_history`) by the model that is
    current in the store `root` when the micro-batch begins; every row names its version."""
    def write_scores(batch: DataFrame, batch_id: int, path: str):
        version, model = model_store.load(batch.sparkSession, root)
        scored = training.score(with_defaults(features.enhance(batch, "consistent")), model).withColumn("model_version", F.lit(version))
        write(scored.select(*columns) if columns else scored, batch_id, path)
    return write_scores


def write_cases(batch: DataFrame, batch_id: int, path: str):
    """foreachBatch writer for judged rows (risk_score, status, fraud_report): cases and alerts."""
    case_store.write_cases(batch, batch_id, path)
