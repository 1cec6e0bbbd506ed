"""Input rows for offline model inference: (transaction_id, agent, prompt, max_tokens, temperature).

The replies come back as a table and are read by `replies`. The wording is ours; the facts shown and the
reply keys asked for are those the reply schemas expect.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions.text import bullets, money, plain
from riskflow.operators import patterns

_VERDICTS = "APPROVED, REJECTED or REVIEW"


def _text(c, default="Unknown") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(default))


def _usd(c) -> Column:
    return F.concat(F.lit("$"), money(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))))


def _yes(c, yes="YES", no="NO") -> Column:
    return F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), yes).otherwise(no)


def _sheet(title: str, facts: list) -> Column:
    """A titled list of facts, one per line."""
    return F.concat_ws("\n", F.lit(title), *[F.concat(F.lit(f"- {name}: "), value) for name, value in facts])


def _ask(keys: dict) -> Column:
    wanted = "\n".join(f'- "{k}": {v}' for k, v in keys.items())
    return F.lit("Answer with a single JSON object and nothing else. Its keys:\n" + wanted)


def _transaction() -> Column:
    return _sheet("Transaction", [
        ("id", _text("transaction_id")), ("user", _text("user_id")), ("amount", _usd("transaction_amount")),
        ("type", _text("transaction_type")), ("merchant category", _text("merchant_category")),
        ("location", _text("location")), ("device", _text("device_type")), ("card", _text("card_type")),
        ("authentication", _text("authentication_method"))])


def _model() -> Column:
    p = "monitor.prediction"
    return _sheet("Model", [
        ("fraud probability", _text(f"{p}.fraud_probability", "0")), ("score of 100", _text(f"{p}.fraud_score", "0")),
        ("risk level", _text(f"{p}.risk_level", "UNKNOWN")), ("confidence", _text(f"{p}.model_confidence", "0")),
        ("unusual hour", _yes("monitor.feature_summary.time_based_risk")),
        ("high value", _yes("monitor.feature_summary.is_high_value"))])


def monitor() -> Column:
    """Needs the request columns and `monitor` (prediction and feature_summary)."""
    return F.concat_ws(
        "\n\n", F.lit("Review one card transaction for fraud, using the transaction and the score of a model."),
        _transaction(), _sheet("Time", [("hour", _text("monitor.feature_summary.hour"))]), _model(),
        _ask({"verdict": _VERDICTS, "risk_factors": "list of two or three indicators",
              "recommended_action": "what to do next", "reasoning": "two or three sentences"}))


def _profile(length=None) -> Column:
    def listed(c):
        items = F.slice(c, 1, length) if length else F.col(c)
        return F.when(F.size(c) > 0, F.array_join(items, ", ")).otherwise("Unknown")
    return _sheet("User history", [
        ("transactions", _text("total_transactions", "0")),
        ("average amount", _usd("avg_transaction_amount")),
        ("range", F.concat_ws(" - ", _usd("min_transaction"), _usd("max_transaction"))),
        ("devices", listed("known_devices")), ("locations", listed("known_locations")),
        ("earlier fraud flags", _text("fraud_history", "0"))])


def _activity() -> Column:
    return _sheet("Activity", [("last 24 hours", _text("recent_24h_count", "0")),
                               (f"newest transactions read, at most {C.HISTORY_LIMIT}", _text("history_count", "0"))])


def evidence() -> Column:
    """Needs the output columns of patterns.detect_snapshot."""
    return F.concat_ws(
        "\n\n", F.lit("Summarise in two or three sentences how this transaction compares with the user's habits."),
        _transaction(), _profile(), _activity(),
        F.concat(F.lit("Observations\n"), bullets(patterns.messages(), "", "Standard transaction pattern")))


def photo() -> Column:
    """Needs the request columns, photo_path and the flat photo-check columns."""
    def percent(c, digits=2):
        return F.concat(plain(F.coalesce(F.col(c), F.lit(0.0)), digits), F.lit("%"))

    def angle(name):
        return plain(F.coalesce(F.col("pose")[name], F.lit(0.0)), 1)

    checks = _sheet("Photo check", [
        ("photo", _text("photo_path", "N/A")), ("result", _text("verification_result")),
        ("authentic", _yes("is_authentic")), ("overall confidence", percent("overall_confidence")),
        ("face match", _yes("face_matched")), ("similarity", percent("face_similarity")),
        ("match confidence", percent("face_confidence")),
        ("real person", _yes("is_real", no="NO, a generated face is suspected")),
        ("detection confidence", percent("real_confidence")), ("quality of 100", plain("quality_score")),
        ("live person", _yes("is_live", no="NO, a picture or video is suspected")),
        ("liveness of 100", plain("liveness_score")), ("liveness confidence", percent("liveness_confidence")),
        ("brightness", plain("brightness")), ("sharpness", plain("sharpness")),
        ("emotion", F.concat(F.col("top_emotion"), F.lit(" "), percent("emotion_confidence", 1))),
        ("head roll, yaw, pitch", F.concat_ws(", ", angle("roll"), angle("yaw"), angle("pitch")))])
    return F.concat_ws(
        "\n\n", F.lit("Judge whether the person in the verification photo is the account holder."),
        _transaction(), checks, F.concat(F.lit("Risk factors\n"), bullets(F.col("photo_risk_factors"), "- ", "- None")),
        _ask({"verdict": _VERDICTS, "risk_assessment": "list of two to four findings",
              "recommended_action": "what to do with the verification", "reasoning": "two or three sentences"}))


def assessment() -> Column:
    """Needs everything: request, monitor, evidence and (or null) photo columns. A failed photo check counts
    as none."""
    checked = F.col("verification_result").isNotNull() & F.col("photo_error").isNull()
    photo_part = F.when(checked, _sheet("Photo check", [
        ("verdict", _text("photo_verdict", "NOT_CHECKED")), ("authentic", _yes("is_authentic")),
        ("similarity", plain(F.coalesce("face_similarity", F.lit(0.0)), 1)),
        ("real person", _yes("is_real")), ("live person", _yes("is_live")),
        ("confidence", plain(F.coalesce("overall_confidence", F.lit(0.0)), 1)),
        ("risk factors", F.when(F.size("photo_risk_factors") > 0, F.array_join("photo_risk_factors", ", "))
         .otherwise("None"))])).otherwise(F.lit("Photo check\n- not provided"))
    found = F.concat(F.lit("Patterns found: "), F.size("patterns").cast("string"), F.lit("\n"),
                     bullets(patterns.messages(), "- ", "- None detected"))
    return F.concat_ws(
        "\n\n", F.lit("Combine the findings below into one fraud decision. Name conflicts between them. "
                      "A failed photo check weighs heavily."),
        _transaction(),
        F.concat(F.lit("Monitor verdict: "), _text("monitor_verdict", "UNKNOWN")), _model(),
        _profile(C.PROMPT_LIST_LENGTH), _activity(), found,
        F.concat(F.lit("Summary of behaviour: "), _text("llm_summary", "Not available")), photo_part,
        _ask({"final_verdict": _VERDICTS, "confidence_score": "0 to 100",
              "risk_level": "LOW, MEDIUM, HIGH or CRITICAL", "risk_summary": "two or three sentences",
              "key_findings": "list", "risk_factors": "list", "positive_indicators": "list",
              "decision_reasoning": "three or four sentences", "recommended_action": "one instruction",
              "agent_consensus": "whether the findings agree",
              "confidence_breakdown": "object with ml_model_confidence, behavioral_analysis_confidence, "
                                      "biometric_confidence, overall_confidence, each 0 to 1"}))


def case_report() -> Column:
    """Needs the case columns, `patterns`, `llm_summary` and `llm_reasoning`."""
    return F.concat_ws(
        "\n\n", F.lit("Write a formal fraud case report for investigators: a short summary, the main risk "
                      "indicators, and the recommended actions."),
        _sheet("Case", [("id", _text("case_id")), ("risk score of 100", _text("risk_score")),
                        ("status", _text("status"))]),
        _transaction(), F.concat(F.lit("Assessment: "), _text("llm_reasoning", "N/A")),
        F.concat(F.lit("Evidence: "), _text("llm_summary", "N/A")),
        F.concat(F.lit("Patterns\n"), bullets(patterns.messages(), "- ", "- None")))


_TEMPLATES = {"monitor": monitor, "evidence": evidence, "photo": photo, "assessment": assessment,
              "case_report": case_report}


def requests(df: DataFrame, agents) -> DataFrame:
    """One row per transaction and agent. `agents` maps an agent to the condition under which it is asked
    (None = always); all prompts are written in one pass over the rows."""
    rows = []
    for agent, condition in agents.items():
        tokens, temperature = C.REQUEST_PARAMETERS[agent]
        row = F.struct(F.lit(agent).alias("agent"), _TEMPLATES[agent]().alias("prompt"),
                       F.lit(tokens).cast("int").alias("max_tokens"),
                       F.lit(temperature).cast("double").alias("temperature"))
        rows.append(row if condition is None else F.when(condition, row))
    return df.select("transaction_id", F.inline(F.array_compact(F.array(*rows))))
