"""The batch jobs one after another on the smallest tables."""

import json

from pyspark.sql import functions as F

from riskflow.functions import scores
from riskflow.operators import biometrics, features, patterns, prompts, replies
from riskflow.plans import batch
from riskflow.sources import case_store, fixtures, tables

FOLDER = "/root/testdata/sf0.001"
AS_OF = fixtures.AS_OF


def test_prepare_train_score_assess_escalate(spark, tmp_path):
    out = str(tmp_path / "out")
    txn = features.with_history_features(fixtures.transactions(spark, FOLDER, balance=True))
    n = txn.count()
    for mode in ("training", "serving"):
        stored = batch.prepare(txn.drop("k"), f"{out}/{mode}", mode)
        assert stored.count() == n
    header = spark.read.option("header", True).csv(f"{out}/training/transactions_enhanced_csv").columns
    assert {"Transaction_ID", "Timestamp", "Is_Weekend", "hour_of_day", "is_new_device"} <= set(header)
    assert spark.read.json(f"{out}/training/user_profiles").count() == txn.select("user_id").distinct().count()
    assert spark.read.json(f"{out}/training/demo_scenarios").count() >= 3

    stored = batch.prepare(txn, f"{out}/consistent", "consistent")
    result = batch.train(stored, f"{out}/model", trees=3)
    assert result["auc"].first().auc > 0.8 and result["report"].count() == 5
    model = tables.load_model(f"{out}/model")
    meta = json.loads("".join(r.value for r in spark.read.text(f"{out}/model/metadata").collect()))
    assert meta["n_features"] == 22 and len(meta["categorical_features"]) == 6

    past, current = fixtures.past_and_current(spark, FOLDER, balance=True)
    current = fixtures.with_photo_path(current)
    plain = batch.score(current.drop("account_balance"), model)
    scored = batch.score(current.drop("fraud_label", "is_failed"), model, past)
    assert plain.count() == scored.count() == current.count()

    photos = fixtures.biometric_json(current.where("photo_path IS NOT NULL")).drop("k")
    said = replies.parse_assessment(fixtures.assessment_replies(current).drop("k"))
    known_at = batch.snapshot(past, AS_OF, f"{out}/known")
    ready = scored.withColumn("is_high_value", scores.high_value_serving("transaction_amount"))
    monitor_replies = fixtures.monitor_replies(current).drop("k")
    args = (current, ready, past, photos, monitor_replies, said, AS_OF)
    full, quick = batch.assess_batch(*args), batch.assess_batch(*args, known_at=known_at)
    assert full.count() == current.count()
    codes = "transaction_id", F.to_json("evidence.detected_patterns").alias("p"), F.to_json("evidence.timeline").alias("t")
    assert full.select(*codes).exceptAll(quick.select(*codes)).count() == 0
    one = full.where("biometric IS NOT NULL").first()
    assert one.evidence.timeline[-1].event.startswith("CURRENT: $") and one.agents_analyzed.fraud_detection

    judged = batch.judged_by_model(scored, said.select("transaction_id", F.col("final_verdict").alias("status")))
    judged = judged.withColumn("fraud_report", F.lit("text"))
    root = str(tmp_path / "store")
    cases = batch.escalate(judged, full, said.drop("reply"), root, 1)
    assert cases.count() == judged.where("risk_score >= 70 OR status = 'REJECTED'").count() > 0
    row = cases.first()
    mine, = [json.loads(r.document) for r in case_store.read_evidence(spark, row.evidence_path).where(
        F.col("case_id") == row.case_id).collect()]
    assert mine["transaction_id"] == row.transaction_id and mine["fraud_report"] == "text"
    assert mine["evidence"]["timeline"] and "final_verdict" in mine["risk_assessment"]
    assert case_store.read_alerts(spark, root).count() == cases.count()


TRANSACTION = """Transaction
- id: T1
- user: U1
- amount: $1,234.50
- type: Transfer
- merchant category: Travel
- location: Lima
- device: Mobile
- card: Visa
- authentication: PIN"""
MODEL = """Model
- fraud probability: 0.42
- score of 100: 42
- risk level: MEDIUM
- confidence: {confidence}
- unusual hour: YES
- high value: NO"""
PROFILE = """User history
- transactions: 12
- average amount: $100.00
- range: $1.00 - $900.00
- devices: Desktop, Mobile
- locations: Lima
- earlier fraud flags: 2"""
ACTIVITY = """Activity
- last 24 hours: 3
- newest transactions read, at most 100: 12"""
REPLY = "Answer with a single JSON object and nothing else. Its keys:"
PROMPTS = {
    "monitor": f"""Review one card transaction for fraud, using the transaction and the score of a model.

{TRANSACTION}

Time
- hour: 3

{MODEL}

{REPLY}
- "verdict": APPROVED, REJECTED or REVIEW
- "risk_factors": list of two or three indicators
- "recommended_action": what to do next
- "reasoning": two or three sentences""",
    "evidence": f"""Summarise in two or three sentences how this transaction compares with the user's habits.

{TRANSACTION}

{PROFILE}

{ACTIVITY}

Observations
first thing
second thing""",
    "photo": f"""Judge whether the person in the verification photo is the account holder.

{TRANSACTION}

Photo check
- photo: p.jpg
- result: VERIFIED
- authentic: YES
- overall confidence: 60.00%
- face match: YES
- similarity: 91.00%
- match confidence: 90.00%
- real person: YES
- detection confidence: 60.00%
- quality of 100: 70.00
- live person: YES
- liveness of 100: 0.00
- liveness confidence: 30.00%
- brightness: 0.00
- sharpness: 0.00
- emotion: UNKNOWN 0.0%
- head roll, yaw, pitch: 0.0, 0.0, 0.0

Risk factors
- None

{REPLY}
- "verdict": APPROVED, REJECTED or REVIEW
- "risk_assessment": list of two to four findings
- "recommended_action": what to do with the verification
- "reasoning": two or three sentences""",
    "assessment": f"""Combine the findings below into one fraud decision. Name conflicts between them. A failed photo check weighs heavily.

{TRANSACTION}

Monitor verdict: REVIEW

{MODEL}

{PROFILE}

{ACTIVITY}

Patterns found: 2
- first thing
- second thing

Summary of behaviour: as usual

Photo check
- verdict: APPROVED
- authentic: YES
- similarity: 91.0
- real person: YES
- live person: YES
- confidence: 60.0
- risk factors: None

{REPLY}
- "final_verdict": APPROVED, REJECTED or REVIEW
- "confidence_score": 0 to 100
- "risk_level": LOW, MEDIUM, HIGH or CRITICAL
- "risk_summary": two or three sentences
- "key_findings": list
- "risk_factors": list
- "positive_indicators": list
- "decision_reasoning": three or four sentences
- "recommended_action": one instruction
- "agent_consensus": whether the findings agree
- "confidence_breakdown": object with ml_model_confidence, behavioral_analysis_confidence, biometric_confidence, overall_confidence, each 0 to 1""",
    "case_report": f"""Write a formal fraud case report for investigators: a short summary, the main risk indicators, and the recommended actions.

Case
- id: FA-1
- risk score of 100: 42
- status: REVIEW

{TRANSACTION}

Assessment: because

Evidence: as usual

Patterns
- first thing
- second thing"""}


def test_whole_prompts(spark):
    row = spark.createDataFrame([("T1", "U1", 1234.5, "Transfer", "Travel", "Lima", "Mobile", "Visa", "PIN", "p.jpg", 12, 100.0, 1.0, 900.0,
                                  ["Desktop", "Mobile"], ["Lima"], 2, 3, 12, "REVIEW", "as usual", "because", "FA-1", 42, "REVIEW")],
                                "transaction_id string, user_id string, transaction_amount double, transaction_type string, merchant_category string, "
                                "location string, device_type string, card_type string, authentication_method string, photo_path string, "
                                "total_transactions long, avg_transaction_amount double, min_transaction double, max_transaction double, "
                                "known_devices array<string>, known_locations array<string>, fraud_history long, recent_24h_count long, history_count long, "
                                "monitor_verdict string, llm_summary string, llm_reasoning string, case_id string, risk_score int, status string")
    answer = ('{"verification_result":"VERIFIED","face_comparison":{"match":true,"similarity":91,"confidence":90},"quality_check":{"is_real":true,'
              '"quality_score":70,"confidence":60},"liveness_check":{"is_live":true,"confidence":30,"checks":{"eyes_open":true}}}')
    photo = biometrics.photo_result(spark.createDataFrame([("T1", answer)], "transaction_id string, response string"),
                                    spark.createDataFrame([("T1", '{"verdict":"APPROVED"}')], "transaction_id string, reply string"))
    found = F.array(*[F.struct(F.lit("c").alias("code"), F.lit(x).alias("message")) for x in ("first thing", "second thing")])
    monitor = F.struct(scores.prediction(F.lit(0.42)).alias("prediction"), scores.feature_summary(
        unusual=F.lit(1), hour=F.lit(3), high=F.lit(0)).alias("feature_summary"))
    full = row.join(photo.withColumnRenamed("error", "photo_error"), "transaction_id").withColumns({"patterns": found, "monitor": monitor})
    confidence = full.select(monitor["prediction"]["model_confidence"].cast("string")).first()[0]
    got = {r.agent: r.prompt for r in prompts.requests(full, {a: None for a in PROMPTS}).collect()}
    assert got == {k: v.replace("{confidence}", confidence) for k, v in PROMPTS.items()}


def test_prompts_carry_the_facts(spark):
    past, current = fixtures.past_and_current(spark, FOLDER)
    detected = patterns.detect_snapshot(fixtures.with_photo_path(current), past, AS_OF)
    photo = biometrics.flatten(fixtures.biometric_json(current)).drop("k", "response").withColumnRenamed("error", "photo_error")
    prediction = F.struct(scores.prediction(F.lit(0.42)).alias("prediction"), scores.feature_summary(
        unusual=F.lit(1), hour=F.lit(3), high=F.lit(0)).alias("feature_summary"))
    joined = detected.join(photo, "transaction_id").withColumns({
        "monitor": prediction, "monitor_verdict": F.lit("APPROVED"), "photo_verdict": F.lit(None).cast("string"),
        "llm_summary": F.lit(None).cast("string"), "llm_reasoning": F.lit("why"), "case_id": F.lit("FA-1"),
        "status": F.lit("REVIEW")})
    rows = prompts.requests(joined, {a: None for a in ("monitor", "evidence", "photo", "assessment", "case_report")}).collect()
    assert len(rows) == 5 * current.count()
    by_agent = {r.agent: r for r in rows}
    assert (by_agent["monitor"].max_tokens, by_agent["monitor"].temperature) == (800, 0.3)
    assert (by_agent["case_report"].max_tokens, by_agent["case_report"].temperature) == (None, None)
    assert all(r.prompt for r in rows)
    facts = {r.transaction_id: r for r in detected.collect()}
    for r in rows:
        t = facts[r.transaction_id]
        assert f"${t.transaction_amount:,.2f}" in r.prompt and t.location in r.prompt
        if r.agent in ("evidence", "assessment", "case_report"):
            assert all(p.message in r.prompt for p in t.patterns)
    assert "0.42" in by_agent["monitor"].prompt and '"verdict"' in by_agent["monitor"].prompt
    assert '"confidence_breakdown"' in by_agent["assessment"].prompt
