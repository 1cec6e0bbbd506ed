"""The numbers, word lists, names and message formats that results depend on.

Nothing here is computed. Everything that a deployment may want to change is an argument of the
function that uses it, with one of these values as the default.
"""

# --- fixed values: time rules ---------------------------------------------------------------
SERVING_UNUSUAL_HOURS = [0, 1, 2, 3, 4, 5, 23]
TRAINING_UNUSUAL_FIRST_HOUR = 2
TRAINING_UNUSUAL_LAST_HOUR = 6
FIRST_WEEKEND_DAY = 5  # weekday numbers start at Monday = 0

# --- fixed values: amounts and request defaults ---------------------------------------------
HIGH_VALUE_AMOUNT = 1000.0
HIGH_VALUE_SHARE_OF_MAX = 0.8
REFERENCE_PHOTO_AMOUNT = 10000
DEFAULT_ACCOUNT_BALANCE = 50000.0
DEFAULT_CARD_AGE = 730
DEFAULT_DAILY_COUNT = 5
DEFAULT_AVG_AMOUNT_7D = 200.0

REQUEST_REQUIRED = ["transaction_id", "user_id", "transaction_amount", "transaction_type",
                    "merchant_category", "card_type"]
REQUEST_DEFAULTS = {"device_type": "Desktop", "location": "Unknown", "authentication_method": "Password"}
FEATURE_DEFAULTS = {"transaction_type": "Purchase", "device_type": "Desktop", "location": "Domestic",
                    "merchant_category": "Retail", "card_type": "Credit", "authentication_method": "PIN"}

# --- fixed values: heuristic risk score -----------------------------------------------------
AMOUNT_STEPS = [(5000, 0.3), (2000, 0.2), (1000, 0.1)]  # above this amount, add this much
TINY_AMOUNT, TINY_AMOUNT_RISK = 10, 0.05
UNUSUAL_HOUR_RISK = 0.2
TYPE_RISK = {"withdrawal": 0.15, "transfer": 0.15, "purchase": 0.05}
RISKY_MERCHANT_WORDS, RISKY_MERCHANT_RISK = ["electronics", "jewelry", "travel", "crypto"], 0.15
RISKY_LOCATION_WORDS, RISKY_LOCATION_RISK = ["unknown", "international"], 0.1
WEAK_AUTHENTICATION, WEAK_AUTHENTICATION_RISK = ["none", "password"], 0.1

# --- fixed values: risk bands and decision thresholds ---------------------------------------
LOW_BELOW = 30
MEDIUM_BELOW = 70
EVALUATION_THRESHOLD = 0.35
LABEL_THRESHOLD = 0.5

# --- fixed values: history and pattern rules ------------------------------------------------
AMOUNT_ANOMALY_FACTOR = 5
VELOCITY_LIMIT = 10
HISTORY_LIMIT = 100
HISTORY_DEFAULT_LIMIT = 50
TIMELINE_LENGTH = 5
RECENT_LENGTH = 5
PROFILE_LIST_LENGTH = 10
EVIDENCE_LIST_LENGTH = 5
PROMPT_LIST_LENGTH = 3
TOP_VALUES = 3
RAPID_ROWS = 3
RECENT_HOURS = 24
RAPID_HOURS = 1
REPORT_EXCERPT = 500

# Message formats of the seven patterns, in rule order.
PATTERN_FORMATS = {
    "amount_anomaly": "⚠️ Amount {0}x higher than user average (${1})",
    "high_velocity": "⚠️ High velocity: {0} transactions in last 24 hours",
    "new_device": "⚠️ New device detected: {0}",
    "new_location": "⚠️ New location: {0}",
    "first_merchant": "ℹ️ First transaction at {0}",
    "fraud_history": "🚨 User has {0} previous fraud flags",
    "rapid_succession": "⚠️ Multiple transactions within 1 hour",
}
TIMELINE_EVENT_FORMAT = "${0} at {1} ({2})"
TIMELINE_CURRENT_PREFIX = "CURRENT: "

# Message formats of the photo-check risk factors, in rule order.
PHOTO_FACTOR_FORMATS = {
    "face_mismatch": "Face mismatch (similarity: {0}%)",
    "deepfake": "Potential deepfake detected",
    "liveness": "Liveness check failed",
    "low_quality": "Low image quality ({0})",
    "eyes": "Eyes not visible",
    "sunglasses": "Sunglasses detected",
}
PHOTO_QUALITY_MIN = 70
SIMILARITY_THRESHOLD = 80

# Values of a reply that is not valid JSON, and of an assessment that failed for another reason.
REPLY_VERDICT = "REVIEW"
MANUAL_REVIEW = "Manual review required"
MONITOR_FALLBACK_FACTOR = "Unable to parse model reply"
SUMMARY_FALLBACK = "Unable to generate summary due to system error."
PHOTO_FALLBACK_FINDING = "Unable to parse analysis"
ASSESSMENT_FALLBACK = {"confidence_score": "50", "risk_level": "MEDIUM",
                       "risk_summary": "Unable to parse comprehensive assessment",
                       "key_findings": ["System error in risk assessment"]}
ASSESSMENT_ERROR = {"confidence_score": "0", "risk_level": "UNKNOWN",
                    "risk_summary": "Error during assessment: {0}", "key_findings": ["System error"],
                    "decision_reasoning": "Unable to complete risk assessment due to system error"}

# Sampling parameters of the five model requests: (max tokens, temperature).
REQUEST_PARAMETERS = {"monitor": (800, 0.3), "evidence": (300, 0.3), "photo": (800, 0.2),
                      "assessment": (1500, 0.3), "case_report": (None, None)}

# --- fixed values: demo scenarios -----------------------------------------------------------
CLEAN_RISK_BELOW = 20
VELOCITY_SCENARIO_COUNT = 10
TAKEOVER_AMOUNT = 10000
DEVIATION_SCENARIO_RATIO = 10
GEOGRAPHIC_DISTANCE = 1000
TAKEOVER_MATCH_SCORE = 0.43
TAKEOVER_DEEPFAKE_CONFIDENCE = 0.92
SCENARIO_NAMES = ["Clean Transaction", "Velocity Attack", "Deepfake Account Takeover", "Amount Anomaly",
                  "Geographic Impossibility"]

# --- fixed values: model ---------------------------------------------------------------------
# Header of the raw transaction file that is known from the model inputs and the excluded columns.
RAW_COLUMNS = ["Transaction_ID", "User_ID", "Transaction_Amount", "Transaction_Type", "Timestamp",
               "Account_Balance", "Device_Type", "Location", "Merchant_Category", "IP_Address_Flag",
               "Previous_Fraudulent_Activity", "Daily_Transaction_Count", "Avg_Transaction_Amount_7d",
               "Failed_Transaction_Count_7d", "Card_Type", "Card_Age", "Transaction_Distance",
               "Authentication_Method", "Risk_Score", "Is_Weekend", "Fraud_Label"]
# Input columns of the model, in the order of the vector.
MODEL_FEATURES = ["Transaction_Amount", "Transaction_Type", "Account_Balance", "Device_Type", "Location",
                  "Merchant_Category", "IP_Address_Flag", "Previous_Fraudulent_Activity",
                  "Daily_Transaction_Count", "Avg_Transaction_Amount_7d", "Failed_Transaction_Count_7d",
                  "Card_Type", "Card_Age", "Transaction_Distance", "Authentication_Method", "Is_Weekend",
                  "hour_of_day", "day_of_week", "is_unusual_hour", "amount_deviation_ratio",
                  "is_high_value", "is_new_device"]
CATEGORICAL_FEATURES = ["Transaction_Type", "Device_Type", "Location", "Merchant_Category", "Card_Type",
                        "Authentication_Method"]
EXCLUDED_FEATURES = ["Transaction_ID", "User_ID", "Timestamp", "Fraud_Label", "Risk_Score"]
TREE_DEPTH = 6
LEARNING_RATE = 0.1
TREES = 150
SEED = 42
TEST_SHARE = 0.15
VALIDATION_SHARE = 0.176
TARGET_NAMES = ["Legitimate", "Fraud"]

# --- fixed values: cases ---------------------------------------------------------------------
CASE_ID_PREFIX = "FA"
CASE_NUMBER_START = 1000
EVIDENCE_BUCKETS = 8
ALERT_SUBJECT_FORMAT = "Fraud Alert: {0}"
# Our own wording: case, transaction, amount, score, status, folder of the evidence, start of the report.
ALERT_MESSAGE_FORMAT = ("Case {0}: transaction {1} over ${2} scored {3} of 100 (status {4}).\n"
                        "Evidence: {5}\nThe report begins:\n{6}")
