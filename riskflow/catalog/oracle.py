"""The same results in SQL for DuckDB, written independently of the DataFrame code: name -> SQL text."""

AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"

_TXN = """
e AS (
  SELECT event_id, user_id, ts, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events),
txn AS (
  SELECT e.event_id AS transaction_id, e.user_id, e.ts, e.value * 25 AS transaction_amount,
    CASE e.event_type WHEN 'purchase' THEN 'Purchase' WHEN 'signup' THEN 'Withdrawal' WHEN 'click' THEN 'Transfer'
         WHEN 'view' THEN 'Online' ELSE 'ATM Withdrawal' END AS transaction_type,
    c.c_acctbal AS account_balance,
    CASE e.k % 3 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Desktop' ELSE 'Tablet' END AS device_type,
    n.n_name AS location,
    CASE CAST(floor(e.k / 20) AS INT) WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Travel' WHEN 2 THEN 'Retail'
         WHEN 3 THEN 'Grocery' ELSE 'Jewelry' END AS merchant_category,
    CASE WHEN e.event_id % 20 = 0 THEN 1 ELSE 0 END AS ip_address_flag,
    CASE e.k % 4 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Mastercard' WHEN 2 THEN 'Amex' ELSE 'Discover' END AS card_type,
    CAST((e.user_id * 37) % 1500 AS INT) AS card_age, e.k * 25.0E0 AS transaction_distance,
    CASE e.event_id % 4 WHEN 0 THEN 'Password' WHEN 1 THEN 'PIN' WHEN 2 THEN 'Biometric' ELSE 'None' END
      AS authentication_method,
    CAST(e.event_id % 100 AS DOUBLE) AS risk_score,
    CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS is_failed,
    CASE WHEN e.event_type = 'error' OR e.value * 25 > 2500 THEN 1 ELSE 0 END AS fraud_label,
    CASE WHEN isodow(e.ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, e.k
  FROM e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = e.k % 25)"""

_PAST = f"past AS (SELECT * FROM txn WHERE ts < {AS_OF}), cur AS (SELECT * FROM txn WHERE ts >= {AS_OF})"

_HIST = """
hist AS (
  SELECT *, count(*) OVER d7 AS count_7d, avg(transaction_amount) OVER d7 AS avg7,
    CAST(coalesce(sum(is_failed) OVER d7, 0) AS INT) AS failed7, count(*) OVER h24 AS count_24h,
    CAST(count(*) OVER today AS INT) AS daily, count(*) OVER before AS hist_count,
    avg(transaction_amount) OVER before AS hist_avg,
    CAST(coalesce(sum(fraud_label) OVER before, 0) AS BIGINT) AS hist_fraud,
    CASE WHEN coalesce(sum(fraud_label) OVER before, 0) > 0 THEN 1 ELSE 0 END AS prior_fraud,
    CASE WHEN lag(ts, 3) OVER o >= ts - INTERVAL 24 HOUR
          AND lag(ts, 1) OVER o - lag(ts, 3) OVER o < INTERVAL 1 HOUR THEN 1 ELSE 0 END AS rapid
  FROM txn
  WINDOW o AS (PARTITION BY user_id ORDER BY ts, transaction_id),
    before AS (PARTITION BY user_id ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    d7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW),
    h24 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW),
    today AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, transaction_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_FIRST = """
firsts AS (
  SELECT transaction_id,
    CASE WHEN row_number() OVER (PARTITION BY user_id, device_type ORDER BY ts, transaction_id) = 1 THEN 1 ELSE 0 END AS new_device,
    CASE WHEN row_number() OVER (PARTITION BY user_id, location ORDER BY ts, transaction_id) = 1 THEN 1 ELSE 0 END AS new_location,
    CASE WHEN row_number() OVER (PARTITION BY user_id, merchant_category ORDER BY ts, transaction_id) = 1 THEN 1 ELSE 0 END AS new_merchant
  FROM txn)"""

_SCORE = """
scored AS (
  SELECT *, round(least(
      CASE WHEN transaction_amount > 5000 THEN 0.3E0 WHEN transaction_amount > 2000 THEN 0.2E0
           WHEN transaction_amount > 1000 THEN 0.1E0 WHEN transaction_amount < 10 THEN 0.05E0 ELSE 0E0 END
    + CASE WHEN hour(ts) IN (0, 1, 2, 3, 4, 5, 23) THEN 0.2E0 ELSE 0E0 END
    + CASE lower(transaction_type) WHEN 'withdrawal' THEN 0.15E0 WHEN 'transfer' THEN 0.15E0
           WHEN 'purchase' THEN 0.05E0 ELSE 0E0 END
    + CASE WHEN regexp_matches(lower(merchant_category), 'electronics|jewelry|travel|crypto') THEN 0.15E0 ELSE 0E0 END
    + CASE WHEN regexp_matches(lower(location), 'unknown|international') THEN 0.1E0 ELSE 0E0 END
    + CASE WHEN lower(authentication_method) IN ('none', 'password') THEN 0.1E0 ELSE 0E0 END, 1E0), 4) AS score
  FROM txn)"""

_NEWEST = """
newest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, transaction_id DESC) AS rank FROM past)"""

_SNAPSHOT = f"""
snap AS (
  SELECT user_id, count(*) AS history_count,
    count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOUR) AS velocity_count,
    CASE WHEN count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOUR) >= 3
          AND max(ts) FILTER (WHERE rank = 1) - max(ts) FILTER (WHERE rank = 3) < INTERVAL 1 HOUR
         THEN 1 ELSE 0 END AS rapid
  FROM newest WHERE rank <= 100 GROUP BY user_id),
prof AS (
  SELECT user_id, count(*) AS total_transactions, avg(transaction_amount) AS avg_amount,
    min(transaction_amount) AS min_amount, max(transaction_amount) AS max_amount,
    count(*) FILTER (WHERE fraud_label = 1) AS fraud_history,
    arg_max(account_balance, (ts, transaction_id)) AS account_balance,
    count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOUR) AS recent_24h_count,
    list_sort(list(DISTINCT device_type)) AS devices, list_sort(list(DISTINCT location)) AS locations,
    list_sort(list(DISTINCT merchant_category)) AS merchants
  FROM past GROUP BY user_id)"""


def _money(x):
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _plain(x):
    return f"printf('%.2f', {x})"


_FOUND = f"""
found AS (
  SELECT c.transaction_id, c.user_id, list_filter([
    CASE WHEN p.avg_amount > 0 AND c.transaction_amount > p.avg_amount * 5 THEN {{'code': 'amount_anomaly', 'detail':
      '⚠️ Amount ' || CAST(CAST(floor(c.transaction_amount / p.avg_amount) AS BIGINT) AS VARCHAR)
      || 'x higher than user average ($' || {_plain('p.avg_amount')} || ')'}} END,
    CASE WHEN s.velocity_count > VELOCITY THEN {{'code': 'high_velocity', 'detail':
      '⚠️ High velocity: ' || s.velocity_count || ' transactions in last 24 hours'}} END,
    CASE WHEN NOT list_contains(coalesce(p.devices SLICED, []), c.device_type)
      THEN {{'code': 'new_device', 'detail': '⚠️ New device detected: ' || c.device_type}} END,
    CASE WHEN NOT list_contains(coalesce(p.locations SLICED, []), c.location)
      THEN {{'code': 'new_location', 'detail': '⚠️ New location: ' || c.location}} END,
    CASE WHEN NOT list_contains(coalesce(p.merchants SLICED, []), c.merchant_category)
      THEN {{'code': 'first_merchant', 'detail': 'ℹ️ First transaction at ' || c.merchant_category}} END,
    CASE WHEN p.fraud_history > 0 THEN {{'code': 'fraud_history', 'detail':
      '🚨 User has ' || p.fraud_history || ' previous fraud flags'}} END,
    CASE WHEN s.rapid = 1 THEN {{'code': 'rapid_succession', 'detail':
      '⚠️ Multiple transactions within 1 hour'}} END], lambda x: x IS NOT NULL) AS patterns
  FROM cur c LEFT JOIN prof p USING (user_id) LEFT JOIN snap s USING (user_id))"""


def _found(velocity=10, cut=False):
    return _FOUND.replace("VELOCITY", str(velocity)).replace(" SLICED", "[1:10]" if cut else "")


_POINT = f"""
point AS (
  SELECT h.transaction_id, unnest(list_filter([
    CASE WHEN h.hist_avg > 0 AND h.transaction_amount > h.hist_avg * 5 THEN {{'code': 'amount_anomaly', 'detail':
      '⚠️ Amount ' || CAST(CAST(floor(h.transaction_amount / h.hist_avg) AS BIGINT) AS VARCHAR)
      || 'x higher than user average ($' || {_plain('h.hist_avg')} || ')'}} END,
    CASE WHEN least(h.count_24h, 100) > VELOCITY THEN {{'code': 'high_velocity', 'detail':
      '⚠️ High velocity: ' || least(h.count_24h, 100) || ' transactions in last 24 hours'}} END,
    CASE WHEN f.new_device = 1 THEN {{'code': 'new_device', 'detail': '⚠️ New device detected: ' || h.device_type}} END,
    CASE WHEN f.new_location = 1 THEN {{'code': 'new_location', 'detail': '⚠️ New location: ' || h.location}} END,
    CASE WHEN f.new_merchant = 1 THEN {{'code': 'first_merchant', 'detail':
      'ℹ️ First transaction at ' || h.merchant_category}} END,
    CASE WHEN h.hist_fraud > 0 THEN {{'code': 'fraud_history', 'detail':
      '🚨 User has ' || h.hist_fraud || ' previous fraud flags'}} END,
    CASE WHEN h.rapid = 1 THEN {{'code': 'rapid_succession', 'detail':
      '⚠️ Multiple transactions within 1 hour'}} END], lambda x: x IS NOT NULL)) AS p
  FROM hist h JOIN firsts f USING (transaction_id))"""

_BIO = """
bio AS (
  SELECT transaction_id, k, (k >= 20) AS face_matched, (k % 7 <> 0) AS is_real, (k % 11 <> 0) AS is_live,
    CASE WHEN k % 5 = 0 THEN 'FAILED' ELSE 'VERIFIED' END AS verification_result,
    list_filter([
      CASE WHEN k < 20 THEN 'Face mismatch (similarity: ' || k || '%)' END,
      CASE WHEN k % 7 = 0 THEN 'Potential deepfake detected' END,
      CASE WHEN k % 11 = 0 THEN 'Liveness check failed' END,
      CASE WHEN k % 2 = 0 AND k < 70 THEN 'Low image quality (' || k || ')' END,
      CASE WHEN k % 4 = 1 THEN 'Eyes not visible' END,
      CASE WHEN k % 4 = 0 THEN 'Sunglasses detected' END], lambda x: x IS NOT NULL) AS factors
  FROM txn)"""

_MONITOR = """
said AS (
  SELECT transaction_id, CASE WHEN k % 10 = 3 THEN 'reply is not a JSON object' END AS error,
    CASE WHEN k % 10 IN (0, 1, 2, 3) THEN 'REVIEW' WHEN k > 70 THEN 'REJECTED' ELSE 'APPROVED' END AS verdict,
    CASE k % 10 WHEN 0 THEN 'not json' WHEN 1 THEN '{"verdict":"REJECTED"} extra text' WHEN 3 THEN '["APPROVED"]' END AS bad
  FROM txn)"""

_ASSESSMENT = """
judged AS (
  SELECT transaction_id,
    CASE WHEN k % 10 IN (0, 1) THEN 'REVIEW' WHEN k > 70 THEN 'REJECTED' WHEN k > 40 THEN 'REVIEW' ELSE 'APPROVED' END AS final_verdict,
    CASE k % 10 WHEN 0 THEN 50E0 WHEN 1 THEN 0E0 ELSE CAST(k AS DOUBLE) END AS confidence_score,
    CASE WHEN k % 10 = 0 THEN 'MEDIUM' WHEN k % 10 = 1 THEN 'UNKNOWN' WHEN k > 70 THEN 'HIGH'
         WHEN k > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE k % 10 WHEN 0 THEN 'Unable to parse comprehensive assessment'
         WHEN 1 THEN 'Error during assessment: reply is not a JSON object' END AS risk_summary,
    CASE k % 10 WHEN 0 THEN 'System error in risk assessment' WHEN 1 THEN 'System error' ELSE 'a|b' END AS key_findings,
    CASE k % 10 WHEN 0 THEN 'Sorry, no decision for ' || k
         WHEN 1 THEN 'Unable to complete risk assessment due to system error' END AS decision_reasoning,
    CASE WHEN k % 10 IN (0, 1) THEN 'Manual review required' ELSE 'act ' || k END AS recommended_action,
    CASE WHEN k % 10 = 1 THEN 'reply is not a JSON object' END AS error
  FROM txn)"""

_CASES = """
cases AS (
  SELECT s.transaction_id, s.user_id, s.ts, s.transaction_amount, CAST(floor(s.score * 100) AS INT) AS risk_score,
    coalesce(r.verdict, 'REVIEW') AS status
  FROM scored s LEFT JOIN (SELECT * FROM said WHERE error IS NULL) r USING (transaction_id)
  WHERE CAST(floor(s.score * 100) AS INT) >= 70 OR coalesce(r.verdict, 'REVIEW') = 'REJECTED'),
numbered AS (
  SELECT *, 'FA-' || strftime(ts, '%Y%m%d') || '-' || (999 + row_number() OVER (
      PARTITION BY CAST(ts AS DATE) ORDER BY ts, transaction_id)) AS case_id,
    repeat('Report on transaction ' || transaction_id || '. ', 20) AS report
  FROM cases),
records AS (
  SELECT *, 'evidence/case_date=' || strftime(ts, '%Y-%m-%d') || '/bucket='
    || CAST(split_part(case_id, '-', 3) AS INT) % 8 AS evidence_path
  FROM numbered)"""

_COUNTS = """
long AS (
  SELECT user_id, ts, transaction_id, unnest([
    {'field': 'location', 'value': location}, {'field': 'merchant', 'value': merchant_category},
    {'field': 'card', 'value': card_type}, {'field': 'device', 'value': device_type},
    {'field': 'hour', 'value': CAST(hour(ts) AS VARCHAR)}]) AS p FROM txn),
counts AS (
  SELECT user_id, p.field AS field, p.value AS value, count(*) AS n, min((ts, transaction_id)) AS first
  FROM long GROUP BY ALL),
top AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY n DESC, first) AS rank FROM counts)"""

_FLAGS = """
req AS (
  SELECT transaction_id, user_id, transaction_amount, CASE WHEN k <> 13 THEN transaction_type END AS transaction_type,
    CASE WHEN card_type <> 'Discover' THEN merchant_category END AS merchant_category, card_type,
    CASE WHEN device_type <> 'Tablet' THEN device_type END AS device_type, CASE WHEN k > 9 THEN location END AS location,
    CASE WHEN authentication_method <> 'None' THEN authentication_method END AS authentication_method,
    CASE WHEN authentication_method = 'Biometric' THEN 'photos/' || transaction_id || '.jpg' END AS photo_path
  FROM txn)"""

_ENHANCED = """
enhanced AS (
  SELECT h.*, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
    transaction_amount / CASE WHEN avg7 = 0 THEN 1 ELSE avg7 END AS ratio,
    CASE WHEN transaction_amount > 0.8E0 * max(transaction_amount) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS is_high_value
  FROM hist h)"""


def _sql(body, *parts):
    return "WITH " + ", ".join((_TXN,) + parts) + "\n" + body


def _split_counts():
    """Rows per label and part: shares rounded up as a whole, remainders to the largest fractions."""
    def quota(source, size, share, name):
        return f"""
{name}_x AS (SELECT *, ceil(sum({size}) OVER () * {share}) AS wanted,
    ceil(sum({size}) OVER () * {share}) * {size} / sum({size}) OVER () AS exact FROM {source}),
{name}_q AS (SELECT * EXCLUDE (wanted, exact), CAST(floor(exact) + CASE WHEN row_number() OVER (
    ORDER BY exact - floor(exact) DESC, {size} DESC) <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT)
    AS {name} FROM {name}_x)"""
    return _sql("""
SELECT fraud_label, 'test' AS split, n_test AS n FROM n_val_q
UNION ALL SELECT fraud_label, 'validation', n_val FROM n_val_q
UNION ALL SELECT fraud_label, 'train', rest - n_val FROM n_val_q""",
                "sizes AS (SELECT fraud_label, count(*) AS total FROM txn GROUP BY fraud_label)",
                quota("sizes", "total", "0.15E0", "n_test"),
                "remaining AS (SELECT *, total - n_test AS rest FROM n_test_q)",
                quota("remaining", "rest", "0.176E0", "n_val"))


ORACLE = {
    "time_features_serving": _sql("""
SELECT transaction_id, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, is_weekend,
  CASE WHEN hour(ts) IN (0, 1, 2, 3, 4, 5, 23) THEN 1 ELSE 0 END AS is_unusual_hour FROM txn"""),
    "time_features_training": _sql("""
SELECT transaction_id, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
  CASE WHEN hour(ts) BETWEEN 2 AND 6 THEN 1 ELSE 0 END AS is_unusual_hour FROM txn"""),
    "amount_deviation_training": _sql("""
SELECT transaction_id, round(transaction_amount / CASE WHEN avg7 = 0 THEN 1 ELSE avg7 END, 8) AS amount_deviation_ratio
FROM hist""", _HIST),
    "amount_deviation_serving": _sql("""
SELECT transaction_id, round(CASE WHEN avg7 = 0 THEN 0 ELSE abs(transaction_amount - avg7) / avg7 END, 8)
  AS amount_deviation_ratio FROM hist""", _HIST),
    "high_value_training": _sql("""
SELECT transaction_id, user_id, CASE WHEN transaction_amount > 0.8E0 * max(transaction_amount) OVER (PARTITION BY user_id)
  THEN 1 ELSE 0 END AS is_high_value FROM txn"""),
    "high_value_serving": _sql("""
SELECT transaction_id, CASE WHEN transaction_amount > 1000 THEN 1 ELSE 0 END AS is_high_value FROM txn"""),
    "new_device_training": _sql("""
SELECT t.transaction_id, CASE WHEN EXISTS (SELECT 1 FROM txn o WHERE o.user_id = t.user_id
  AND o.device_type = t.device_type) THEN 0 ELSE 1 END AS is_new_device FROM txn t"""),
    "heuristic_risk_score": _sql("SELECT transaction_id, score AS risk_score FROM scored", _SCORE),
    "feature_assembly_defaults": _sql("""
SELECT transaction_id, transaction_amount, transaction_type, 50000E0 AS account_balance, 'Desktop' AS device_type, location,
  merchant_category, 0 AS ip_address_flag, 0 AS previous_fraudulent_activity, 5 AS daily_transaction_count,
  200E0 AS avg_transaction_amount_7d, 0 AS failed_transaction_count_7d, 'Credit' AS card_type, 730 AS card_age,
  0 AS transaction_distance, 'PIN' AS authentication_method, is_weekend, hour(ts) AS hour_of_day,
  isodow(ts) - 1 AS day_of_week, CASE WHEN hour(ts) IN (0, 1, 2, 3, 4, 5, 23) THEN 1 ELSE 0 END AS is_unusual_hour,
  round(abs(transaction_amount - 200) / 200, 8) AS amount_deviation_ratio,
  CASE WHEN transaction_amount > 1000 THEN 1 ELSE 0 END AS is_high_value, 0 AS is_new_device FROM txn"""),
    "feature_assembly_history": _sql("""
SELECT h.transaction_id, transaction_amount, transaction_type, account_balance, device_type, location, merchant_category,
  ip_address_flag, prior_fraud AS previous_fraudulent_activity, daily AS daily_transaction_count,
  round(avg7, 8) AS avg_transaction_amount_7d, failed7 AS failed_transaction_count_7d, card_type, card_age,
  transaction_distance, authentication_method, is_weekend, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
  CASE WHEN hour(ts) IN (0, 1, 2, 3, 4, 5, 23) THEN 1 ELSE 0 END AS is_unusual_hour,
  round(coalesce(CASE WHEN avg7 = 0 THEN 0 ELSE abs(transaction_amount - avg7) / avg7 END, 0), 8) AS amount_deviation_ratio,
  CASE WHEN transaction_amount > 1000 THEN 1 ELSE 0 END AS is_high_value, new_device AS is_new_device
FROM hist h JOIN firsts f USING (transaction_id)""", _HIST, _FIRST),
    "enhanced_transactions": _sql("""
SELECT transaction_id, transaction_amount, transaction_type, device_type, location, merchant_category, ip_address_flag,
  card_type, card_age, transaction_distance, authentication_method, is_weekend, account_balance,
  daily AS daily_transaction_count, round(avg7, 8) AS avg_transaction_amount_7d, failed7 AS failed_transaction_count_7d,
  prior_fraud AS previous_fraudulent_activity, hour_of_day, day_of_week,
  CASE WHEN hour_of_day BETWEEN 2 AND 6 THEN 1 ELSE 0 END AS is_unusual_hour, is_high_value, 0 AS is_new_device,
  round(ratio, 8) AS amount_deviation_ratio FROM enhanced""", _HIST, _ENHANCED),
    "score_transforms": _sql("""
SELECT transaction_id, score AS fraud_probability, CAST(floor(score * 100) AS INT) AS fraud_score,
  round(greatest(score, 1 - score), 4) AS model_confidence, transaction_amount AS amount, transaction_type AS type,
  merchant_category AS merchant, CASE WHEN hour(ts) IN (0, 1, 2, 3, 4, 5, 23) THEN 1 ELSE 0 END AS time_based_risk,
  hour(ts) AS hour, CASE WHEN transaction_amount > 1000 THEN 1 ELSE 0 END AS is_high_value FROM scored""", _SCORE),
    "risk_band": _sql("""
SELECT transaction_id, CAST(floor(score * 100) AS INT) AS fraud_score, CASE WHEN floor(score * 100) < 30 THEN 'LOW'
  WHEN floor(score * 100) < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM scored""", _SCORE),
    "recent_24h_filter": _sql(f"""
SELECT transaction_id, {AS_OF} - ts <= INTERVAL 24 HOUR AS is_recent FROM txn"""),
    "history_cutoff": _sql(f"""
SELECT transaction_id, user_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
  transaction_id DESC) AS rank FROM past WHERE ts >= {AS_OF} - INTERVAL 7 DAY) WHERE rank <= 50""", _PAST),
    "scenario_samples": _sql("""
SELECT scenario_name, transaction_id, user_id, transaction_amount, daily AS daily_transaction_count, transaction_distance,
  CASE WHEN scenario_name LIKE 'Deepfake%' THEN 'photos/uploads/deepfake_demo.jpg' END AS uploaded_photo_path,
  CASE WHEN scenario_name LIKE 'Deepfake%' THEN 0.43E0 END AS biometric_match_score,
  CASE WHEN scenario_name LIKE 'Deepfake%' THEN 0.92E0 END AS deepfake_confidence
FROM (SELECT *, row_number() OVER (PARTITION BY scenario_name ORDER BY ts, transaction_id) AS r FROM (
  SELECT 'Clean Transaction' AS scenario_name, * FROM enhanced WHERE fraud_label = 0 AND risk_score < 20
  UNION ALL SELECT 'Velocity Attack', * FROM enhanced WHERE fraud_label = 1 AND daily > 2
  UNION ALL SELECT 'Deepfake Account Takeover', * FROM enhanced WHERE fraud_label = 1 AND transaction_amount > 10000
  UNION ALL SELECT 'Amount Anomaly', * FROM enhanced WHERE fraud_label = 1 AND ratio > 10
  UNION ALL SELECT 'Geographic Impossibility', * FROM enhanced WHERE fraud_label = 1 AND transaction_distance > 1000))
WHERE r = 1""", _HIST, _ENHANCED),
    "request_defaults": _sql("""
SELECT transaction_id, user_id, transaction_amount, transaction_type, merchant_category, card_type,
  coalesce(device_type, 'Desktop') AS device_type, coalesce(location, 'Unknown') AS location,
  coalesce(authentication_method, 'Password') AS authentication_method, photo_path
FROM req WHERE transaction_type IS NOT NULL AND merchant_category IS NOT NULL""", _FLAGS),
    "request_rejects": _sql("""
SELECT transaction_id, 'missing: ' || concat_ws(', ', CASE WHEN transaction_type IS NULL THEN 'transaction_type' END,
  CASE WHEN merchant_category IS NULL THEN 'merchant_category' END) AS error
FROM req WHERE transaction_type IS NULL OR merchant_category IS NULL""", _FLAGS),
    "photo_requests": _sql("""
SELECT transaction_id, user_id, photo_path, 80 AS similarity_threshold FROM req WHERE photo_path IS NOT NULL""", _FLAGS),
    "user_profile_training": _sql("""
SELECT b.*, l.* EXCLUDE (user_id) FROM (
  SELECT user_id, count(*) AS total_transactions, round(avg(transaction_amount), 8) AS avg_transaction_amount,
    date_sub('day', min(ts), max(ts)) AS account_age_days,
    round(count(*) / greatest(date_sub('day', min(ts), max(ts)), 1), 8) AS transaction_frequency,
    CAST(sum(ip_address_flag) AS BIGINT) AS fraud_history_count, max(transaction_amount) AS highest_transaction,
    round(avg(is_weekend), 8) AS weekend_transaction_ratio,
    CASE WHEN max(transaction_amount) > 10000 THEN 'photos/reference/' || user_id || '.jpg' END AS reference_photo_path,
    mode(location ORDER BY location) AS home_location, mode(card_type ORDER BY card_type) AS typical_card_type
  FROM txn GROUP BY user_id) b
JOIN (SELECT user_id,
    string_agg(value || ':' || n, '|' ORDER BY rank) FILTER (WHERE field = 'location' AND rank <= 3) AS typical_locations,
    string_agg(value || ':' || n, '|' ORDER BY rank) FILTER (WHERE field = 'merchant' AND rank <= 3) AS typical_merchants,
    string_agg(value || ':' || n, '|' ORDER BY rank) FILTER (WHERE field = 'hour' AND rank <= 3) AS active_hours,
    string_agg(value, '|' ORDER BY first) FILTER (WHERE field = 'device') AS known_devices
  FROM top GROUP BY user_id) l ON l.user_id = b.user_id""", _COUNTS),
    "profile_top3": _sql("""
SELECT user_id, field, value, n, rank FROM top WHERE rank <= 3 AND field IN ('location', 'merchant', 'hour')""", _COUNTS),
    "profile_mode": _sql("""
SELECT user_id, 'location' AS field, mode(location ORDER BY location) AS value FROM txn GROUP BY user_id
UNION ALL SELECT user_id, 'card', mode(card_type ORDER BY card_type) FROM txn GROUP BY user_id"""),
    "user_profile_serving": _sql("""
SELECT user_id, total_transactions, round(avg_amount, 8) AS avg_transaction_amount, min_amount AS min_transaction,
  max_amount AS max_transaction, fraud_history, account_balance, recent_24h_count, len(devices) AS n_devices,
  len(locations) AS n_locations, len(merchants) AS n_merchants, array_to_string(devices[1:10], '|') AS known_devices,
  array_to_string(locations[1:10], '|') AS known_locations, array_to_string(merchants[1:10], '|') AS known_merchants
FROM prof""", _PAST, _NEWEST, _SNAPSHOT),
    "recent_txn_count": _sql(f"""
SELECT user_id, count(*) AS recent_count FROM past WHERE ts >= {AS_OF} - INTERVAL 24 HOUR GROUP BY user_id""", _PAST),
    "dataset_stats": _sql("""
SELECT count(*) AS n_transactions, count(DISTINCT user_id) AS n_users, CAST(sum(fraud_label) AS BIGINT) AS n_fraud,
  count(*) FILTER (WHERE fraud_label = 0) AS n_legitimate, round(avg(fraud_label), 6) AS fraud_rate FROM txn"""),
    "txn_profile_enrich": _sql("""
SELECT c.transaction_id, c.user_id, coalesce(total_transactions, 0) AS total_transactions,
  round(coalesce(avg_amount, 0), 8) AS avg_transaction_amount, coalesce(fraud_history, 0) AS fraud_history,
  coalesce(array_to_string(devices[1:10], '|'), '') AS known_devices
FROM cur c LEFT JOIN prof USING (user_id)""", _PAST, _NEWEST, _SNAPSHOT),
    "newest_history": _sql("""
SELECT user_id, transaction_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
  transaction_id DESC) AS rank FROM txn) WHERE rank <= 50"""),
    "velocity_24h": _sql("SELECT transaction_id, count_24h FROM hist", _HIST),
    "rapid_succession": _sql("SELECT transaction_id, rapid AS rapid_succession FROM hist", _HIST),
    "rolling_7d_features": _sql("""
SELECT transaction_id, count_7d, round(avg7, 8) AS avg_transaction_amount_7d, failed7 AS failed_transaction_count_7d,
  prior_fraud AS previous_fraudulent_activity, hist_count, hist_fraud, round(hist_avg, 8) AS hist_avg_amount
FROM hist""", _HIST),
    "daily_txn_count": _sql("SELECT transaction_id, daily AS daily_transaction_count FROM hist", _HIST),
    "first_seen_flags": _sql("""
SELECT transaction_id, new_device AS is_new_device, new_location AS is_new_location, new_merchant AS is_new_merchant
FROM firsts""", _FIRST),
    "history_snapshot": _sql("""
SELECT user_id, history_count, velocity_count, rapid AS rapid_succession FROM snap""", _PAST, _NEWEST, _SNAPSHOT),
    "recent_5": _sql("""
SELECT user_id, CAST(rank - 1 AS INT) AS pos, transaction_amount AS amount, merchant_category AS merchant,
  epoch_us(ts) AS time_us, fraud_label AS fraud_flag FROM newest WHERE rank <= 5""", _PAST, _NEWEST),
    "detected_patterns": _sql("SELECT transaction_id, p.code AS pattern_code, p.detail AS detail FROM point",
                              _HIST, _FIRST, _POINT.replace("VELOCITY", "4")),
    "pattern_counts": _sql("SELECT p.code AS pattern_code, count(*) AS n FROM point GROUP BY 1",
                           _HIST, _FIRST, _POINT.replace("VELOCITY", "10")),
    "detected_patterns_snapshot": _sql("""
SELECT transaction_id, array_to_string(list_transform(patterns, lambda x: x.detail), '|') AS patterns FROM found""",
                                       _PAST, _NEWEST, _SNAPSHOT, _found(4)),
    "detected_patterns_short_lists": _sql("""
SELECT transaction_id, unnest(patterns).code AS pattern_code FROM found""", _PAST, _NEWEST, _SNAPSHOT, _found(10, True)),
    "biometric_flatten": _sql("""
SELECT transaction_id, verification_result = 'VERIFIED' AND face_matched AND is_real AND is_live AS is_authentic,
  verification_result, 80E0 AS overall_confidence, face_matched, CAST(k AS DOUBLE) AS face_similarity, is_real,
  CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) ELSE 0E0 END AS quality_score, is_live, 0E0 AS liveness_score,
  0E0 AS brightness, CASE WHEN k % 6 = 0 THEN 'CALM' ELSE 'UNKNOWN' END AS top_emotion,
  CASE WHEN k % 6 = 0 THEN 61.5E0 ELSE 0E0 END AS emotion_confidence,
  CASE WHEN k % 10 = 0 THEN -2.25E0 ELSE 0E0 END AS yaw, '' AS raw_reason FROM bio""", _BIO),
    "biometric_risk_factors": _sql("""
SELECT transaction_id, array_to_string(factors, '|') AS risk_factors, len(factors) AS n_factors FROM bio""", _BIO),
    "reply_monitor": _sql("""
SELECT transaction_id, CASE WHEN error IS NULL THEN verdict END AS verdict,
  CASE WHEN bad IS NOT NULL THEN 'Unable to parse model reply' WHEN verdict = 'REVIEW' THEN '' END AS risk_factors,
  CASE WHEN bad IS NOT NULL THEN 'Manual review required' END AS recommended_action, bad AS reasoning, error
FROM said""", _MONITOR),
    "reply_photo": _sql("""
SELECT transaction_id, verdict, CASE WHEN bad IS NOT NULL THEN 'Unable to parse analysis' END AS risk_assessment,
  CASE WHEN bad IS NOT NULL THEN 'Manual review required' END AS recommended_action, error FROM said""", _MONITOR),
    "reply_assessment": _sql("SELECT * FROM judged", _ASSESSMENT),
    "evidence_package": _sql(f"""
SELECT f.transaction_id, len(f.patterns) AS n_patterns, coalesce(p.total_transactions, 0) AS total_transactions,
  CAST({_plain('coalesce(p.avg_amount, 0E0)')} AS DOUBLE) AS avg_transaction_amount,
  coalesce(p.min_amount, 0) AS min_amount, coalesce(p.max_amount, 0) AS max_amount,
  coalesce(array_to_string(p.locations[1:5], '|'), '') AS known_locations, coalesce(p.fraud_history, 0) AS fraud_history,
  coalesce(s.history_count, 0) AS total_count, coalesce(p.recent_24h_count, 0) AS recent_24h_count,
  least(coalesce(s.history_count, 0), 5) AS n_recent, least(coalesce(s.history_count, 0), 5) + 1 AS n_timeline,
  array_to_string(list_transform(f.patterns, lambda x: x.detail), '|') AS detected_patterns
FROM found f LEFT JOIN prof p USING (user_id) LEFT JOIN snap s USING (user_id)""", _PAST, _NEWEST, _SNAPSHOT, _found()),
    "monitor_result": _sql("""
SELECT transaction_id, CASE WHEN error IS NULL THEN verdict END AS monitor_verdict,
  CASE WHEN error IS NULL THEN CAST(floor(score * 100) AS INT) END AS final_score, error AS monitor_error,
  CASE WHEN error IS NOT NULL THEN NULL WHEN floor(score * 100) < 30 THEN 'LOW' WHEN floor(score * 100) < 70 THEN 'MEDIUM'
       ELSE 'HIGH' END AS risk_level
FROM scored JOIN said USING (transaction_id)""", _SCORE, _MONITOR),
    "assessment_summary": _sql("""
SELECT c.transaction_id, c.user_id, j.final_verdict, j.confidence_score AS confidence, j.risk_level,
  CASE WHEN r.error IS NULL THEN CAST(floor(s.score * 100) AS INT) ELSE 0 END AS ml_fraud_score,
  len(f.patterns) AS suspicious_patterns, c.authentication_method = 'Biometric' AS photo_verified, j.recommended_action
FROM cur c JOIN scored s USING (transaction_id) JOIN said r USING (transaction_id) JOIN judged j USING (transaction_id)
JOIN found f USING (transaction_id)""", _PAST, _NEWEST, _SNAPSHOT, _found(), _SCORE, _MONITOR, _ASSESSMENT),
    "prompt_requests": _sql("""
SELECT transaction_id, agent, max_tokens, temperature, TRUE AS has_prompt FROM (
  SELECT transaction_id, unnest([
    {'agent': 'monitor', 'max_tokens': 800, 'temperature': 0.3E0}, {'agent': 'evidence', 'max_tokens': 300, 'temperature': 0.3E0},
    {'agent': 'assessment', 'max_tokens': 1500, 'temperature': 0.3E0}], recursive := true) FROM cur
  UNION ALL SELECT transaction_id, 'photo', 800, 0.2E0 FROM cur WHERE authentication_method = 'Biometric'
  UNION ALL SELECT transaction_id, 'case_report', NULL, NULL FROM cases JOIN cur USING (transaction_id))""",
                            _PAST, _SCORE, _MONITOR, _CASES),
    "label_dictionary": _sql("""
SELECT field, value, dense_rank() OVER (PARTITION BY field ORDER BY value) - 1 AS code FROM (SELECT DISTINCT field, value FROM (
  SELECT unnest([{'field': 'transaction_type', 'value': transaction_type}, {'field': 'device_type', 'value': device_type},
    {'field': 'location', 'value': location}, {'field': 'merchant_category', 'value': merchant_category},
    {'field': 'card_type', 'value': card_type}, {'field': 'authentication_method', 'value': authentication_method}],
    recursive := true) FROM txn))"""),
    "label_encode": _sql("""
SELECT transaction_id, """ + ",\n  ".join(
        f"coalesce((SELECT count(DISTINCT p.{c}) FROM past p WHERE p.{c} < cur.{c}), 0) "
        f"* CASE WHEN {c} IN (SELECT {c} FROM past) THEN 1 ELSE 0 END AS {c}_code"
        for c in ("transaction_type", "device_type", "location", "merchant_category", "card_type",
                  "authentication_method")) + " FROM cur", _PAST),
    "stratified_split_counts": _split_counts(),
    "class_balance": _sql("""
SELECT count(*) FILTER (WHERE fraud_label = 0) AS negatives, count(*) FILTER (WHERE fraud_label = 1) AS positives,
  round(count(*) FILTER (WHERE fraud_label = 0) / count(*) FILTER (WHERE fraud_label = 1), 6) AS fraud_ratio FROM txn"""),
    "auc_rank": _sql("""
SELECT CAST(sum(fraud_label) AS BIGINT) AS positives, count(*) - CAST(sum(fraud_label) AS BIGINT) AS negatives,
  round((sum(CASE WHEN fraud_label = 1 THEN r END) - sum(fraud_label) * (sum(fraud_label) + 1) / 2)
        / (sum(fraud_label) * (count(*) - sum(fraud_label))), 6) AS auc
FROM (SELECT fraud_label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored)""",
                     _SCORE),
    "confusion_matrix": _sql("""
SELECT count(*) FILTER (WHERE fraud_label = 0 AND score < 0.35E0) AS tn, count(*) FILTER (WHERE fraud_label = 0 AND score >= 0.35E0) AS fp,
  count(*) FILTER (WHERE fraud_label = 1 AND score < 0.35E0) AS fn, count(*) FILTER (WHERE fraud_label = 1 AND score >= 0.35E0) AS tp
FROM scored""", _SCORE),
    "classification_report": _sql("""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT class, precision, recall, f1, support FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg(CASE WHEN hit THEN 1 ELSE 0 END) FROM g), (SELECT count(*) FROM g)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)""", _SCORE, """
g AS (SELECT fraud_label AS y, CASE WHEN score >= 0.35E0 THEN 1 ELSE 0 END AS p,
  fraud_label = CASE WHEN score >= 0.35E0 THEN 1 ELSE 0 END AS hit FROM scored),
pr AS (SELECT c, count(*) FILTER (WHERE y = c) AS support,
  coalesce(count(*) FILTER (WHERE y = c AND p = c) / nullif(count(*) FILTER (WHERE p = c), 0), 0) AS precision,
  coalesce(count(*) FILTER (WHERE y = c AND p = c) / nullif(count(*) FILTER (WHERE y = c), 0), 0) AS recall
  FROM g, (VALUES (0), (1)) v(c) GROUP BY c),
per AS (SELECT CASE c WHEN 0 THEN 'Legitimate' ELSE 'Fraud' END AS class, precision, recall,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM pr)"""),
    "fraud_cases": _sql("""
SELECT case_id, transaction_id, user_id, risk_score, status, transaction_amount AS amount, evidence_path,
  epoch_us(ts) AS created_us, length(report) AS report_length FROM records""", _SCORE, _MONITOR, _CASES),
    "fraud_alerts": _sql(f"""
SELECT case_id, 'Fraud Alert: ' || case_id AS subject, 'Case ' || case_id || ': transaction ' || transaction_id || ' over $'
  || {_money('transaction_amount')} || ' scored ' || risk_score || ' of 100 (status ' || status || ').' || chr(10)
  || 'Evidence: ' || evidence_path || chr(10) || 'The report begins:' || chr(10) || left(report, 500) AS message
FROM records""", _SCORE, _MONITOR, _CASES),
}


ORACLE.update({
    "evidence_documents": _sql("""
SELECT r.case_id, CAST(r.transaction_id AS VARCHAR) AS transaction_id, t.merchant_category, j.final_verdict,
  CAST((SELECT count(*) FROM point p WHERE p.transaction_id = r.transaction_id) AS INT) AS n_patterns,
  length(r.report) AS report_length
FROM records r JOIN txn t USING (transaction_id) JOIN judged j USING (transaction_id)""", _SCORE, _MONITOR, _CASES,
                               _ASSESSMENT, _HIST, _FIRST, _POINT.replace("VELOCITY", "10")),
    "sink_profiles_json": _sql("""
SELECT user_id, (SELECT count(*) FROM txn t WHERE t.user_id = top.user_id) AS total_transactions,
  (SELECT max(transaction_amount) FROM txn t WHERE t.user_id = top.user_id) AS highest_transaction,
  (SELECT mode(location ORDER BY location) FROM txn t WHERE t.user_id = top.user_id) AS home_location,
  string_agg(value || ':' || n, '|' ORDER BY rank) FILTER (WHERE field = 'merchant' AND rank <= 3) AS typical_merchants,
  string_agg(value, '|' ORDER BY first) FILTER (WHERE field = 'device') AS known_devices
FROM top GROUP BY user_id""", _COUNTS),
    "sink_transactions_csv": _sql("""
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS ts_us,
  transaction_amount, account_balance, merchant_category, daily AS daily_transaction_count,
  round(avg7, 8) AS avg_transaction_amount_7d, fraud_label FROM hist""", _HIST),
    "sink_history_store": _sql("""
SELECT transaction_id, user_id, epoch_us(ts) AS ts_us FROM past
WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' AND user_id IN (SELECT user_id FROM cur)""", _PAST),
    "sink_cases": _sql("SELECT case_id, transaction_id, risk_score, status FROM records", _SCORE, _MONITOR, _CASES),
    "stream_scores": _sql("""
SELECT transaction_id, score AS fraud_probability, CAST(floor(score * 100) AS INT) AS fraud_score,
  CASE WHEN floor(score * 100) < 30 THEN 'LOW' WHEN floor(score * 100) < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  coalesce(total_transactions, 0) AS total_transactions, coalesce(fraud_history, 0) AS fraud_history
FROM cur JOIN scored USING (transaction_id) LEFT JOIN prof ON prof.user_id = cur.user_id""",
                          _PAST, _NEWEST, _SNAPSHOT, _SCORE),
    "stream_first_copies": _sql("SELECT transaction_id, user_id FROM txn"),
    "stream_rolling_counts": _sql("""
SELECT user_id, epoch_us(window_end) AS end_us, count(*) AS n FROM (
  SELECT user_id, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR,
                                         date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS window_end FROM txn)
GROUP BY user_id, window_end"""),
    "stream_bursts": _sql("""
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 1 HOUR) AS end_us, count(*) AS n FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END
      AS opens FROM txn))
GROUP BY user_id, burst"""),
    "stream_user_state": _sql("""
SELECT transaction_id, user_id, count_24h, rapid AS rapid_succession, new_device AS is_new_device,
  new_location AS is_new_location, new_merchant AS is_new_merchant FROM hist JOIN firsts USING (transaction_id)""",
                              _HIST, _FIRST),
    "stream_history_features": _sql("""
SELECT transaction_id, count_7d, round(avg7, 8) AS avg_transaction_amount_7d, failed7 AS failed_transaction_count_7d,
  prior_fraud AS previous_fraudulent_activity, hist_count, hist_fraud, round(hist_avg, 8) AS hist_avg_amount,
  daily AS daily_transaction_count, count_24h, rapid AS rapid_succession, new_device AS is_new_device,
  new_location AS is_new_location, new_merchant AS is_new_merchant FROM hist JOIN firsts USING (transaction_id)""", _HIST, _FIRST),
    "stream_history_seeded": _sql(f"""
SELECT transaction_id, count_7d, round(avg7, 8) AS avg_transaction_amount_7d, failed7 AS failed_transaction_count_7d,
  prior_fraud AS previous_fraudulent_activity, hist_count, hist_fraud, round(hist_avg, 8) AS hist_avg_amount,
  daily AS daily_transaction_count, count_24h, rapid AS rapid_succession, new_device AS is_new_device,
  new_location AS is_new_location, new_merchant AS is_new_merchant FROM hist JOIN firsts USING (transaction_id)
WHERE ts >= {AS_OF}""", _HIST, _FIRST),
    "stream_cases": _sql("""
SELECT case_id, 'Fraud Alert: ' || case_id AS subject FROM (
  SELECT 'FA-' || strftime(ts, '%Y%m%d') || '-' || (999 + row_number() OVER (
    PARTITION BY CAST(ts AS DATE) ORDER BY ts, transaction_id)) AS case_id FROM scored WHERE floor(score * 100) >= 70)""", _SCORE),
})
ORACLE["stream_scores_large_profile"] = ORACLE["stream_scores"]


def _timeline(rank_filter):
    return _sql(f"""
SELECT c.transaction_id, CAST(row_number() OVER (PARTITION BY c.transaction_id ORDER BY {rank_filter[1]}) - 1 AS INT) AS pos,
  epoch_us(e.ts) AS time_us, e.event, e.type, e.fraud_flag
FROM cur c JOIN LATERAL (
  SELECT n.ts, n.rank AS place, '$' || {_money('n.transaction_amount')} || ' at ' || n.merchant_category || ' (' || n.location || ')' AS event,
    n.transaction_type AS type, n.fraud_label AS fraud_flag FROM kept n WHERE n.user_id = c.user_id
  UNION ALL SELECT c.ts, NULL, 'CURRENT: $' || {_money('c.transaction_amount')} || ' at ' || c.merchant_category || ' (' || c.location || ')',
    c.transaction_type, 0) e ON TRUE""", _PAST, _NEWEST, f"kept AS ({rank_filter[0]})")


ORACLE["txn_timeline"] = _timeline(("SELECT * FROM newest WHERE rank <= 5", "e.place DESC NULLS LAST"))
ORACLE["txn_timeline_newest_first"] = _timeline((
    "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS held FROM newest WHERE rank <= 100) "
    "WHERE rank > held - 5", "e.place ASC NULLS LAST"))


_PARTS = _split_counts()
_FEATURES = ["Transaction_Amount", "Transaction_Type", "Account_Balance", "Device_Type", "Location", "Merchant_Category",
             "IP_Address_Flag", "Previous_Fraudulent_Activity", "Daily_Transaction_Count", "Avg_Transaction_Amount_7d",
             "Failed_Transaction_Count_7d", "Card_Type", "Card_Age", "Transaction_Distance", "Authentication_Method",
             "Is_Weekend", "hour_of_day", "day_of_week", "is_unusual_hour", "amount_deviation_ratio", "is_high_value",
             "is_new_device"]

ORACLE.update({
    "model_metadata": f"""
SELECT '{"|".join(_FEATURES)}' AS features, 22 AS n_features,
  'Transaction_Type|Device_Type|Location|Merchant_Category|Card_Type|Authentication_Method' AS categorical_features,
  CAST(sum(n) AS BIGINT) AS training_samples,
  round(sum(n) FILTER (WHERE fraud_label = 0) / sum(n) FILTER (WHERE fraud_label = 1), 6) AS fraud_ratio
FROM ({_PARTS}) WHERE split = 'train'""",
    "model_quality": f"""
SELECT CASE fraud_label WHEN 0 THEN 'Legitimate' ELSE 'Fraud' END AS class, n AS support, true AS test_above_chance,
  true AS validation_above_chance FROM ({_PARTS}) WHERE split = 'test'""",
    "model_importance": "SELECT unnest({}) AS feature, true AS is_share, true AS adds_up, true AS is_sorted".format(_FEATURES),
    "model_scores": _sql("""
SELECT transaction_id, true AS same_as_trained, true AS is_probability, true AS score_follows, true AS band_follows
FROM cur""", _PAST),
    "stream_model_scores": _sql("SELECT transaction_id, true AS as_in_batch FROM cur", _PAST),
    "sink_evidence": _sql("""
SELECT r.case_id, CAST(r.transaction_id AS VARCHAR) AS transaction_id, true AS at_its_path, j.final_verdict
FROM records r JOIN judged j USING (transaction_id)""", _SCORE, _MONITOR, _CASES, _ASSESSMENT),
    "sink_scenarios_json": "SELECT scenario_name, transaction_id, user_id FROM ({})".format(ORACLE["scenario_samples"]),
    "sink_enhanced": _sql("""
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, hour_of_day, is_high_value, is_high_value AS stored_high_value,
  round(ratio, 6) AS amount_deviation_ratio FROM enhanced""", _HIST, _ENHANCED),
    "photo_result": _sql("""
SELECT b.transaction_id, verification_result = 'VERIFIED' AND face_matched AND is_real AND is_live AS is_authentic,
  CASE WHEN s.error IS NULL THEN s.verdict END AS photo_verdict,
  CASE WHEN bad IS NOT NULL THEN 'Unable to parse analysis' END AS photo_findings,
  CASE WHEN bad IS NOT NULL THEN 'Manual review required' END AS photo_action, s.error
FROM bio b JOIN said s USING (transaction_id)""", _BIO, _MONITOR),
    "branch_errors": _sql("""
SELECT c.transaction_id, s.error AS monitor_error, CASE WHEN c.k % 9 = 0 THEN 'user_id is required' END AS evidence_error,
  s.error AS photo_error, CASE WHEN s.error IS NULL THEN s.verdict END AS photo_verdict, c.k % 9 = 0 AS no_evidence
FROM cur c JOIN said s USING (transaction_id)""", _PAST, _MONITOR),
    "request_history_offsets": _sql("""
SELECT transaction_id, hour(ts + CASE transaction_id % 3 WHEN 0 THEN INTERVAL 0 MINUTE WHEN 1 THEN INTERVAL 300 MINUTE
  ELSE INTERVAL (-210) MINUTE END) AS hour_of_day, hist_count, count_24h, epoch_us(ts) AS ts_us FROM hist""", _HIST),
    "odd_amounts": _sql("""
SELECT transaction_id, count(*) OVER before AS hist_count, count(*) OVER d7 AS count_7d,
  round(log10(1 + avg(amount) FILTER (WHERE readable) OVER before), 6) AS hist_avg_log,
  round(log10(1 + avg(amount) FILTER (WHERE readable) OVER d7), 6) AS avg_7d_log, missing AS amount_is_null
FROM (SELECT transaction_id, user_id, ts, transaction_id % 11 NOT IN (0, 1, 5) AS readable, transaction_id % 11 = 4 AS missing,
  CASE transaction_id % 11 WHEN 2 THEN 1e13 WHEN 3 THEN 4e-7 WHEN 4 THEN 0 ELSE transaction_amount END AS amount FROM txn)
WINDOW before AS (PARTITION BY user_id ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  d7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW)"""),
})

for name, same in {"profile_increments_training": "user_profile_training", "profile_increments_serving": "user_profile_serving",
                   "profile_increments_newest": "newest_history", "stream_fan_in": "assessment_summary",
                   "sink_history_by_user": "sink_history_store", "velocity_24h_by_user": "velocity_24h"}.items():
    ORACLE[name] = ORACLE[same]

ORACLE["stream_fan_in_late"] = _sql("""
SELECT c.transaction_id, CASE WHEN c.k % 13 = 0 THEN 'no reply' ELSE r.error END AS monitor_error,
  CASE WHEN r.error IS NULL AND c.k % 13 <> 0 THEN CAST(floor(s.score * 100) AS INT) ELSE 0 END AS ml_fraud_score,
  c.authentication_method = 'Biometric' AND c.k % 7 <> 0 AS photo_verified,
  CASE WHEN c.k % 17 = 0 THEN 'REVIEW' ELSE j.final_verdict END AS final_verdict,
  CASE WHEN c.k % 17 = 0 THEN 'UNKNOWN' ELSE j.risk_level END AS risk_level,
  CASE WHEN c.k % 17 = 0 THEN 'no reply' WHEN c.k % 10 = 1 THEN 'reply is not a JSON object' END AS assessment_error
FROM cur c JOIN scored s USING (transaction_id) JOIN said r USING (transaction_id) JOIN judged j USING (transaction_id)""",
                                     _PAST, _SCORE, _MONITOR, _ASSESSMENT)

ORACLE["stream_dead_letters"] = _sql("""
SELECT transaction_id AS message_id, CASE WHEN reason IS NULL THEN CAST(transaction_id AS VARCHAR) END AS transaction_id, reason,
  CASE WHEN reason IS NULL THEN 'Desktop' END AS device_type
FROM (SELECT transaction_id, CASE k % 20 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not a JSON object' WHEN 3 THEN 'not JSON'
  WHEN 4 THEN 'missing: user_id' WHEN 5 THEN 'missing: card_type' WHEN 6 THEN 'empty' WHEN 7 THEN 'not JSON' END AS reason FROM txn)""")
