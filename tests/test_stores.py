"""Sources, sinks, cases and streams."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.operators import cases
from riskflow.sources import case_store, requests, tables
from riskflow.streaming import jobs, scoring, user_state, windows
from tests.test_point_in_time import as_rows, expected, make


def test_raw_csv(spark, tmp_path):
    header = list(C.RAW_COLUMNS)
    values = {"Transaction_ID": "T-7", "User_ID": "U-9", "Transaction_Amount": "12.75", "Timestamp": "2024-03-02 08:15:30",
              "Daily_Transaction_Count": "4", "Card_Age": "210", "Fraud_Label": "1"}
    line = ",".join(values.get(c, "0") for c in header)
    bad = line.replace("2024-03-02 08:15:30", "yesterday")
    (tmp_path / "raw.csv").write_text("\n".join([",".join(header), line, bad]) + "\n")
    a, b = tables.read_transactions_csv(spark, str(tmp_path / "raw.csv")).collect()
    assert (a.transaction_id, a.transaction_amount, a.daily_transaction_count, a.card_age) == ("T-7", 12.75, 4, 210)
    assert str(a.ts) == "2024-03-02 08:15:30" and b.ts is None and b.user_id == "U-9"
    assert a.unreadable is None and b.unreadable == ["ts"]
    assert tables.raw_names(tables.read_transactions_csv(spark, str(tmp_path / "raw.csv"))).columns == [*C.RAW_COLUMNS, "unreadable"]
    # whole numbers as other programs write them, and what is no number
    odd = values | {"Card_Age": "1.0", "Fraud_Label": "0.0", "Is_Weekend": "1.5", "Transaction_Amount": "many", "Account_Balance": ""}
    (tmp_path / "odd.csv").write_text(",".join(header) + "\n" + ",".join(odd.get(c, "0") for c in header) + "\n")
    d = tables.read_transactions_csv(spark, str(tmp_path / "odd.csv")).first()
    assert (d.card_age, d.fraud_label, d.is_weekend, d.transaction_amount, d.account_balance) == (1, 0, None, None, None)
    assert sorted(d.unreadable) == ["is_weekend", "transaction_amount"]
    # another column order, and the calculated columns
    header = header[::-1] + ["hour_of_day", "amount_deviation_ratio", "note"]
    (tmp_path / "more.csv").write_text(",".join(header) + "\n" + ",".join(values.get(c, "3") for c in header) + "\n")
    c = tables.read_transactions_csv(spark, str(tmp_path / "more.csv")).first()
    assert (c.card_age, c.fraud_label, c.hour_of_day, c.amount_deviation_ratio, c.note) == (210, 1, 3, 3.0, "3")


def test_requests(spark, tmp_path):
    good = '{"transaction_id":"T1","user_id":"U","transaction_amount":5,"transaction_type":"ATM","merchant_category":"R","card_type":"Visa"}'
    (tmp_path / "r.json").write_text(good + '\n{"transaction_id":"T2","user_id":"U"}\n')
    ok, bad = requests.valid_requests(requests.read_requests(spark, str(tmp_path / "r.json")))
    r = ok.first()
    assert (r.device_type, r.location, r.authentication_method, r.photo_path) == ("Desktop", "Unknown", "Password", None)
    assert bad.first().error == "missing: transaction_amount, transaction_type, merchant_category, card_type"
    texts = spark.createDataFrame([(good,), ("{",)], "value string")
    assert requests.valid_requests(requests.parse_requests(texts))[1].count() == 1


def test_repeated_rows(spark):
    rows = make(50, 1, 0.5)
    df = as_rows(spark, rows + rows + rows[:1] * 40)
    assert sorted(r.transaction_id for r in tables.drop_repeated(df).collect()) == list(range(50))


def test_history_store(spark, tmp_path):
    rows = make(300, 2, 0.7, days=6)
    tables.write_history(as_rows(spark, rows), str(tmp_path / "h"), files_per_day=6)
    part = tables.read_history(spark, str(tmp_path / "h"), "2024-01-03 00:00:00", "2024-01-05 12:00:00")
    want = sorted(r[0] for r in rows if (3, 0) <= (r[2].day, r[2].hour) and (r[2].day, r[2].hour) < (5, 12))
    assert sorted(r.transaction_id for r in part.collect()) == want
    assert "PartitionFilters: [isnotnull(txn_date" in part._jdf.queryExecution().executedPlan().toString()


def test_bucketed_history_is_not_shuffled(spark, tmp_path):
    """A scoring join and the history pass read the store where it lies; results equal those of the plain table."""
    from riskflow.operators import point_in_time as pit
    rows = as_rows(spark, make(500, 31, 0.1))
    tables.write_history_by_user(rows, "history_by_user_test", str(tmp_path / "store"), 8)
    try:
        stored = tables.read_history_by_user(spark, "history_by_user_test")
        asked = rows.where("transaction_id % 5 = 0").selectExpr("user_id", "transaction_id AS asked")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = stored.join(asked, "user_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("FileScan parquet spark_catalog"):]
        above = plan[:plan.index("FileScan parquet spark_catalog")]
        assert "Bucketed: true" in side and plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in above
        got = pit.point_in_time(stored, parts=(pit.LAST_24H, pit.LAST_7D))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = pit.point_in_time(rows, parts=(pit.LAST_24H, pit.LAST_7D))
        names = ["transaction_id", "count_24h", "count_7d", "failed_transaction_count_7d"]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
        week = tables.read_history_by_user(spark, "history_by_user_test", since="2024-01-03 00:00:00", until="2024-01-05 00:00:00")
        assert week.count() == rows.where("ts >= '2024-01-03' AND ts < '2024-01-05'").count()
        assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in week._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE history_by_user_test")


def judged(spark, ids, day="2024-01-02", score=80):
    return spark.createDataFrame([(i, "u", f"{day} 10:{i % 60:02d}:00", 1234.5, score, "REVIEW", "r" * 700) for i in ids],
                                 "transaction_id int, user_id string, ts string, transaction_amount double, "
                                 "risk_score int, status string, fraud_report string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def test_case_selection(spark):
    rows = spark.createDataFrame([(69, "REVIEW"), (70, "REVIEW"), (0, "REJECTED"), (None, "REJECTED"), (10, None)],
                                 "risk_score int, status string")
    assert cases.high_risk(rows).count() == 3


def test_cases_continue_and_repeat(spark, tmp_path):
    root = str(tmp_path / "c")
    case_store.write_cases(judged(spark, [1, 2, 2, 2]), 0, root)
    case_store.write_cases(judged(spark, [2, 3]), 1, root)
    case_store.write_cases(judged(spark, [2, 3]), 1, root)
    case_store.write_cases(judged(spark, [], ), 2, root)
    case_store.write_cases(judged(spark, [1, 2]), 0, root)  # the first write again, after the second
    out = {r.transaction_id: r.case_id for r in case_store.read_cases(spark, root).collect()}
    assert out == {1: "FA-20240102-1000", 2: "FA-20240102-1001", 3: "FA-20240102-1002"}
    message = case_store.read_alerts(spark, root).where("case_id = 'FA-20240102-1000'").first().message
    attempt = case_store.log(spark, root).where("write_id = 0").agg(F.max_by("attempt", "seq")).first()[0]
    assert message == ("Case FA-20240102-1000: transaction 1 over $1,234.50 scored 80 of 100 (status REVIEW).\n"
                       f"Evidence: {root}/evidence/write_id=0/attempt={attempt}/case_date=2024-01-02/bucket=0\nThe report begins:\n" + "r" * 500)


def test_a_write_reads_only_its_days(spark, tmp_path, monkeypatch):
    root, asked = str(tmp_path / "c"), []
    case_store.write_cases(judged(spark, [1, 2], "2024-01-02"), 0, root)
    real = case_store._existing
    monkeypatch.setattr(case_store, "_existing", lambda spark, path, days: asked.extend(map(str, days)) or real(spark, path, days))
    case_store.write_cases(judged(spark, [3, 4], "2024-01-05"), 1, root)
    assert set(asked) == {"2024-01-05"} and case_store.read_cases(spark, root).count() == 4


def test_a_write_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """It breaks off after its cases, after its alerts, and before its commit; then it is repeated."""
    root = str(tmp_path / "store")
    document = lambda opened: opened.selectExpr("case_date", "case_id", "'{}' AS document")
    case_store.write_cases(judged(spark, [1, 2]), 0, root, documents=document)

    class Broken(Exception):
        pass

    def fails(*_, **__):
        raise Broken

    real = {n: getattr(case_store, n) for n in ("_stage", "_write_evidence", "_commit")}
    steps = [("_stage", lambda rows, path, *more: fails() if path.endswith("alerts") else real["_stage"](rows, path, *more)),
             ("_write_evidence", fails), ("_commit", fails)]
    for name, step in steps:
        for numbers, write_id in (([3, 4], 1), ([1, 2], 0)):  # a new write, and a repeated one
            with monkeypatch.context() as m, pytest.raises(Broken):
                m.setattr(case_store, name, step)
                case_store.write_cases(judged(spark, numbers), write_id, root, documents=document)
            assert sorted(r.transaction_id for r in case_store.read_cases(spark, root).collect()) == [1, 2]
            assert case_store.read_alerts(spark, root).count() == 2
    before = {r.transaction_id: r.case_id for r in case_store.read_cases(spark, root).collect()}
    case_store.write_cases(judged(spark, [3, 4]), 1, root, documents=document)
    case_store.write_cases(judged(spark, [1, 2]), 0, root, documents=document)
    after = {r.transaction_id: r.case_id for r in case_store.read_cases(spark, root).collect()}
    assert set(after) == {1, 2, 3, 4} and before.items() <= after.items() and len(set(after.values())) == 4
    for r in case_store.read_cases(spark, root).collect():
        assert case_store.read_evidence(spark, r.evidence_path).where(F.col("case_id") == r.case_id).count() == 1


def test_two_writers_at_once_do_not_share_numbers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    case_store.write_cases(judged(spark, [1]), 0, root)
    real = case_store._stage

    def interrupted(rows, path, write_id, attempt):
        if path.endswith("cases") and write_id == 1:
            case_store.write_cases(judged(spark, [2]), 2, root)
        real(rows, path, write_id, attempt)

    with monkeypatch.context() as m, pytest.raises(AnalysisException):
        m.setattr(case_store, "_stage", interrupted)
        case_store.write_cases(judged(spark, [3]), 1, root)
    case_store.write_cases(judged(spark, [3]), 1, root)
    found = {r.transaction_id: r.case_id for r in case_store.read_cases(spark, root).collect()}
    assert set(found) == {1, 2, 3} and len(set(found.values())) == 3


def test_more_cases_than_four_digits(spark):
    many = spark.range(9500).selectExpr("id AS transaction_id", "TIMESTAMP'2024-01-02 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts")
    ids = [r.case_id for r in cases.with_case_ids(many).orderBy("ts").collect()]
    assert ids[0] == "FA-20240102-1000" and ids[-1] == "FA-20240102-10499" and len(set(ids)) == 9500


def test_stream_state_equals_batch(spark, tmp_path):
    """Files in time order, several per run, and a user with most of the rows."""
    jobs.use_keyed_state(spark)
    rows = sorted((r for r in make(400, 11, 0.6, days=2)), key=lambda r: (r[2], r[0]))
    assert max(w["count_24h"] for w in expected(rows).values()) > 110
    for i in range(4):
        as_rows(spark, rows[i * 100:(i + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    schema = as_rows(spark, rows[:1]).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = user_state.follow_users(source)
    got = {r.transaction_id: r for r in jobs.read_back(out, jobs.run_to_end(out)).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        g = got[i]
        assert (g.count_24h, g.rapid_succession) == (w["count_24h"], w["rapid"]), i
        assert [g.is_new_device, g.is_new_location, g.is_new_merchant] == w["new"], i


def test_stream_drops_copies(spark, tmp_path):
    rows = make(100, 12, 0.5)
    for i in range(3):
        as_rows(spark, rows + rows[:50]).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(as_rows(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for spread in (0, 3):
        out = windows.first_copies(source, spread=spread)
        got = sorted(r.transaction_id for r in jobs.read_back(out, jobs.run_to_end(out)).collect())
        assert got == list(range(100))


def test_late_rows_are_in_every_stream(spark, tmp_path):
    """Files far out of time order, a file per batch: nothing is lost, and the parts add up to the whole."""
    rows = make(240, 13, 0.5, days=9)
    for i in range(4):
        as_rows(spark, rows[i::4]).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(as_rows(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    whole = as_rows(spark, rows)
    out = windows.first_copies(source)
    assert jobs.read_back(out, jobs.run_to_end(out)).select("transaction_id").distinct().count() == 240
    runs = windows.bursts(spark.read.parquet(jobs.run_to_end(source, windows.write_pieces))).drop("amount")
    want = windows.pieces(whole).drop("amount").select(*runs.columns)
    assert runs.exceptAll(want).count() == 0 == want.exceptAll(runs).count() and runs.agg(F.sum("n")).first()[0] == 240
    counts = spark.read.parquet(jobs.run_to_end(source, windows.write_hourly))
    got = windows.rolling_counts(counts)
    want = windows.rolling_counts(windows.hourly(whole))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_stream_scores_and_cases(spark, tmp_path):
    rows = [("T1", "U1", 6000.0, "Transfer", "Travel", "Visa", "Mobile", "Unknown", "None", None, "2024-01-06T03:00:00Z"),
            ("T2", "U2", 50.0, "Online", "Retail", "Visa", "Mobile", "Tokyo", "PIN", None, "2024-01-06T13:00:00Z")]
    from riskflow.operators.features import with_request_time
    from riskflow.schemas import REQUEST
    tables.write_json(spark.createDataFrame(rows, REQUEST), str(tmp_path / "in"))
    profile = spark.createDataFrame([("U1", 7)], "user_id string, total_transactions long")
    asked = with_request_time(requests.stream_requests(spark, str(tmp_path / "in")), "2024-01-07 00:00:00")
    out = scoring.score_stream(asked, profile)
    got = {r.transaction_id: r for r in jobs.read_back(out, jobs.run_to_end(out)).collect()}
    assert (got["T1"].risk_level, got["T1"].total_transactions) == ("HIGH", 7)
    assert (got["T2"].risk_level, got["T2"].total_transactions) == ("LOW", 0)
    case_input = out.withColumns({"risk_score": F.col("fraud_score"), "status": F.lit("REVIEW"), "fraud_report": F.lit("r")})
    root = jobs.run_to_end(case_input, scoring.write_cases)
    assert [r.transaction_id for r in case_store.read_cases(spark, root).collect()] == ["T1"]
