"""Split, encoders, metrics, and the trained model."""

import random

import pytest
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions import scores
from riskflow.operators import metrics, ranks, training
from riskflow.plans import batch
from riskflow.sources import model_store, tables
from riskflow.streaming import jobs, scoring


def test_split_sizes_of_fifty_thousand_rows(spark):
    df = spark.range(50000).select(F.col("id").alias("transaction_id"), (F.col("id") % 1000 < 321).cast("int").alias("fraud_label"))
    out = {(r.split, r.fraud_label): r["count"] for r in
           training.stratified_split(df).groupBy("split", "fraud_label").count().collect()}
    total = {s: sum(n for (k, _), n in out.items() if k == s) for s in ("train", "validation", "test")}
    assert total == {"train": 35020, "validation": 7480, "test": 7500}
    for s, n in total.items():
        assert abs(out[(s, 1)] / n - 0.321) < 1e-3
    ranked = df.selectExpr("transaction_id", "fraud_label", "row_number() OVER (PARTITION BY fraud_label ORDER BY xxhash64(transaction_id, 42), "
                           "transaction_id) AS n")
    part = (f"CASE WHEN n <= IF(fraud_label = 1, {out[('test', 1)]}, {out[('test', 0)]}) THEN 'test' WHEN n <= IF(fraud_label = 1, "
            f"{out[('test', 1)] + out[('validation', 1)]}, {out[('test', 0)] + out[('validation', 0)]}) THEN 'validation' ELSE 'train' END AS split")
    assert training.stratified_split(df).select("transaction_id", "split").exceptAll(ranked.selectExpr("transaction_id", part)).count() == 0
    again = training.stratified_split(df.repartition(5)).where("split = 'test'").select("transaction_id")
    first = training.stratified_split(df).where("split = 'test'").select("transaction_id")
    assert again.exceptAll(first).count() == 0


def test_numbering_is_gapless_across_blocks(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("h"))
    out = ranks.numbered(df, "g", F.col("h").cast("int"), ["h", "id"])
    want = df.selectExpr("id", "row_number() OVER (PARTITION BY g ORDER BY h, id) AS n")
    assert out.select("id", F.col("n").cast("int")).exceptAll(want).count() == 0


def test_encoding(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "x")], "device_type string, location string")
    codes = training.label_dictionary(df, ["device_type", "location"])
    assert {(r.field, r.value): r.code for r in codes.collect()} == {
        ("device_type", "a"): 0, ("device_type", "b"): 1, ("device_type", "c"): 2, ("location", "nan"): 0, ("location", "x"): 1}
    new = spark.createDataFrame([("c", "x"), ("zz", None), (None, "q")], "device_type string, location string")
    got = training.encode(new, codes, ["device_type", "location"]).select("device_type_code", "location_code").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 0), (2, 1)]


@pytest.mark.parametrize("digits", [1, 3, 17])
def test_auc_equals_pair_counting(spark, digits):
    rnd = random.Random(digits)
    rows = [(round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2))), digits), y) for y in (0, 1) for _ in range(300)]
    got = metrics.auc(spark.createDataFrame(rows, "score double, fraud_label int")).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got.auc == pytest.approx(pairs / len(pos) / len(neg), abs=1e-12)


def test_report_without_predicted_frauds(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 1)], "score double, fraud_label int")
    out = {r["class"]: r for r in metrics.classification_report(rows).collect()}
    assert (out["Fraud"].precision, out["Fraud"].recall, out["Fraud"].support) == (0.0, 0.0, 1)
    assert out["accuracy"].f1 == 0.5 and metrics.auc(rows.where("fraud_label = 0")).first().auc is None


def test_train_save_load_score(spark, tmp_path):
    rnd = random.Random(7)
    rows = []
    for i in range(1500):
        fraud = int(rnd.random() < 0.3)
        rows.append([str(i)] + [float(rnd.gauss(100 + 900 * fraud, 120)) if c == "Transaction_Amount" else
                                rnd.choice(["a", "b", "c"]) if c in C.CATEGORICAL_FEATURES else float(rnd.randrange(5))
                                for c in C.MODEL_FEATURES] + [fraud])
    kinds = ", ".join(f"{c.lower()} {'string' if c in C.CATEGORICAL_FEATURES else 'double'}" for c in C.MODEL_FEATURES)
    df = spark.createDataFrame(rows, f"transaction_id string, {kinds}, fraud_label int")
    out = batch.train(df, str(tmp_path), trees=5)
    assert out["auc"].first().auc > 0.9 and out["importance"].count() == 22
    assert out["importance"].first().feature == "Transaction_Amount"
    meta = out["metadata"].first()
    assert meta.n_features == 22 and meta.training_samples == 1500 - 225 - 225  # ceil of 0.176 * 1275
    model = tables.load_model(str(tmp_path))
    assert tables.load_model(str(tmp_path)) is model
    a = {r.transaction_id: r.fraud_probability for r in out["tested"].collect()}
    unseen = df.where(F.col("transaction_id").isin(list(a)))
    b = {r.transaction_id: r.fraud_probability for r in training.score(unseen, model).collect()}
    assert a == b
    strange = df.limit(1).withColumn("location", F.lit("never seen")).withColumn("card_age", F.lit(None).cast("double"))
    assert 0 <= training.score(strange, model).first().fraud_probability <= 1
    batch.train(df, str(tmp_path), trees=2)
    assert len(tables.load_model(str(tmp_path)).stages[-1].trees) == 2  # not the one that was read before


def small_table(spark, n=900, seed=5):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        fraud = int(rnd.random() < 0.3)
        rows.append([str(i)] + [float(rnd.gauss(100 + 900 * fraud, 120)) if c == "Transaction_Amount" else
                                rnd.choice(["a", "b", "c"]) if c in C.CATEGORICAL_FEATURES else float(rnd.randrange(5))
                                for c in C.MODEL_FEATURES] + [fraud])
    kinds = ", ".join(f"{c.lower()} {'string' if c in C.CATEGORICAL_FEATURES else 'double'}" for c in C.MODEL_FEATURES)
    return spark.createDataFrame(rows, f"transaction_id string, {kinds}, fraud_label int")


def test_results_follow_from_the_saved_model(spark, tmp_path):
    """Importances, the top ten and the report, recomputed from the model that was saved and the rows it was tested on."""
    out = batch.train(small_table(spark), str(tmp_path), trees=3)
    model = tables.load_model(str(tmp_path))
    weights = dict(zip(C.MODEL_FEATURES, model.stages[-1].featureImportances.toArray().tolist()))
    want = sorted(weights.items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in out["importance"].collect()] == want
    assert [tuple(r) for r in training.top_features(out["importance"]).collect()] == want[:10]
    tested = [(int(r.fraud_probability >= C.EVALUATION_THRESHOLD), r.fraud_label) for r in out["tested"].collect()]
    report = {r["class"]: r for r in out["report"].collect()}
    assert sum(report[c].support for c in C.TARGET_NAMES) == len(tested)
    for k, c in enumerate(C.TARGET_NAMES):
        hit, said, real = (sum(f(g, y) for g, y in tested) for f in (lambda g, y: g == y == k, lambda g, y: g == k, lambda g, y: y == k))
        precision, recall = hit / said, hit / real
        assert [report[c].precision, report[c].recall, report[c].support] == [pytest.approx(precision), pytest.approx(recall), real]
        assert report[c].f1 == pytest.approx(2 * precision * recall / (precision + recall))
    rows = [r.fraud_probability for r in out["tested"].collect()]
    labels = spark.createDataFrame([(p,) for p in rows], "p double").select(scores.predicted_label("p")).collect()
    assert [r[0] for r in labels] == [int(p >= 0.5) for p in rows]


def test_scores_of_the_parts_are_stored(spark, tmp_path):
    """The trees are walked once per row of the test and validation part: every measure reads the stored scores."""
    out = batch.train(small_table(spark, 400), str(tmp_path), trees=2)
    for name in ("tested", "auc", "validation_auc", "confusion", "report"):
        assert "UDF" not in out[name]._jdf.queryExecution().optimizedPlan().toString(), name
    rows = spark.read.parquet(f"{tmp_path}/split")
    want = training.score(rows.where("split = 'test'"), out["model"], keep=["transaction_id", "fraud_label"])
    assert out["tested"].schema == want.schema
    assert sorted(map(tuple, out["tested"].collect())) == sorted(map(tuple, want.collect()))
    others = training.score(rows.where("split = 'validation'"), out["model"], keep=["fraud_label"])
    assert out["validation_auc"].first() == metrics.auc(others, "fraud_probability").first()


def test_versions_of_a_model(spark, tmp_path):
    """A stream that changes its model between two micro-batches; versions stay as they were, and the log goes back."""
    root, frame = str(tmp_path / "store"), small_table(spark, 400)
    with pytest.raises(ValueError):
        model_store.load(spark, root)
    built = [batch.train(frame, str(tmp_path / f"out{n}"), trees=n) for n in (1, 2)]
    publish = lambda b: model_store.publish(b["model"], b["metadata"], b["importance"], root)
    assert publish(built[0]) == 1 and model_store.current(spark, root) == 1
    ready = frame.drop("fraud_label").withColumn("ts", F.lit("2024-01-05 10:00:00").cast("timestamp"))
    ready.where("transaction_id < 200").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ready.schema).parquet(str(tmp_path / "in"))

    def change():
        assert publish(built[1]) == 2
        ready.where("transaction_id >= 200").write.mode("append").parquet(str(tmp_path / "in"))

    path = jobs.run_to_end(stream, scoring.current_model_writer(root, ["transaction_id", "fraud_probability", "model_version"]), arrivals=[change])
    got = spark.read.parquet(path).drop("batch_id").collect()
    assert len(got) == 400 and {(int(r.transaction_id) >= 200) + 1 == r.model_version for r in got} == {True}
    assert [len(model_store.load(spark, root, v)[1].stages[-1].trees) for v in (1, 2)] == [1, 2]
    model_store.pin(spark, root, 1)
    assert model_store.load(spark, root)[0] == 1 and model_store.load(spark, root)[1] is model_store.load(spark, root, 1)[1]
    assert publish(built[1]) == 3
